"""Packing documents into sequences, cut by dynamic programming.

A document's tokens are the tokenizer's ids of its text and an end id.  The
documents of a partition, in order, are one stream, and the stream is cut into
windows of at most `SEQUENCE` tokens.  A cut is free where a document ends,
costs `SENTENCE_CUT` tokens where a sentence ends and `INNER_CUT` elsewhere; a
window that is not full costs its padding, none when its length is a power of
two.  The cheapest cuts are found from left to right:

    best[j] = cut(j) + min over i, j - SEQUENCE <= i < j, of best[i] + pad(j - i)

With pad(d) = SEQUENCE - d the minimum is over best[i] + i, a sliding window
minimum that a monotone queue gives in constant time a step; the lengths
`POWERS` are further transitions of their own.  Every window costs `WINDOW`
tokens more, so that sequences do not get short for nothing.  Places inside
sentences are offered every `STEP` tokens.

A stream is cut in stretches of bounded length: when more than `STRETCH` tokens
wait, all windows but the last few are final.  Nothing is shuffled, and a task
holds one stretch.

Edge cases: a null or empty text is its end id alone.  A document of any length
is cut like the rest.  Repeated rows and shared or null doc_ids are documents
of their own.  An empty table gives no rows.  Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.flat import slices
from tableflow.llm.tokens import encoder_of

SEQUENCE = 1024
#: In tokens of padding: a cut at a sentence's end, a cut inside one, a window.
SENTENCE_CUT, INNER_CUT, WINDOW = 1.0, 4.0, 2.0
#: Lengths besides SEQUENCE that need no padding and are worth a window.
POWERS = (128, 256, 512)
STEP, STRETCH = 64, 1 << 20
END_ID = 0


def cut(places: np.ndarray, costs: np.ndarray, sequence: int = SEQUENCE) -> list[int]:
    """The cheapest cuts of the stream 0..places[-1]: a subset of places
    (ascending), the last one included.  Places lie at most `sequence` apart."""
    spots = np.concatenate([[0], places])
    index = np.full(int(spots[-1]) + 1, -1)
    index[spots] = np.arange(len(spots))
    # For each place, the places a power of two before it; -1 for none.
    shorter = [d for d in POWERS if d < sequence]
    steps = np.stack([np.where(spots >= d, index[spots - d], -1) for d in shorter] or [np.full(len(spots), -1)], 1)
    has_step = (steps >= 0).any(1).tolist()
    steps, spots, costs = steps.tolist(), spots.tolist(), (costs + WINDOW).tolist()
    best, back = [0.0] * len(spots), [0] * len(spots)
    least = [0.0] * len(spots)  # best[i] + spots[i]
    queue: deque[int] = deque([0])  # places whose least is ascending
    for j in range(1, len(spots)):
        p = spots[j]
        while spots[queue[0]] < p - sequence:
            queue.popleft()
        i = queue[0]
        value = least[i] + sequence - p
        if has_step[j]:
            for k in steps[j]:
                if k >= 0 and best[k] < value:
                    value, i = best[k], k
        value += costs[j - 1]
        best[j], back[j] = value, i
        key = least[j] = value + p
        while queue and least[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(spots) - 1
    while j:
        cuts.append(spots[j])
        j = back[j]
    return cuts[::-1]


def _places(total: int, ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stretch may be cut and what each cut costs: document
    ends, sentence ends, and every STEP tokens."""
    cost = np.full(total + 1, np.inf)
    cost[STEP::STEP] = INNER_CUT
    cost[sentences] = SENTENCE_CUT
    cost[ends] = 0.0
    cost[total] = 0.0
    at = np.flatnonzero(np.isfinite(cost[1:])) + 1
    return at, cost[at]


class _Stream:
    """Tokens that wait to be cut, and whose they are."""

    def __init__(self, sequence: int) -> None:
        self.sequence = sequence
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, tokens, place of its first token here, tokens before that
        self.sentences = np.zeros(0, np.int64)
        self.next = 0

    def add(self, ids: np.ndarray, docs: list[tuple[int | None, int]], sentences: np.ndarray) -> None:
        at = len(self.ids)
        self.sentences = np.concatenate([self.sentences, sentences + at])
        self.ids = np.concatenate([self.ids, ids])
        for doc, size in docs:
            self.docs.append((doc, size, at, 0))
            at += size

    def take(self, final: bool, first_sequence: int) -> list[tuple]:
        """Cut what waits; unless final, the last windows stay and wait."""
        total = len(self.ids)
        if not total:
            return []
        ends = np.array([at + size - before for _, size, at, before in self.docs])
        cuts = cut(*_places(total, ends[ends <= total], self.sentences[self.sentences <= total]), self.sequence)
        if not final:
            cuts = [c for c in cuts if c <= total - 8 * self.sequence]
            if not cuts:
                return []
        rows, d, begin = [], 0, 0
        for c in cuts:
            at, offset = begin, 0
            while at < c:
                doc, size, here, before = self.docs[d]
                stop = min(c, here + size - before)
                piece = self.ids[at:stop]
                rows.append((doc, before + at - here, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), size, first_sequence + self.next, offset, piece))
                offset += stop - at
                at = stop
                if stop == here + size - before:
                    d += 1
            self.next += 1
            begin = c
        self.ids = self.ids[begin:]
        self.sentences = self.sentences[self.sentences > begin] - begin
        left = self.docs[d:]
        self.docs = [(doc, size, max(0, here - begin), before + max(0, begin - here)) for doc, size, here, before in left]
        return rows


_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (null unless with_ids).  `tokenizer` is the
    path of a tokenizer file that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        encoder, stream = encoder_of(tokenizer), _Stream(sequence)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for rows, buf, offs in slices(batch, max_rows=1 << 16):
                ids, edges = encoder.encode(buf, offs)
                # The end id behind each document.
                ids = np.insert(ids, edges[1:], np.uint32(END_ID))
                sizes = np.diff(edges) + 1
                stream.add(ids, list(zip(names[rows], sizes.tolist())), encoder.sentence_ends(ids))
                if len(stream.ids) > STRETCH:
                    yield from _rows(stream.take(False, first), with_ids)
        yield from _rows(stream.take(True, first), with_ids)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _OUT)


def _rows(rows: list[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 20_000):
        part = list(zip(*rows[k : k + 20_000]))
        columns = [pa.array(c, pa.int64()) for c in part[:7]]
        ids = [p.astype(np.int32) for p in part[7]] if with_ids else None
        columns.append(pa.array(ids, pa.list_(pa.int32())) if with_ids else pa.nulls(len(part[0]), pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
