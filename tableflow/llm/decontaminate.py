"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, ASCII letters (lower-cased) and bytes of non-ASCII
characters.  Every 10 consecutive words of a benchmark item are a window; an
item of fewer words, but some, is one window.  The windows of a block of items
form one automaton over word numbers (0: a word that no item has), and a
document's words run through it once.  Every match marks its words; spans of
marked words carry byte offsets of the original text.

The benchmark is taken in blocks of at most `BLOCK_WORDS` words, so what a task
holds has a fixed bound however large the benchmark is; a benchmark of one
block, the usual case, is scanned in one pass without any shuffle.

Edge cases: a null or wordless text has no words and no hits; null or wordless
items have no windows; a null item_id counts as the empty string, and rows
that share an item_id are one item.  Repeated rows and shared or null doc_ids
give a row each.  An empty benchmark marks nothing; an empty table gives no
rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import materialize
from tableflow.llm.flat import LOWER, NOT_ALNUM, flatten, slices, word_hashes, words

WINDOW = 10
BLOCK_WORDS = 1_000_000

_FIELDS = "n_words bigint, hit array<int>, items array<string>"


class Automaton:
    """The windows of some items; made from (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        buf, offs = flatten(pa.array([t for _, t in items], pa.large_string()))
        low = LOWER[buf]
        starts, ends, first = words(low, offs, NOT_ALNUM)
        hashes = word_hashes(low, starts, ends)
        self.vocabulary = np.unique(hashes)
        numbers = self.numbers(hashes).tolist()
        owners: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                owners.setdefault(tuple(numbers[i : min(i + window, b)]), set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, of in owners.items():
            self.trie.add_word(key, (len(key), tuple(of)))
        self.trie.make_automaton()
        self.empty = not owners

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 + rank of each word in the vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def scan(self, numbers: np.ndarray) -> tuple[set[int], set[str]]:
        """Positions of the words inside matches, and the matched items."""
        hit: set[int] = set()
        found: set[str] = set()
        if not self.empty and numbers.any():
            for end, (length, of) in self.trie.iter(tuple(numbers.tolist())):
                hit.update(range(end - length + 1, end + 1))
                found.update(of)
        return hit, found


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """docs with n_words, hit and items, which add to what docs has of them."""
    more = "hit" in docs.columns
    fields = docs.schema if more else [*docs.schema.fields, *_schema(docs, _FIELDS)]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for batch in batches:
            for rows, buf, offs in slices(batch):
                low = LOWER[buf]
                starts, ends, first = words(low, offs, NOT_ALNUM)
                numbers = automaton.numbers(word_hashes(low, starts, ends))
                part = batch.slice(rows.start, rows.stop - rows.start)
                hits, found = [], []
                for k in range(part.num_rows):
                    hit, of = automaton.scan(numbers[first[k] : first[k + 1]])
                    if more:
                        hit.update(part.column("hit")[k].as_py())
                        of.update(part.column("items")[k].as_py())
                    hits.append(sorted(hit))
                    found.append(sorted(of))
                columns = {c: part.column(c) for c in part.schema.names}
                columns |= {"n_words": pa.array(np.diff(first), pa.int64()), "hit": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    schema = fields if more else type(docs.schema)(fields)
    return docs.mapInArrow(run, schema)


def _schema(docs: DataFrame, ddl: str) -> list:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).fields


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of docs (which must include text and none of the three
    names) and n_words, hit (positions of marked words, ascending), items
    (ids of the items with occurring windows, sorted as strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(-(-size // BLOCK_WORDS)))
    scanned = docs
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        scanned = _scan(scanned if k == 0 else materialize(scanned, "leaks"), [(r["item"], r["text"]) for r in block.collect()], window)
    return scanned


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (byte ranges of runs of marked
    words in the original text)."""
    found = find_leaks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                starts, ends, first = words(buf, offs, NOT_ALNUM)
                spans = []
                for k, hit in enumerate(part.column("hit")):
                    at = np.asarray(hit.values, np.int64)
                    if not len(at):
                        spans.append([])
                        continue
                    cut = np.flatnonzero(np.diff(at) > 1)
                    opens, closes = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
                    a, z = starts[first[k] + opens] - offs[k], ends[first[k] + closes] - offs[k]
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, z)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "n_words": part.column("n_words"),
                    "n_hit": pa.array(np.asarray(pa.compute.list_value_length(part.column("hit"))), pa.int64()),
                    "items": part.column("items"),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                })

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
