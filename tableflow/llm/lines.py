"""Substring dedup by hashing lines or sentences.

A text is cut into units: its lines, or (`unit="sentence"`) its lines cut
further after words that close with . ! or ? and behind the full stops and
marks of scripts that put no space there, or (`unit="all"`) its sentences, its
lines and its paragraphs (parted by blank lines) side by side, a range that is
two of them once.  A unit is normalised to its words, A-Z in lower case, and
digested to 128 bits.  Of every digest that occurs more than once among the
units of at least `min_words` words (or `min_bytes` bytes in words, if given),
the earliest (document order, then place in the document) stays and the rest
go; of units within one another that go, the outermost counts.  A removed unit
takes the white space behind it along, up to the next unit; its byte offsets in
the original text are kept.

In `unit="all"` a paragraph or line is caught as one where its sentences are too
short by themselves, and `min_bytes` keeps units of scripts without spaces,
whose lines are one or a few words.

With `passage_words`, passages of so many words that stand in two documents are
found too where no unit of theirs repeats: of all windows of half as many words
a sample that any such passage holds a part of (each neighbourhood's least
digest, so the same ones wherever the passage stands) is counted like the units.
A chosen window that an earlier document has goes; up to half of `passage_words`
at either end of a passage may stay, what lies between goes.  Repeats within one
document are left to the units.

Digests are counted with map-side combining; only the few repeated ones are
joined back to the units, in a join that can be split, so a line that a third
of all documents share lands in no single task.  Of the windows, those with at
least the share `WINDOW_SHARE` of all (at most 1 / WINDOW_SHARE digests) are
broadcast instead: what a document has of them in a row is one range at once.

Edge cases: a null or wordless text has no units and stays as it is (null
stays null).  Rows that share a doc_id (null too) are ordered by their text;
of rows that repeat in full one counts as the earlier.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import ROW, keyed, materialize
from tableflow.llm.flat import LOWER, SPACES, mix, powers, slices, word_hashes, words

MIN_WORDS = 5
#: As long as five usual words (of 4.8 letters); 8 Chinese characters.
MIN_BYTES = 24
#: What the query and the pipeline take for their units: shorter ones repeat in
#: texts that have nothing else in common.
LONG_WORDS, LONG_BYTES = 15, 100
#: Passages as long as this are found whatever their units.
PASSAGE_WORDS = 51
#: Windows with this share of all are looked up where they lie.
WINDOW_SHARE = 1e-5

_U = np.uint64
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord("."), ord("!"), ord("?")]] = True


#: Marks behind which a sentence ends without a space, as UTF-8.
_MARKS = [m.encode() for m in "\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4"]


def _closings(buf: np.ndarray) -> np.ndarray:
    """Which bytes are the last ones of a mark."""
    last = np.zeros(len(buf), bool)
    for mark in _MARKS:
        k = len(mark)
        if len(buf) >= k:
            here = buf[k - 1 :] == mark[-1]
            for i in range(k - 1):
                here &= buf[i : len(buf) - k + 1 + i] == mark[i]
            last[k - 1 :] |= here
    return last


def _words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first number of the words, and which bytes
    close a sentence by a mark."""
    starts, ends, first = words(low, offs, SPACES)
    closing = _closings(low)
    if len(starts) and closing.any():  # words are parted behind marks
        parts = np.flatnonzero(closing) + 1
        of = np.searchsorted(starts, parts, "right") - 1
        parts = parts[(parts > starts[of]) & (parts < ends[of])]
        starts, ends = (np.sort(np.concatenate([x, parts])) for x in (starts, ends))
        first = np.searchsorted(starts, offs)
    return starts, ends, first, closing


def _digests(h: np.ndarray, head: np.ndarray, tail: np.ndarray, salts: tuple[int, int]) -> list[np.ndarray]:
    """128 bits of the words of each range, in two numbers."""
    n, found = len(h), []
    for salt in salts:
        sums = np.zeros(n + 1, _U)
        np.cumsum((mix(h ^ _U(salt)) | _U(1)) * powers(n), out=sums[1:])
        found.append(mix((sums[tail] - sums[head]) * powers(n, inverse=True)[head] + (tail - head).astype(_U)).view(np.int64))
    return found


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values, done = best(values[:-step], values[step:]), done + step
    return values


def _cut(buf: np.ndarray, offs: np.ndarray, unit: str) -> dict[str, np.ndarray]:
    """Per unit: its text's number, place in it (in words), byte range up to the
    next unit, words, bytes in words, and a 128-bit digest in two numbers."""
    low = LOWER[buf]
    starts, ends, first, closing = _words(low, offs)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "at", "start", "end", "words", "bytes", "d1", "d2")}
    lines = np.cumsum(low == 0x0A)
    breaks = lines[starts[1:]] - lines[ends[:-1] - 1]
    closed = _SENTENCE_END[low[ends[:-1] - 1]] | closing[ends[:-1] - 1]
    heads, tails, below = [], [], None
    for level in {"line": ["line"], "sentence": ["sentence"], "all": ["sentence", "line", "paragraph"]}[unit]:
        opens = np.ones(n, bool)
        opens[1:] = breaks > (level == "paragraph")
        if level == "sentence":
            opens[1:] |= closed
        opens[first[:-1][first[:-1] < n]] = True
        head = np.flatnonzero(opens)
        tail = np.append(head[1:], n)
        # A range that is a unit of the level below too is in already.
        new = np.ones(len(head), bool) if below is None else below[1][np.searchsorted(below[0], head)] != tail
        heads.append(head[new])
        tails.append(tail[new])
        below = head, tail
    head, tail = np.concatenate(heads), np.concatenate(tails)
    digests = _digests(word_hashes(low, starts, ends), head, tail, (0, 0x5851F42D4C957F2D))
    text = np.searchsorted(first, head, "right") - 1
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    end = np.append(starts, len(low))[tail]
    last = tail == first[text + 1]
    end[last] = offs[text[last] + 1]
    return {"text": text, "at": head - first[text], "start": starts[head] - offs[text], "end": end - offs[text], "words": tail - head, "bytes": size[tail] - size[head], "d1": digests[0], "d2": digests[1]}


def units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, min_bytes: int | None = None) -> DataFrame:
    """ROW, at, start, end, d1, d2 of every unit of min_words words or more (or
    of min_bytes bytes); docs has ROW and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ROW).to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch):
                u = _cut(buf, offs, unit)
                long = u["words"] >= min_words
                keep = np.flatnonzero(long if min_bytes is None else long | (u["bytes"] >= min_bytes))
                yield pa.RecordBatch.from_pydict({
                    ROW: pa.array(ids[rows][u["text"][keep]], pa.int64()),
                    "at": pa.array(u["at"][keep], pa.int32()),
                    "start": pa.array(u["start"][keep], pa.int32()),
                    "end": pa.array(u["end"][keep], pa.int32()),
                    "d1": pa.array(u["d1"][keep], pa.int64()),
                    "d2": pa.array(u["d2"][keep], pa.int64()),
                })

    return docs.select(ROW, "text").mapInArrow(run, f"{ROW} bigint, at int, start int, end int, d1 bigint, d2 bigint")


def _windows(buf: np.ndarray, offs: np.ndarray, n_words: int) -> dict[str, np.ndarray]:
    """Of the windows of half of `n_words` words those whose digest is least
    among as many neighbours: any `n_words` words in a row hold one, the same
    one wherever they stand.  Within a run of equal windows they do not overlap."""
    k = (n_words + 1) // 2
    w = n_words - k + 1
    low = LOWER[buf]
    starts, ends, first, _ = _words(low, offs)
    n = len(starts)
    none = {c: np.zeros(0, np.int64) for c in ("text", "at", "start", "end", "d1", "d2")}
    if n < n_words:
        return none
    head = np.arange(n - k + 1)
    d1, d2 = _digests(word_hashes(low, starts, ends), head, head + k, (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = d1.view(_U)
    least = _sliding(key, w, np.minimum)
    inside = text[: n - n_words + 1] == text[n_words - 1 :]
    edge = np.zeros(w - 1, _U)
    chosen = _sliding(np.concatenate([edge, np.where(inside, least, _U(0)), edge]), w, np.maximum) == key
    chosen &= text[: n - k + 1] == text[k - 1 :]
    fresh = np.ones(len(head), bool)
    fresh[1:] = (d1[1:] != d1[:-1]) | (text[1 : len(head)] != text[: len(head) - 1])
    chosen &= (head - np.maximum.accumulate(np.where(fresh, head, 0))) % k == 0
    at = np.flatnonzero(chosen)
    if not len(at):
        return none
    of = text[at]
    end = np.append(starts, len(low))[at + k]
    last = at + k == first[of + 1]
    end[last] = offs[of[last] + 1]
    return {"text": of, "at": at - first[of], "start": starts[at] - offs[of], "end": end - offs[of], "d1": d1[at], "d2": d2[at]}


def passages(docs: DataFrame, n_words: int) -> DataFrame:
    """ROW, start, end of windows that an earlier document has too: some in any
    `n_words` words that stand in both, wherever their units begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ROW).to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch):
                x = _windows(buf, offs, n_words)
                yield pa.RecordBatch.from_pydict({
                    ROW: pa.array(ids[rows][x["text"]], pa.int64()),
                    "start": pa.array(x["start"], pa.int32()),
                    "end": pa.array(x["end"], pa.int32()),
                    "d1": pa.array(x["d1"], pa.int64()),
                    "d2": pa.array(x["d2"], pa.int64()),
                })

    every = materialize(docs.select(ROW, "text").mapInArrow(run, f"{ROW} bigint, start int, end int, d1 bigint, d2 bigint"), "windows")
    firsts = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(ROW).alias("first"), F.max(ROW).alias("last")).where("first < last").select("d1", "d2", "n", "first")
    firsts = materialize(firsts, "shared-windows")
    least = WINDOW_SHARE * every.count()
    rare, common = _known(every, firsts.where(F.col("n") >= least))
    later = rare.join(firsts.where(F.col("n") < least), ["d1", "d2"]).where(F.col(ROW) != F.col("first"))
    return later.select(ROW, "start", "end").union(common)


def _known(every: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the windows that firsts does not have; ROW, start, end of those that it
    has from an earlier document, ones that overlap as one)."""
    table = firsts.toArrow().sort_by("d1")
    known = {c: table.column(c).to_numpy() for c in ("d1", "d2", "first")}
    shared = every.sparkSession.sparkContext.broadcast(known)

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(which windows are known, their first document)."""
        d1, d2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2"))
        of = shared.value
        there, first = np.zeros(len(d1), bool), np.zeros(len(d1), np.int64)
        if not len(of["d1"]):
            return there, first
        at = np.searchsorted(of["d1"], d1)
        while True:  # once, unless two known ones have the same d1
            inside = np.minimum(at, len(of["d1"]) - 1)
            same = (at < len(of["d1"])) & (of["d1"][inside] == d1) & ~there
            if not same.any():
                return there, first
            hit = same & (of["d2"][inside] == d2)
            there |= hit
            first[hit] = of["first"][inside[hit]]
            at = at + 1

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~places(batch)[0]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, first = places(batch)
            row, start, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in (ROW, "start", "end"))
            keep = there & (row != first)
            # A document's windows lie in a row, ascending; a batch's edge may part them.
            row, start, end = row[keep], start[keep], end[keep]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] >= end[:-1]) | (start[1:] < start[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_pydict({ROW: pa.array(row[at], pa.int64()), "start": pa.array(start[at], pa.int32()), "end": pa.array(end[np.append(at[1:], len(row)) - 1] if len(at) else end, pa.int32())})

    rest = every.mapInArrow(others, f"{ROW} bigint, start int, end int, d1 bigint, d2 bigint")
    return rest, every.mapInArrow(spans, f"{ROW} bigint, start int, end int")


def _merged(spans: DataFrame) -> DataFrame:
    """Each row's spans, those that overlap as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("spans")
            flat = every.flatten()
            start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            of = np.repeat(np.arange(len(every)), every.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((start, of))
            # Text numbers make the running maximum of the ends start anew.
            start, end = ((of[order] << 32) + x[order] for x in (start, end))
            reach = np.maximum.accumulate(end) if len(end) else end
            new = np.ones(len(of), bool)
            new[1:] = start[1:] >= reach[:-1]
            low = (1 << 32) - 1
            at = np.flatnonzero(new)
            a, z, of = start[at] & low, reach[np.append(at[1:], len(reach)) - 1] & low, of[order][at]
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            left = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(z, pa.int32())], fields=list(kind))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(every)))])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left)], [ROW, "spans"])

    return spans.mapInArrow(run, f"{ROW} bigint, spans array<struct<start:int,end:int>>")


def _outermost(spans: DataFrame) -> DataFrame:
    """Of each row's spans those within no other; they never cross."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("spans")
            flat = every.flatten()
            start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            of = np.repeat(np.arange(len(every)), every.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((-end, start, of))
            start, end, of = start[order], end[order], of[order]
            # Text numbers make the running maximum of the ends start anew.
            reach = np.maximum.accumulate((of << 32) + end) if len(of) else end
            keep = np.ones(len(of), bool)
            keep[1:] = (of[1:] << 32) + end[1:] > reach[:-1]
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            left = pa.StructArray.from_arrays([pa.array(start[keep], pa.int32()), pa.array(end[keep], pa.int32())], fields=list(kind))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(every)))])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left)], [ROW, "spans"])

    return spans.mapInArrow(run, f"{ROW} bigint, spans array<struct<start:int,end:int>>")


def repeats(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, min_bytes: int | None = None, passage_words: int | None = None) -> DataFrame:
    """ROW and spans (ascending byte ranges to remove), for documents with some.
    With `passage_words`, windows of passages of so many words or more that an
    earlier document has too go as well, whatever units they lie in."""
    every = materialize(units(docs, unit, min_words, min_bytes), "units")
    firsts = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct(ROW, "at")).alias("first")).where("n > 1").select("d1", "d2", "first")
    firsts = materialize(firsts, "repeated-units")
    later = every.join(firsts, ["d1", "d2"]).where(F.struct(ROW, "at") != F.col("first"))
    later = later.select(ROW, "start", "end")
    if passage_words is not None:
        later = later.union(passages(docs, passage_words))
    spans = later.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    if passage_words is not None:
        return _merged(spans)
    return _outermost(spans) if unit == "all" else spans


def remove_spans(text, spans):
    """The text without its (ascending, disjoint) byte ranges, which begin and
    end next to white space, a closing mark or a text's end."""
    raw = text.cast("binary")
    opens = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    closes = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    pieces = F.transform(F.arrays_zip(opens.alias("a"), closes.alias("z")), lambda p: F.substring(raw, p["a"] + 1, p["z"] - p["a"]).cast("string"))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def line_dedup(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, *keep: str, min_bytes: int | None = None, passage_words: int | None = None) -> DataFrame:
    """doc_id, the columns named in `keep`, text (what remains), n_removed,
    removed_bytes and spans of every document."""
    rows = keyed(docs, "text", *keep)
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = rows.join(repeats(rows, unit, min_words, min_bytes, passage_words), ROW, "left").withColumn("spans", F.coalesce("spans", none))
    return joined.select(
        "doc_id",
        *keep,
        remove_spans(F.col("text"), F.col("spans")).alias("text"),
        F.size("spans").cast("bigint").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("removed_bytes"),
        "spans",
    )
