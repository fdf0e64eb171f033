"""Dedup of 100-byte strings with a logarithmic family of indexes.

A byte is removed when a 100-byte string that covers it starts earlier too: in
a smaller document, or further ahead in its own.

Suffixes are sampled where equal strings are sampled alike: a 100-byte window's
anchor is the start of the smallest (by hash) of its 69 strings of 32 bytes,
so equal windows have equal anchors, and some one in 35 suffixes is kept.  An
anchor's entry stands for the run of windows that share it: `key` is the hash
of the anchor's 32 bytes, `class` the hash of all the bytes of the run's
windows.  Entries sorted by (key, class, document) stand in for a suffix array:
they are in the order of hashes, not of text, but equal runs are neighbours, the
earliest of a class first.

Batches are added in document order.  A batch's entries and all existing levels
are merged by key and scanned once, neighbour by neighbour: an entry whose
class came before is a long match, and all its bytes go.  The batch's new
classes become a level, and levels of equal size merge, so after b batches
there are about log2(b) of them.  Entries of one class are combined in the
tasks that make them, so a passage that a third of all documents share sends
one entry per task's batch of rows, not one per document.

Where one key has several classes (matches that end inside a run of windows),
the classes' earliest members are compared window by window after the last
batch: their bytes are fetched, grouped by key, and every window but the
earliest of its string goes.  Keys with more than `HOT` classes are counted by
(key, window) with map-side combining instead of in one group.

Spans are never stored: a document's list of matched classes is joined to its
text, and the entries are found again there.

Edge cases: a null text is empty; texts under 100 bytes keep everything.  Rows
that share a doc_id (null too) are ordered by their text; of rows that repeat
in full one counts as the earlier.  Texts of any length are cut into pieces
that overlap by 99 bytes.  An empty table gives no rows.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import ROW, discard, keyed, materialize
from tableflow.llm.flat import SLICE_ROWS, flatten, mix, parts, powers, slices

LENGTH, GRAM = 100, 32
BATCHES = 3
HOT = 20_000
PIECE_BYTES = 1 << 23

_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_NONE = np.zeros(0, np.int64)


def _sums(buf: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * powers(len(buf)), out=sums[1:])
    return sums


def _range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def _entries(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, class, start, length) of each run of windows that share an
    anchor; start is within the text, length in bytes."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    sums = _sums(buf)
    at = np.arange(n - GRAM + 1)
    grams = _range_hash(sums, at, at + GRAM)
    low = (grams & ~_PLACE) | at.astype(_U)  # by hash, then the leftmost
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[width - span : width - span + n - LENGTH + 1])
    # Windows that lie within one text.
    sizes = np.diff(offs)
    inside = np.zeros(n - LENGTH + 2, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - LENGTH + 1, -1)
    ok = np.cumsum(inside)[:-1] > 0
    opens = ok.copy()
    opens[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    begins = np.zeros(n - LENGTH + 1, bool)
    begins[offs[:-1][long]] = True
    opens |= begins
    first = np.flatnonzero(opens)
    stops = ok.copy()
    stops[:-1] &= opens[1:] | ~ok[1:]
    last = np.flatnonzero(stops)
    anchor = (low[first] & _PLACE).astype(np.int64)
    whole = _range_hash(sums, first, last + LENGTH)
    kind = mix(whole ^ mix(((last - first) << 8 | (anchor - first)).astype(_U)))
    text = np.searchsorted(offs, first, "right") - 1
    return text, grams[anchor].view(np.int64), kind.view(np.int64), first - offs[text], last - first + LENGTH


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, offset of the bytes in their text)."""
    for rows, buf, offs in slices(batch):
        if len(buf) <= PIECE_BYTES:
            yield rows.start, buf, offs, 0
        else:  # one long text
            for a in range(0, len(buf) - LENGTH + 1, PIECE_BYTES):  # windows that begin in it
                part = buf[a : a + PIECE_BYTES + LENGTH - 1]
                yield rows.start, part, np.array([0, len(part)]), a


#: Kinds of rows: candidates and new classes; matches; earliest members of
#: classes that share their key, few or many of them.
_NEW, _MATCH, _CONTESTED, _CONTESTED_HOT = 0, 1, 2, 3
_ROWS = f"kind int, key bigint, class bigint, {ROW} bigint"


def _rows_of(kind: int, key: np.ndarray, name: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key, pa.int64()), "class": pa.array(name, pa.int64()), ROW: pa.array(row, pa.int64())})


def entries(docs: DataFrame) -> DataFrame:
    """kind, key, class, ROW: the sampled suffixes of docs (ROW, text), per
    batch of rows the earliest of each class (_NEW) and the others (_MATCH)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 4 * SLICE_ROWS)):
            ids = batch.column(ROW).to_numpy(zero_copy_only=False)
            found = [(key, name, ids[row + text]) for row, buf, offs, _ in _pieces(batch) for text, key, name, *_ in [_entries(buf, offs)]]
            if not found:
                continue
            key, name, row = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((row, name, key))
            key, name, row = key[order], name[order], row[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            yield _rows_of(_NEW, key[first], name[first], row[first])
            # A class that a document has again matches within the document,
            # which the document sees by itself.
            other = ~first
            other[1:] &= row[1:] != row[:-1]
            yield _rows_of(_MATCH, key[other], name[other], row[other])

    return docs.select(ROW, "text").mapInArrow(run, _ROWS)


def _scan(merged: DataFrame) -> DataFrame:
    """Scan (key, class, ROW, level) rows sorted so, key by key.  level: the
    row is of a level, not of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, class) of the last row
        open_key, members, many = None, [], False  # the last key's earliest members so far

        for batch in batches:
            if not batch.num_rows:
                continue
            key, name, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "class", ROW))
            level = batch.column("level").to_numpy(zero_copy_only=False)
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            first[0] = last != (int(key[0]), int(name[0]))
            last = (int(key[-1]), int(name[-1]))
            yield _rows_of(_MATCH, key[~first], name[~first], row[~first])
            new = first & ~level
            yield _rows_of(_NEW, key[new], name[new], row[new])

            key, name, row = key[first], name[first], row[first]
            if not len(key):
                continue
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            head = edges[1] if open_key == int(key[0]) else 0
            if head:  # the key goes on
                members.append((key[:head], name[:head], row[:head]))
            if open_key is not None and (not head or head < len(key)):  # and is complete
                yield from _contest(members, many)
                members, many = [], False
            if head < len(key):
                tail = edges[-2]
                inner_key, inner = key[head:tail], slice(head, tail)
                if len(inner_key):
                    several = np.zeros(len(inner_key), bool)
                    same = inner_key[1:] == inner_key[:-1]
                    several[1:] |= same
                    several[:-1] |= same
                    yield _rows_of(_CONTESTED, inner_key[several], name[inner][several], row[inner][several])
                open_key, members = int(key[-1]), [(key[tail:], name[tail:], row[tail:])]
            if sum(len(m[0]) for m in members) > HOT:
                many = True
                yield from _contest(members, many)
                members = []
        if open_key is not None:
            yield from _contest(members, many)

    return merged.mapInArrow(run, _ROWS)


def _contest(members: list, many: bool) -> Iterator[pa.RecordBatch]:
    if many or sum(len(m[0]) for m in members) > 1:
        for m in members:
            yield _rows_of(_CONTESTED_HOT if many else _CONTESTED, *m)


class SuffixIndex:
    """Levels of suffix arrays; `add` batches in document order."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, classes), large ones first
        self.contested: DataFrame | None = None  # of everything added so far

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (b, younger), (a, older) = self.levels.pop(), self.levels.pop()
            # A class is in one level only, so levels merge by putting them together.
            self.levels.append((a + b, materialize(older.union(younger), "suffix-level")))
            discard(older, younger)

    def add(self, docs: DataFrame) -> DataFrame:
        """class, ROW of the batch's matches with earlier suffixes."""
        self._merge()
        own = materialize(entries(docs), "suffixes")
        names = ["key", "class", ROW]
        merged = own.where(F.col("kind") == _NEW).select(*names, F.lit(False).alias("level"))
        for _, level in self.levels:
            merged = merged.union(level.select(*names, F.lit(True).alias("level")))
        ordered = merged.repartition("key").sortWithinPartitions(*names)
        scanned = materialize(_scan(ordered), "suffix-scan")
        local = materialize(own.where(F.col("kind") == _MATCH).select("class", ROW), "suffix-matches")
        discard(own)
        self.levels.append((1, materialize(scanned.where(F.col("kind") == _NEW).select(*names), "suffix-level")))
        self.contested = scanned.where(F.col("kind") >= _CONTESTED)
        return local.union(scanned.where(F.col("kind") == _MATCH).select("class", ROW))


def _windows(key: np.ndarray, row: np.ndarray, start: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, window hash, ROW, start) of every window of some entries."""
    buf, offs = flatten(pieces)
    sums = _sums(buf)
    counts = np.diff(offs) - LENGTH + 1
    of = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offs[of] + within
    return key[of], _range_hash(sums, at, at + LENGTH).view(np.int64), row[of], start[of] + within


_SPAN = f"{ROW} bigint, start int, end int"


def _resolve(fetched: DataFrame) -> DataFrame:
    """ROW, start, end of repeated windows; the rows (key, ROW, start, bytes)
    come sorted by key."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        col = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        key, window, row, start = _windows(col("key"), col(ROW), col("start").astype(np.int64), _as_text(table.column("bytes")))
        order = np.lexsort((start, row, window, key))
        key, window, row, start = key[order], window[order], row[order], start[order]
        later = np.zeros(len(key), bool)
        later[1:] = (key[1:] == key[:-1]) & (window[1:] == window[:-1])
        row, start = row[later], start[later]
        # Windows side by side make one span.
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (start[1:] - start[:-1] > LENGTH)
        at = np.flatnonzero(opens)
        end = start[np.append(at[1:], len(row)) - 1] + LENGTH if len(at) else start[:0]
        return pa.RecordBatch.from_pydict({ROW: pa.array(row[at], pa.int64()), "start": pa.array(start[at].astype(np.int32)), "end": pa.array(end.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if held and (cut or held[-1].column("key")[0].as_py() != keys[-1]):
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield settle(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    return fetched.mapInArrow(run, _SPAN)


def _as_text(values: pa.ChunkedArray) -> pa.Array:
    """Binary values relabelled as text, for `flatten`; nothing is decoded."""
    return values.combine_chunks().cast(pa.large_binary()).view(pa.large_string())


def _resolve_hot(fetched: DataFrame) -> DataFrame:
    """The same for keys of very many classes, by (key, window) groups that
    are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                key, window, row, start = _windows(col("key"), col(ROW), col("start").astype(np.int64), _as_text(pa.chunked_array([batch.column("bytes")])))
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "window": pa.array(window, pa.int64()), ROW: pa.array(row, pa.int64()), "start": pa.array(start.astype(np.int32))})

    every = materialize(fetched.mapInArrow(run, f"key bigint, window bigint, {ROW} bigint, start int"), "hot-windows")
    firsts = every.groupBy("key", "window").agg(F.min(F.struct(ROW, "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(materialize(firsts, "hot-firsts"), ["key", "window"]).where(F.struct(ROW, "start") != F.col("first"))
    return later.select(ROW, "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def _fetch(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """key, hot, ROW, start, bytes of the contested entries."""
    wanted = contested.groupBy(ROW).agg(F.collect_list(F.when(F.col("kind") == _CONTESTED, F.col("class"))).alias("few"), F.collect_list(F.when(F.col("kind") == _CONTESTED_HOT, F.col("class"))).alias("many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            ids = batch.column(ROW).to_numpy(zero_copy_only=False)
            asked = [(np.asarray(f.values), np.asarray(m.values)) for f, m in zip(batch.column("few"), batch.column("many"))]
            for row, buf, offs, shift in _pieces(batch):
                text, key, name, start, length = _entries(buf, offs)
                edges = np.searchsorted(text, np.arange(len(offs)))
                for k in range(len(offs) - 1):
                    part = slice(edges[k], edges[k + 1])
                    for hot, names in enumerate(asked[row + k]):
                        at = part.start + np.flatnonzero(np.isin(name[part], names))
                        if len(at):
                            # Of a class that comes again in the document the first speaks.
                            at = np.sort(at[np.unique(name[at], return_index=True)[1]])
                            begin = offs[k] + start[at]
                            yield pa.RecordBatch.from_pydict({
                                "key": pa.array(key[at], pa.int64()),
                                "hot": pa.array(np.full(len(at), bool(hot))),
                                ROW: pa.array(np.full(len(at), ids[row + k]), pa.int64()),
                                "start": pa.array((start[at] + shift).astype(np.int32)),
                                "bytes": pa.array([buf[x : x + n].tobytes() for x, n in zip(begin, length[at])], pa.binary()),
                            })

    fetched = docs.select(ROW, "text").join(wanted, ROW)
    return fetched.mapInArrow(run, f"key bigint, hot boolean, {ROW} bigint, start int, bytes binary")


def repeated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """ROW, classes (of entries that match an earlier one) and spans (byte
    ranges of other repeated strings; they may overlap)."""
    cuts = docs.agg(F.percentile_approx(ROW, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    index, matches = SuffixIndex(), None
    for lo, hi in zip(edges, edges[1:]):
        part = docs if lo is None else docs.where(F.col(ROW) > lo)
        found = index.add(part if hi is None else part.where(F.col(ROW) <= hi))
        matches = found if matches is None else matches.union(found)
    discard(*[level for _, level in index.levels])
    fetched = materialize(_fetch(docs, index.contested), "contested-bytes")
    common = fetched.where(~F.col("hot")).drop("hot").repartition("key").sortWithinPartitions("key")
    spans = _resolve(common).union(_resolve_hot(fetched.where("hot").drop("hot")))
    nothing = lambda kind: F.lit(None).cast(kind)
    both = matches.select(ROW, "class", nothing("struct<start:int,end:int>").alias("span")).union(spans.select(ROW, nothing("bigint"), F.struct("start", "end")))
    return both.groupBy(ROW).agg(F.collect_list("class").alias("classes"), F.collect_list("span").alias("spans"))


def _covered(size: int, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Which of the bytes lie in any of the ranges."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, opens, 1)
    np.add.at(step, closes, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (binary) and spans, the maximal
    removed byte ranges of the text, of every document."""
    rows = keyed(docs, "text")
    joined = rows.join(repeated(rows, batches), ROW, "left").select("doc_id", "text", "classes", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            opens: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            closes: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            matched = [np.asarray(c.values) if c.is_valid else _NONE for c in batch.column("classes")]
            for row, buf, offs, shift in _pieces(batch):
                text, key, name, start, length = _entries(buf, offs)
                edges = np.searchsorted(text, np.arange(len(offs)))
                for k in range(len(offs) - 1):
                    part = slice(edges[k], edges[k + 1])
                    hit = np.isin(name[part], matched[row + k])
                    # Again in the same document, whatever others have.
                    again = np.ones(part.stop - part.start, bool)
                    again[np.unique(name[part], return_index=True)[1]] = False
                    hit |= again
                    opens[row + k].append(start[part][hit] + shift)
                    closes[row + k].append((start + length)[part][hit] + shift)
                    if shift:  # a piece further on: classes of the pieces before
                        seen = np.isin(name[part], earlier) & ~hit
                        opens[row + k].append(start[part][seen] + shift)
                        closes[row + k].append((start + length)[part][seen] + shift)
                earlier = name if not shift else np.concatenate([earlier, name])
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "kept": [], "spans": []}
            for k, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"))):
                raw = (text.as_py() or "").encode()
                more = spans.values if spans.is_valid else None
                a = [*opens[k], np.asarray(more.field("start")) if more is not None else _NONE]
                z = [*closes[k], np.asarray(more.field("end")) if more is not None else _NONE]
                gone = _covered(len(raw), np.concatenate(a).astype(np.int64), np.concatenate(z).astype(np.int64))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "kept": pa.array(out["kept"], pa.binary()),
                "spans": pa.array(out["spans"], span),
            })

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
