"""Self-join of documents on the Jaccard similarity of their word n-grams.

Documents with equal shingle sets are one class, and only its smallest member
takes part.  The classes are joined with prefix filtering:

1. How common each shingle is comes from a sketch of 2**SKETCH_BITS counters:
   every shingle is counted in one of either half, and the lesser of its two
   counters tells its level, so a rare one looks common only where it meets
   common ones twice.  The levels are broadcast, one byte each.  Every document
   sorts its shingles by level, rare ones first (ties by hash); the order steers
   the work only, results are exact for any order.
2. Two sets that reach the threshold share a shingle among the first
   n - ceil(t * n) + 1 of each.  These prefix n-grams are the join keys.
3. Candidates of a key pass the length filter (t * larger <= smaller), the
   positional filter (what is left behind the key must suffice for the overlap
   that t asks for) and the suffix filter (lower bounds on the sets' symmetric
   difference, from the sizes of 16 hash parts and the parities of 1,024).
4. Each pair is verified once, on the whole sets.

Large groups of copies of copies would give a square of pairs.  So the join
runs twice: first each key pairs its documents only in a chain, with the
smallest one of about their size, and with that of the next smaller ones;
verified links make provisional components.  Then only
keys whose documents lie in two or more components give all their pairs across
components.  A link within a component changes nothing, so the components are
exact while no group is ever expanded into all its pairs.  For the same reason
the first pass verifies one pair per document, and then only those of its pairs
that still lie across components.

A key that the sketch shows to have more than `BLOCK` documents is dealt to
several tasks in the first pass, twice by different hashes; in the second pass
such a key is dealt out in blocks of documents, pair of blocks by pair of
blocks.

Edge cases: a null or wordless text has an empty set and is linked with
nothing; a text of fewer words than n has one shingle, the whole sequence.
Rows that share a doc_id (null too) are documents of their own; rows that
repeat have equal sets and so one component.  component_id is the smallest
doc_id of a component, nulls last.  An empty table gives no rows.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import ROW, discard, keyed, materialize
from tableflow.llm.components import connected
from tableflow.llm.flat import LOWER, SPACES, mix, pack, powers, slices, unpack, word_hashes, words
from tableflow.llm.idfilter import IdFilter, id_filter

N_WORDS, PERCENT = 4, 85
#: The sketch has 2**SKETCH_BITS counters, broadcast as one byte each.
SKETCH_BITS = 22
BLOCK = 4096
PARTS = 16
#: Hash parts whose parities make a set's signature.
BITS = 1024
#: Pairs that a task compares at a time.
STRIPE = 1 << 17

_U = np.uint64
_BITS = _U(53)
_HASH = _U((1 << 53) - 1)
_BLOB = 1 << 14


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, edges, text numbers): per text its distinct shingles as 53-bit
    hashes, ascending.  A slice has at most 2**10 texts, so text number and
    hash sort as one 64-bit number."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, SPACES)
    h = word_hashes(low, starts, ends)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts), dtype=_U), counts)
    keys = np.zeros(0, _U)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, _U)
        for k in range(n):
            grams += h[k : len(h) - n + 1 + k] * powers(n + 1)[k + 1]
        whole = text[: len(grams)] == text[n - 1 :]
        keys = (mix(grams[whole]) & _HASH) | (text[: len(grams)][whole] << _BITS)
    if (short := np.flatnonzero((counts > 0) & (counts < n))).size:
        few = np.zeros(len(short), _U)
        for k in range(n - 1):
            there = counts[short] > k
            few[there] += h[first[short[there]] + k] * powers(n + 1)[k + 1]
        few = mix(few + counts[short].astype(_U) * _U(0x2545F4914F6CDD1D))
        keys = np.concatenate([keys, (few & _HASH) | (short.astype(_U) << _BITS)])
    keys.sort()
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    edges = np.searchsorted(keys, np.arange(len(counts) + 1, dtype=_U) << _BITS)
    return keys & _HASH, edges, np.repeat(np.arange(len(counts)), np.diff(edges))


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[edges[1:]] - total[edges[:-1]]


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: ROW, size, a 128-bit digest and the signature of each set;
    kind 1: blocks of the task's sketch counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            ids = batch.column(ROW)
            for rows, buf, offs in slices(batch):
                h, edges, text = shingles(buf, offs, n)
                for at in _counters(h):
                    np.add.at(counters, at, np.uint32(1))
                m = len(edges) - 1
                bits = np.bincount(text * BITS + (h >> _U(53 - 10)).astype(np.int64), minlength=m * BITS) & 1
                bits = np.packbits(bits.astype(np.uint8).reshape(m, BITS), axis=1)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.zeros(m, np.int32)),
                    ROW: ids.slice(rows.start, m),
                    "n": pa.array(np.diff(edges), pa.int64()),
                    "d1": pa.array(_per_text(mix(h + _U(1)), edges).view(np.int64)),
                    "d2": pa.array(_per_text(mix(h ^ _U(0x5851F42D4C957F2D)), edges).view(np.int64)),
                    "blob": pa.nulls(m, pa.binary()),
                    "bits": pa.array([b.tobytes() for b in bits], pa.binary()),
                })
        for k in range(0, len(counters), _BLOB):
            part = counters[k : k + _BLOB]
            if part.any():
                yield pa.RecordBatch.from_pydict({"kind": [1], ROW: [k // _BLOB], "n": [0], "d1": [0], "d2": [0], "blob": [zlib.compress(part.tobytes(), 1)], "bits": [None]}, schema=_PROFILE)

    return docs.select(ROW, "text").mapInArrow(run, f"kind int, {ROW} bigint, n bigint, d1 bigint, d2 bigint, blob binary, bits binary")


_PROFILE = pa.schema([("kind", pa.int32()), (ROW, pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("blob", pa.binary()), ("bits", pa.binary())])


def _counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sketch's first and second half the shingles are counted."""
    x, half = mix(h), 1 << (SKETCH_BITS - 1)
    return (x >> _U(64 - SKETCH_BITS + 1)).astype(np.int64), (x & _U(half - 1)).astype(np.int64) + half


def _level(counts: np.ndarray) -> np.ndarray:
    """Eight levels per doubling of a count."""
    return np.minimum(np.ceil(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


@dataclass(frozen=True)
class Order:
    """How common shingles are: the level of each counter of the sketch, and
    what stands out of the usual counter at each level."""

    levels: np.ndarray
    excess: np.ndarray

    @classmethod
    def by(cls, levels: np.ndarray) -> Order:
        usual = float(2.0 ** (np.median(levels) / 8))
        most = 2.0 ** (np.arange(256) / 8)
        # A counter holds others' counts too, give or take a few roots of them.
        return cls(levels, np.where(most >= usual + 4 * usual**0.5 + 4, most - usual, 0).astype(np.int64))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, about how many documents where that stands out, else 0)."""
        first, second = _counters(h)
        level = np.minimum(self.levels[first], self.levels[second]).astype(np.int64)
        return level, self.excess[level]


def _sketch(blobs: DataFrame) -> np.ndarray:
    """The level of each counter: 2**SKETCH_BITS bytes whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(ROW).to_pylist(), batch.column("blob")):
                part = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_pydict({ROW: [k], "blob": [_level(part).tobytes()]}, schema=pa.schema([(ROW, pa.int64()), ("blob", pa.binary())]))

    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in blobs.select(ROW, "blob").repartition(ROW).mapInArrow(add, f"{ROW} bigint, blob binary").collect():
        levels[r[ROW] * _BLOB : (r[ROW] + 1) * _BLOB] = np.frombuffer(r["blob"], np.uint8)
    return levels


def _overlap(both: np.ndarray, percent: int) -> np.ndarray:
    """Least common shingles of two sets of `both` shingles in all."""
    return -(-percent * both // (100 + percent))


def _prefixes(docs: DataFrame, order, n: int, percent: int, only: IdFilter | None = None, skip: IdFilter | None = None) -> DataFrame:
    """token, salt, pos, n, parts, ROW of every prefix n-gram of the documents
    that the filters let through.  Keys of more than `BLOCK` documents come
    twice, with salts above and below 0; others once, with salt 0."""
    spark = docs.sparkSession.sparkContext
    only_, skip_ = (f and spark.broadcast(f) for f in (only, skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = order.value
        for batch in batches:
            ids = batch.column(ROW).to_numpy(zero_copy_only=False)
            ok = np.ones(len(ids), bool)
            if only_:
                ok &= only_.value.maybe(ids)
            if skip_:
                ok &= ~skip_.value.maybe(ids)
            if not ok.all():
                ids, batch = ids[ok], batch.filter(pa.array(ok))
            for rows, buf, offs in slices(batch):
                h, edges, text = shingles(buf, offs, n)
                if not len(h):
                    continue
                sizes = np.diff(edges)
                parts = np.bincount(text * PARTS + (h & _U(PARTS - 1)).astype(np.int64), minlength=len(sizes) * PARTS)
                parts = np.minimum(parts, 255).astype(np.uint8).reshape(-1, PARTS)
                level, counts = common.of(h)
                # Text, level, hash: 11, 8 and 45 bits; sorting the numbers sorts each text rare first.
                packed = (text.astype(_U) << _BITS) | (level.astype(_U) << _U(45)) | (h >> _U(8))
                sort = np.argsort(packed)
                packed, counts = packed[sort], counts[sort]
                length = sizes - -(-percent * sizes // 100) + 1
                length[sizes == 0] = 0
                take = np.repeat(edges[:-1], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
                of = np.repeat(np.arange(len(sizes)), length)
                salts = -(-counts[take] // BLOCK)
                salted = salts > 1
                mine = ids[rows][of].astype(np.int64)
                deal = lambda k: (mix(mine.view(_U) + _U(k)) % np.maximum(salts, 1).astype(_U)).astype(np.int64)
                for salt, here in ((np.where(salted, 1 + deal(1), 0), slice(None)), (-1 - deal(2), salted)):
                    at, whose = take[here], of[here]
                    if len(at):
                        yield pa.RecordBatch.from_pydict({
                            "token": pa.array((packed[at] & _HASH).astype(np.int64)),
                            "salt": pa.array(salt[here].astype(np.int32)),
                            "pos": pa.array((at - edges[:-1][whose]).astype(np.int32)),
                            "n": pa.array(sizes[whose].astype(np.int32)),
                            "parts": pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(whose), [None, pa.py_buffer(parts[whose].tobytes())]).cast(pa.binary()),
                            ROW: pa.array(mine[here], pa.int64()),
                        })

    return docs.select(ROW, "text").mapInArrow(run, f"token bigint, salt int, pos int, n int, parts binary, {ROW} bigint")


def _passes(a: np.ndarray, b: np.ndarray, x: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which candidate pairs (indexes into x's arrays) pass the filters."""
    na, nb = x["n"][a], x["n"][b]
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    need = _overlap(na + nb, percent)
    ok &= np.minimum(na - x["pos"][a], nb - x["pos"][b]) + np.minimum(x["pos"][a], x["pos"][b]) >= need
    at = np.flatnonzero(ok)
    apart = np.abs(x["parts"][a[at]].astype(np.int32) - x["parts"][b[at]]).sum(1)
    ok[at] = apart <= na[at] + nb[at] - 2 * need[at]
    if "bits" in x:  # parts of odd parity in one set only hold a difference each
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            odd = np.bitwise_count(x["bits"][a[some]] ^ x["bits"][b[some]]).sum(1, dtype=np.int64)
            ok[some] = odd <= na[some] + nb[some] - 2 * need[some]
    return ok


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    blobs = {c: t for c, t in (("parts", np.uint8), ("bits", np.uint64)) if c in batch.schema.names}
    x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in blobs}
    x = {c: v.astype(np.int64) if v.dtype == np.int32 else v for c, v in x.items()}
    return x | {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(batch.num_rows, -1) for c, t in blobs.items()}


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())], schema=_PAIR)


def _neighbours(entries: DataFrame, percent: int) -> DataFrame:
    """kind 0: pairs (a, b) of each key's chain, by size class and ROW, with
    the class's smallest ROW, and of that with the next smaller class's;
    kind 1: the entries that the second pass may ask for (of keys with three
    documents or more, or dealt out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ("token", "salt")):
            x = _columns(part)
            index = np.arange(part.num_rows)
            size = np.frexp(x["n"])[1]  # classes of sizes within a factor of two
            new = np.ones(part.num_rows, bool)
            new[1:] = (x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
            step = new.copy()
            step[1:] |= size[1:] != size[:-1]
            hub = np.maximum.accumulate(np.where(step, index, 0))
            chain = np.flatnonzero(~new)
            to_hub = np.flatnonzero(hub < index - 1)
            to_next = np.flatnonzero(step & ~new)
            left = np.concatenate([chain - 1, hub[to_hub], hub[to_next - 1]])
            right = np.concatenate([chain, to_hub, to_next])
            ok = _passes(left, right, x, percent) & (x[ROW][left] != x[ROW][right])
            pairs = np.unique(np.sort(np.stack([x[ROW][left[ok]], x[ROW][right[ok]]], axis=1), axis=1), axis=0)
            n = len(pairs)
            if n:
                none = {c: pa.nulls(n, t) for c, t in (("token", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("parts", pa.binary()), (ROW, pa.int64()))}
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(n, np.int32)), "a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), **none}, schema=_FOUND)
            group = np.cumsum(new) - 1
            members = np.bincount(group)[group]
            keep = pa.array((x["salt"] > 0) | ((x["salt"] == 0) & (members > 2)))
            rest = part.filter(keep)
            n = rest.num_rows
            if n:
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(n, np.int32)), "a": pa.nulls(n, pa.int64()), "b": pa.nulls(n, pa.int64()), **{c: rest.column(c) for c in ("token", "pos", "n", "parts", ROW)}}, schema=_FOUND)

    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", F.length(F.bin("n")), ROW)
    return dealt.mapInArrow(run, f"kind int, a bigint, b bigint, token bigint, pos int, n int, parts binary, {ROW} bigint")


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("parts", pa.binary()), (ROW, pa.int64())])


def _close(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs that the parities of their sets leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            odd = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(odd <= na + nb - 2 * _overlap(na + nb, percent)))

    for c in "ab":
        own = signatures.select(F.col(ROW).alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
        pairs = pairs.join(own, c)
    return pairs.mapInArrow(run, "a bigint, b bigint")


def _across(dealt: DataFrame, percent: int) -> DataFrame:
    """All pairs across components of each (token, block pair); the rows come
    grouped, and side says which block of the pair a row is of."""

    def keep(x: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        # Side 2: the pair is a block with itself.
        ok = (x["component"][left] != x["component"][right]) & ((x["side"][left] == 2) | (x["side"][left] != x["side"][right]))
        left, right = left[ok], right[ok]
        ok = _passes(left, right, x, percent)
        return _pairs(x[ROW][left[ok]], x[ROW][right[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ("token", "i", "j")):
            x = _columns(part)
            new = np.ones(part.num_rows, bool)
            new[1:] = (x["token"][1:] != x["token"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])
            group = np.cumsum(new)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, part.num_rows))
            # Small groups all at once, row by row against the d-th next one.
            small = size[group - 1] <= 64
            for d in range(1, int(size[size <= 64].max(initial=0))):
                left = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
                yield keep(x, left, left + d)
            # Large ones by themselves, a stripe at a time.
            for begin, n in zip(at[size > 64].tolist(), size[size > 64].tolist()):
                wide = max(1, STRIPE // n)
                for k in range(begin, begin + n, wide):
                    stripe = np.arange(k, min(k + wide, begin + n))
                    left = np.repeat(stripe, begin + n - stripe - 1)
                    right = np.concatenate([np.arange(i + 1, begin + n) for i in stripe.tolist()])
                    yield keep(x, left, right)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that rows of equal keys are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        goes_on = bool(held) and all(held[-1].column(c)[-1].as_py() == int(v) for c, v in zip(keys, key[:, 0]))
        if held and not goes_on:
            yield _one(held)
            held = []
        if len(cuts):
            yield _one([*held, batch.slice(0, int(cuts[-1]))])
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """ROW and its shingle hashes, packed, of the ids' rows; where the filter is
    sharp, of a few others too, which no pair asks for."""
    ours = id_filter(ids)
    wanted = docs.sparkSession.sparkContext.broadcast(ours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = wanted.value.maybe(batch.column(ROW).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            keys = batch.column(ROW)
            for rows, buf, offs in slices(batch):
                h, edges, _ = shingles(buf, offs, n)
                sets = [pack(h[a:z]) for a, z in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_pydict({ROW: keys.slice(rows.start, len(sets)), "set": pa.array(sets, pa.binary())})

    sets = docs.select(ROW, "text").mapInArrow(run, f"{ROW} bigint, set binary")
    return sets if ours.sharp else sets.join(ids, ROW, "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias(ROW)).distinct(), "needed")
    sets = materialize(_sets(docs, needed, n), "sets", 1024)
    both = pairs.join(sets.select(F.col(ROW).alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col(ROW).alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = unpack(sa), unpack(sb)
                every = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(every[1:] == every[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.mapInArrow(run, "a bigint, b bigint"), "links", 512)
    discard(sets, needed)
    return links


def _across_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components of `found`."""
    for c in "ab":
        pairs = pairs.join(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _representatives(of: DataFrame, docs: DataFrame, order, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the prefix n-grams of one document per class, ROW and class of the
    other members).  Texts are read where they lie: a filter of the copies says
    which documents surely are none, and those that it may be wrong about are
    read once more."""
    heads = of.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(ROW).alias("class"), F.count("*").alias("members")).where("members > 1")
    heads = materialize(heads, "classes")  # so that the join may split a large class
    copies = materialize(of.join(heads, ["n", "d1", "d2"]).where(F.col(ROW) != F.col("class")).select(ROW, "class"), "copies")
    if copies.isEmpty():
        return _prefixes(docs, order, n, percent), copies
    those = id_filter(copies)
    shared = docs.sparkSession.sparkContext.broadcast(those)

    def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.maybe(batch.column(ROW).to_numpy(zero_copy_only=False))))

    wrong = of.where("n > 0").select(ROW).join(copies, ROW, "left_anti").mapInArrow(mistaken, f"{ROW} bigint")
    wrong = materialize(wrong, "mistaken")
    entries = _prefixes(docs, order, n, percent, skip=those)
    if not wrong.isEmpty():
        entries = entries.union(_prefixes(docs, order, n, percent, only=id_filter(wrong)).join(wrong, ROW, "left_semi").select(*entries.columns))
    return entries, copies


def jaccard_components(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """ROW, n_shingles, component (smallest ROW reachable by links) of docs,
    which has the unique key ROW and text."""
    spark = docs.sparkSession
    profile = materialize(_profile(docs, n), "shingle-profiles", 2048)
    of = profile.where("kind = 0").select(ROW, "n", "d1", "d2")
    signatures = profile.where("kind = 0").select(ROW, "n", "bits")
    order = spark.sparkContext.broadcast(Order.by(_sketch(profile.where("kind = 1"))))

    # Copies merge before the shuffle's groups are looked at: one row per class.
    entries, copies = _representatives(of, docs, order, n, percent)
    found = materialize(_neighbours(entries, percent), "prefix-matches", 4096)
    near = materialize(_close(found.where("kind = 0").select("a", "b").distinct(), signatures, percent), "candidates")

    # One pair per document, then what is still apart.
    first = materialize(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "candidates")
    links = _verify(first, docs, n, percent)
    parts = connected(links)
    rest = materialize(_across_components(near.join(first, ["a", "b"], "left_anti"), parts), "candidates")
    discard(first)
    if not rest.isEmpty():
        links = links.union(_verify(rest, docs, n, percent))
        parts = connected(links)
    discard(rest)

    # Second pass: keys that still span components, and only across them.  A
    # key of two documents had its only pair in the first pass.
    shared = found.where("kind = 1").select("token", "pos", "n", "parts", ROW)
    placed = shared.join(parts.select(F.col("id").alias(ROW), "component"), ROW, "left").withColumn("component", F.coalesce("component", ROW))
    placed = materialize(placed, "placed-prefixes")
    discard(found)
    open_keys = placed.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    open_keys = materialize(open_keys, "open-keys")
    spread = placed.join(open_keys, "token").withColumn("own", F.pmod(F.xxhash64(ROW), F.col("blocks")).cast("int"))
    spread = spread.join(signatures.select(ROW, "bits"), ROW)
    dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "pos",
        "n",
        "parts",
        ROW,
        "component",
        "bits",
    )
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    # A key's own block pair (i, i) has side 2 only; each further pair sides 0
    # and 1.  What the first pass has verified is not verified again.
    rest = materialize(_across(dealt, percent).join(near, ["a", "b"], "left_anti"), "candidates")
    discard(placed, open_keys, near)
    if not rest.isEmpty():
        links = links.union(_verify(rest, docs, n, percent))
        parts = connected(links)

    final = of.join(copies, ROW, "left").select(ROW, F.col("n").alias("n_shingles"), F.coalesce("class", ROW).alias("class"))
    return final.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").select(ROW, "n_shingles", F.coalesce("component", "class").alias("component"))


def jaccard_join(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = keyed(docs, "text")
    parts = jaccard_components(rows, n, percent)
    ids = rows.select(ROW, "doc_id")
    named = parts.join(ids, ROW)
    heads = ids.select(F.col(ROW).alias("component"), F.col("doc_id").alias("component_id"))
    return named.join(heads, "component").select("doc_id", "n_shingles", "component_id")
