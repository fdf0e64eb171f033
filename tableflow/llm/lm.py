"""Language-model scoring with a weighted backoff automaton.

Text is scored as its tokens: the words [^\\x20\\x09-\\x0D]+ with A-Z in lower
case, then one end.  The automaton has these tiers of states, each failing to
the next:

- a state per two tokens in a row, with an arc per word (or end) seen behind
  them; the first token of a text is preceded by a begin;
- a state per word and for the begin, with an arc per token seen behind it;
- a state per language of the training documents (those with at least the
  share `LANGUAGE_SHARE` of their bytes, the others together as one), with an
  arc per word seen in that language (the tiers above are of all languages, and
  a branch fails from them to its own language);
- the state of all languages, with an arc per word seen at all;
- spelling states, which read a token byte by byte: a word's bytes and a space,
  or a line end for the end.  Their n-grams of up to `ORDER` bytes run on over
  word ends, so that every token, known or not, has a probability.

Each tier is smoothed after Witten and Bell: with n(ctx, x) counts, T(ctx)
distinct continuations and the shorter context ctx' it fails to,

    p(x | ctx) = (n(ctx, x) + T(ctx) * p(x | ctx')) / (n(ctx) + T(ctx)).

A text starts in every language's state, weighted by the language's share of
documents, and is read once from left to right; the branches are carried along
side by side and their probabilities added at the end.

A byte context becomes a spelling state if it has at least the share
`STATE_SHARE` of all training bytes behind it, so there are at most
ORDER / STATE_SHARE of them whatever the corpus; the counts are those of all
training documents.  Compiled, a state has its outcome for every byte: failure
arcs are followed once, when the table is made.  Tasks walk many stretches of
text in step; a stretch starts ORDER - 1 bytes early, after which its state is
the one of the whole text.

Counts of words, pairs and triples grow with the corpus.  Pairs and triples are
64-bit keys, context in the high bits and token in the low ones.  The documents
are dealt to blocks of some `BLOCK_BYTES`; tasks send a block's keys sorted, as
packed differences, to the range of keys they lie in.  There they are counted and
answered at once: each block is told the counts of the keys it sent, so a gram
takes some six bytes of shuffle, none is asked for again and none is left out.  A
gram that was seen once is its own document's: it goes into the count of its
context and into nothing else, unless a held-out document has it too.  What a
block is not told thus counts one for a training document, nothing for a held-out
one.

Words, pairs and triples with at least the share `WORD_SHARE` of all training
tokens, and contexts with as many distinct tokens behind them (at most
1 / WORD_SHARE of each kind) are broadcast, the others told block by block; a task
walks a block's documents behind the counts that came back.  Counting takes up to
`COUNT_PASSES` over the texts, each for a part of the ranges, and scoring up to
`SCORE_PASSES`, each for a part of the blocks, so that a part of what the texts
hold or are told is shuffled at a time.

Edge cases: a null or empty text is the end alone.  Rows that share a doc_id
(null too, whose checksum is the empty text's) are scored each for itself.  A
null language is a language of its own.  Without training rows every byte has
probability 1/256 and each base term is 0.  An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import ROW, crc_of_id, discard, keyed, materialize
from tableflow.llm.flat import LOWER, SPACES, lists, mix, pack, parts, plane, slices, unpack, unplane, word_hashes, words

ORDER = 6
STATE_SHARE, WORD_SHARE, LANGUAGE_SHARE = 5e-5, 1e-6, 0.02
END = 0x0A
#: Grams that a task sorts at a time; bytes of a stretch of text.
CHUNK, STRETCH = 1 << 21, 512
#: Rows of what a task gives out at a time, and of those with packed keys.
WRITTEN, PACKED = 1 << 16, 32
#: Text that a task cuts into keys, and text that it scores, at a time.
SLICE, SCORED = 1 << 17, 1 << 18
#: Text of a block, whose counts a task holds.
BLOCK_BYTES = 1 << 25
#: Keys of a range, which a task counts; low bits of a key, its token's.
RANGE_KEYS, TOKEN_BITS = 1 << 20, 24
COUNT_PASSES, SCORE_PASSES = 2, 2
#: Keys of a row of a packed table; bytes that a writer of packed rows gathers.
PIECE, ROW_GROUP = 1 << 15, 1 << 24

_U = np.uint64
_PAD = ORDER - 1
#: What stands for a text's begin and end among the word hashes.
_BEGIN, _CLOSE = _U(0x2545F4914F6CDD1D), _U(0x5851F42D4C957F2D)


def spell(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, edges, word hashes, word edges, places): the texts as the model
    reads them, each behind ORDER - 1 line ends, and where each word begins."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, SPACES)
    sizes = ends - starts + 1  # a word's bytes and its space
    total = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.concatenate([[0], np.cumsum(total[first[1:]] - total[first[:-1]] + 1 + _PAD)])
    stream = np.full(edges[-1], END, np.uint8)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    places = edges[text] + _PAD + total[:-1] - total[first[text]]
    inside = np.flatnonzero(_covered(len(buf), starts, ends))
    stream[np.repeat(places - starts, sizes - 1) + inside] = low[inside]
    stream[places + sizes - 1] = 0x20
    return stream, edges, word_hashes(low, starts, ends), first, places


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends[ends < n]] -= 1
    return np.cumsum(step[:n]).astype(bool)


def _grams(stream: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each byte of the texts, pads left out."""
    wide = stream.astype(_U)
    n = len(stream) - _PAD
    grams = np.zeros(n, _U)
    for k in range(ORDER):
        grams = grams << _U(8) | wide[k : k + n]
    keep = np.ones(n, bool)
    for k in range(1, ORDER):  # a gram that begins in one text and ends in the next one's pads
        at = edges[1:-1] - k
        keep[at[at >= 0]] = False
    return grams[keep]


_SENT = pa.schema([("range", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("ns", pa.binary())])


def _counts(docs: DataFrame, bits: int) -> DataFrame:
    """kind, key, n: kind -1 grams, else word hashes by the number of their
    language; docs has text and language.  Tasks send packed keys to the range
    that their mixed bits name."""

    def out(kind: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = _tallied(_sorted(held))
        of = (mix(keys) >> _U(64 - bits)).astype(np.uint16) if bits else np.zeros(len(keys), np.uint16)
        order = np.argsort(of, kind="stable")
        keys, n, of = keys[order], n[order], of[order]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]).tolist()
        rows = [(int(of[a]), kind, pack(keys[a:z]), plane(n[a:z].astype("<u8"))) for a, z in zip(cuts, [*cuts[1:], len(of)])]
        yield from parts(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT), PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            languages = batch.column("language").to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch, max_bytes=SLICE):
                stream, edges, hashes, first, _ = spell(buf, offs)
                held.setdefault(-1, []).append(_grams(stream, edges))
                of = np.repeat(languages[rows], np.diff(first))
                for kind in np.unique(of).tolist():
                    held.setdefault(kind, []).append(hashes[of == kind])
                sizes = {k: sum(map(len, keys)) for k, keys in held.items()}
                if sizes.pop(-1) > CHUNK:
                    yield from out(-1, held.pop(-1))
                while sum(sizes.values()) > CHUNK:  # of all languages together
                    kind = max(sizes, key=sizes.get)
                    del sizes[kind]
                    yield from out(kind, held.pop(kind))
        for kind, keys in held.items():
            yield from out(kind, keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for (_, kind), blobs in held.items():
                keys, n = _added(blobs)
                for k in range(0, len(keys), WRITTEN):
                    key = keys[k : k + WRITTEN]
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key.view(np.int64)), "n": pa.array(n[k : k + WRITTEN], pa.int64())})

        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["range"], row["kind"])
                if at not in held:  # the rows come by range and kind
                    yield from told()
                    held = {at: []}
                held[at].append((row["keys"], row["ns"]))
        yield from told()

    sent = docs.select("text", "language").mapInArrow(run, "range bigint, kind int, keys binary, ns binary")
    dealt = sent.repartition("range").sortWithinPartitions("range", "kind")
    return materialize(dealt.mapInArrow(add, "kind int, key bigint, n bigint"), "ngram-counts", 2048, large=True)


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ascending keys, and how often each is there."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def _added(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (ascending) of packed keys and counts, counts added."""
    return _summed([unpack(x) for x, _ in blobs], [unplane(x) for _, x in blobs])


def _summed(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (ascending) of these, and their counts added."""
    keys, ns = np.concatenate(held), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, ns = keys[order], ns[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(ns, at) if len(at) else ns


def sequences(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, edges, pairs, triples) of texts with these words: every text's
    words and its end, and the keys of the two and three tokens that end there.
    A key has its context's bits above its token's, and tells pairs from triples
    by its highest bit.  A text's first token has no triple (0)."""
    edges = first + np.arange(len(first))
    ends, heads = edges[1:] - 1, edges[:-1]
    inner = np.ones(edges[-1], bool)
    inner[ends] = False
    tokens = np.full(edges[-1], _CLOSE, _U)
    tokens[inner] = hashes
    before = np.roll(tokens, 1)
    before[heads] = _BEGIN
    low = tokens >> _U(64 - TOKEN_BITS)
    pairs = contexts(before, False) << _U(TOKEN_BITS) | low
    triples = contexts(np.roll(pairs, 1), True) << _U(TOKEN_BITS) | low
    triples[heads] = 0
    return tokens, edges, pairs, triples


def contexts(of: np.ndarray, pair: bool) -> np.ndarray:
    """The context bits of keys behind these tokens (or pairs)."""
    h = mix(mix(of + _U(2 if pair else 1)) + _U(0x9E3779B97F4A7C15)) >> _U(TOKEN_BITS + 1)
    return h | _U(1 << (63 - TOKEN_BITS)) if pair else h


def _grams_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs and triples, their text's numbers) of texts."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, SPACES)
    _, edges, pairs, triples = sequences(word_hashes(low, starts, ends), first)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(edges))
    later = np.ones(len(pairs), bool)
    later[edges[:-1]] = False
    return np.concatenate([pairs, triples[later]]), np.concatenate([text, text[later]])


def _ranged(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, where its keys are) of ascending keys."""
    first = np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)
    edges = np.append(np.searchsorted(keys, first), len(keys)).tolist()
    for k in range(1 << bits):
        if edges[k] < edges[k + 1]:
            yield k, slice(edges[k], edges[k + 1])


def _sorted(held: list[np.ndarray]) -> np.ndarray:
    """What is held, ascending; it is held no more."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    return keys


_SENT_BY = pa.schema([("range", pa.int64()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ns", pa.binary())])


def _sent(docs: DataFrame, bits: int, k: int, passes: int) -> DataFrame:
    """range, block, kind, keys, ns: each block's keys of one pass's ranges,
    packed; kind 0 what training documents have, with how often; kind 1 what
    held-out documents ask for."""

    def out(block: int, kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, rows = _sorted(held), []
        for r, at in _ranged(keys, bits):  # range by range: the copies stay small
            own, ns = _tallied(keys[at])
            rows.append((r, block, kind, pack(own), plane(ns.astype("<u8")) if kind == 0 else b""))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT_BY)], schema=_SENT_BY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            asks, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("held_out", "block"))
            for rows, buf, offs in slices(batch, max_bytes=SLICE):
                keys, text = _grams_of(buf, offs)
                if passes > 1:
                    mine = np.flatnonzero((keys >> _U(64 - bits)) % _U(passes) == _U(k))
                    keys, text = keys[mine], text[mine]
                of = blocks[rows].astype(np.int64) * 2 + asks[rows]
                here = np.unique(of).tolist()
                group = of[text]
                for own in here:
                    mine = keys if len(here) == 1 else keys[group == own]
                    if len(mine):
                        waiting.setdefault(divmod(own, 2), []).append(mine)
                sizes = {at: sum(map(len, held)) for at, held in waiting.items()}
                while sum(sizes.values()) > CHUNK:  # of all blocks of the task together
                    at = max(sizes, key=sizes.get)
                    del sizes[at]
                    yield from parts(out(*at, waiting.pop(at)), PACKED)
        for at, held in waiting.items():
            yield from parts(out(*at, held), PACKED)

    return docs.select("held_out", "block", "text").repartition("block").mapInArrow(run, "range bigint, block int, kind int, keys binary, ns binary")


_COUNTED = pa.schema([("range", pa.int64()), ("block", pa.int32()), ("context", pa.bool_()), ("keys", pa.binary()), ("ns", pa.binary())])


def _counted(sent: DataFrame, least: float) -> DataFrame:
    """range, block, context, keys, ns, packed in pieces.  Grams (context false)
    seen twice or asked for, with how often; contexts (context true) with two or
    more distinct tokens behind them, with their number.  Block -1 has those with
    `least` or more and the contexts that are words, every other block those of
    the rest that are in its documents.  All of a context's grams are in its range."""

    def emit(span: int, sent: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        trained = [row for row in sent if row[1] == 0]
        if not trained:
            return
        keys, ns = _summed([row[2] for row in trained], [row[3] for row in trained])
        keep = ns > 1
        asked = [row[2] for row in sent if row[1] == 1]
        if asked:
            at = np.concatenate(asked)
            spot = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            keep[spot[keys[spot] == at]] = True
        of, kinds = _tallied(keys >> _U(TOKEN_BITS))
        many = kinds > 1
        rest, rows = [], []

        def told(block: int, context: bool, key: np.ndarray, n: np.ndarray) -> None:
            for a in range(0, len(key), PIECE):
                rows.append((span, block, context, pack(key[a : a + PIECE]), plane(n[a : a + PIECE].astype("<u8"))))

        for context, key, n, every in ((False, keys[keep], ns[keep], ns[keep] >= least), (True, of[many], kinds[many], (kinds[many] >= least) | (of[many] >> _U(63 - TOKEN_BITS) == 0))):
            told(-1, context, key[every], n[every])
            rest.append(Table(key[~every], n[~every]))
        if any(len(table.keys) for table in rest):
            for block in sorted({row[0] for row in sent}):
                own = _sorted([row[2] for row in sent if row[0] == block])
                own, _ = _tallied(own)
                heads, _ = _tallied(own[np.searchsorted(own, _U(1 << 63)) :] >> _U(TOKEN_BITS))
                for context, mine in ((False, own), (True, heads)):
                    at, there = rest[context].find(mine)
                    told(block, context, mine[there], rest[context].n[at[there]])
        if rows:
            yield from parts(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED), PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != now:
                    yield from emit(now, held)
                    now, held = row["range"], []
                held.append((row["block"], row["kind"], unpack(row["keys"]), unplane(row["ns"]).astype(np.uint32)))
        yield from emit(now, held)

    dealt = sent.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "range bigint, block int, context boolean, keys binary, ns binary")


def _word_grams(docs: DataFrame, bits: int, least: float = 0) -> DataFrame:
    """The packed pairs, triples and contexts that the blocks and all are told
    (as of _counted); docs has held_out, text and, unless all are told
    everything, block."""
    every, passes = None, min(COUNT_PASSES, 1 << bits)
    docs = docs if "block" in docs.columns else docs.withColumn("block", F.lit(0))
    for k in range(passes):
        part = materialize(_counted(_sent(docs, bits, k, passes), least), "word-grams", 256, ROW_GROUP, large=True)
        every = part if every is None else every.union(part)
    return every


def _told(tables: DataFrame, context: bool, keep=None) -> DataFrame:
    """key, n: those grams (or contexts) that all are told, or of them those
    that `keep(keys)` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, ns = unpack(row["keys"]), unplane(row["ns"]).astype(np.int64)
                mine = keep(keys) if keep else np.ones(len(keys), bool)
                if mine.any():
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys[mine].view(np.int64)), "n": pa.array(ns[mine], pa.int64())})

    wanted = tables.where("block < 0").where("context" if context else "not context").select("keys", "ns")
    return materialize(wanted.mapInArrow(run, "key bigint, n bigint"), "told-grams", 256)


def _with_context(words_of: DataFrame) -> DataFrame:
    """words_of with the context that each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = contexts(batch.column("key").to_numpy().view(_U), False)
            yield batch.append_column("context", pa.array(of.view(np.int64)))

    return words_of.mapInArrow(run, "key bigint, n array<bigint>, context bigint")


@dataclass(frozen=True)
class Automaton:
    """Compiled: for each state and byte class the next state and log10 weight."""

    classes: np.ndarray  # of each byte
    width: int
    step: np.ndarray  # int32, states * width
    weight: np.ndarray  # float32, states * width

    def walk(self, stream: np.ndarray) -> np.ndarray:
        """log10 weight of every byte, read after the bytes before it."""
        lanes = max(1, -(-len(stream) // STRETCH))
        padded = np.full(_PAD + lanes * STRETCH, END, np.uint8)
        padded[_PAD : _PAD + len(stream)] = stream
        kinds = self.classes[padded]
        views = np.lib.stride_tricks.as_strided(kinds, (lanes, _PAD + STRETCH), (kinds.strides[0] * STRETCH, kinds.strides[0]))
        columns = np.ascontiguousarray(views.T)
        out = np.empty((STRETCH, lanes), np.float32)
        state = np.zeros(lanes, np.int64)
        for t in range(_PAD + STRETCH):
            at = state * self.width + columns[t]
            if t >= _PAD:
                out[t - _PAD] = self.weight[at]
            state = self.step[at].astype(np.int64)
        return np.ascontiguousarray(out.T).reshape(-1)[: len(stream)]


def compile_automaton(arcs: list[np.ndarray], counts: list[np.ndarray]) -> Automaton:
    """arcs[m]: the seen (context of m bytes, byte) pairs of the states, packed
    as one number each and sorted; counts[m]: how often each was seen."""
    seen = np.unique(np.concatenate([a & _U(0xFF) for a in arcs])).astype(np.int64)
    classes = np.full(256, len(seen), np.int64)  # all unseen bytes are one class
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    contexts = [np.unique(a >> _U(8)) for a in arcs]
    if not len(contexts[0]):
        return Automaton(classes, width, np.zeros(width, np.int32), np.full(width, -np.log10(256), np.float32))
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    step = np.zeros((base[-1], width), np.int32)
    weight = np.zeros((base[-1], width))
    for m, (arc, n, context) in enumerate(zip(arcs, counts, contexts)):
        own = np.zeros((len(context), width))
        own[np.searchsorted(context, arc >> _U(8)), classes[(arc & _U(0xFF)).astype(np.int64)]] = n
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        # The failure arc's target: the context without its first byte.
        shorter = context & _U((1 << 8 * max(0, m - 1)) - 1)
        fail = base[m - 1] + np.searchsorted(contexts[m - 1], shorter) if m else None
        lower = weight[fail] if m else 1 / 256
        rows = slice(base[m], base[m + 1])
        weight[rows] = (own + kinds * lower) / (total + kinds)
        if m:
            step[rows] = step[fail]
    # A byte leads to the longest state that ends with it; deeper ones last.
    for m, context in enumerate(contexts[:-1]):
        for c, byte in enumerate(seen.tolist()):
            longer = (context << _U(8)) | _U(byte)
            at = np.minimum(np.searchsorted(contexts[m + 1], longer), len(contexts[m + 1]) - 1) if len(contexts[m + 1]) else None
            if at is not None:
                there = contexts[m + 1][at] == longer
                step[base[m] + np.flatnonzero(there), c] = base[m + 1] + at[there]
        # States one byte deeper fail to these: what they do not have, they take from them.
        if m + 1 < len(contexts) and len(contexts[m + 1]):
            shorter = contexts[m + 1] & _U((1 << 8 * m) - 1)
            step[base[m + 1] : base[m + 2]] = step[base[m] + np.searchsorted(context, shorter)]
    return Automaton(classes, width, step.reshape(-1), np.log10(weight).astype(np.float32).reshape(-1))


def automaton(counts: DataFrame, share: float = STATE_SHARE) -> Automaton:
    """The automaton of the counted grams.  What comes to the driver is the
    arcs of at most ORDER / share states."""
    grams = counts.where("kind = -1").select("key", "n")
    total = grams.agg(F.sum("n")).first()[0] or 0
    arcs, ns = [], []
    for m in range(ORDER):
        mask = (1 << 8 * (m + 1)) - 1
        of = grams.groupBy(F.col("key").bitwiseAND(mask).alias("arc")).agg(F.sum("n").alias("n"))
        every = None
        if m:
            of = every = materialize(of, "arcs")
            common = of.groupBy(F.shiftright("arc", 8).alias("context")).agg(F.sum("n").alias("seen")).where(F.col("seen") >= share * total).select("context")
            of = of.join(common, F.shiftright(of["arc"], 8) == F.col("context"), "left_semi")
        found = of.select("arc", "n").toArrow().sort_by("arc")
        if every is not None:
            discard(every)
        arcs.append(found.column("arc").to_numpy().astype(_U))
        ns.append(found.column("n").to_numpy())
    return compile_automaton(arcs, ns)


@dataclass(frozen=True)
class Table:
    """Keys (ascending) and their numbers: how often seen, or how many distinct
    tokens are behind; for words by language, and then the latter."""

    keys: np.ndarray
    n: np.ndarray  # keys, or keys x columns

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], n[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which of them are in the table)."""
        if (keys[1:] < keys[:-1]).any():  # in order, neighbours look in the same place
            order = np.argsort(keys)
            at, there = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
            at[order], there[order] = self.find(keys[order])
            return at, there
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def put(self, keys: np.ndarray, into: np.ndarray) -> None:
        """The numbers of the keys that are in the table."""
        at, there = self.find(keys)
        into[there] = self.n[at[there]]


@dataclass(frozen=True)
class Words:
    """Token counts by language (one row each), the common words and the common
    pairs and triples."""

    ends: np.ndarray  # training documents
    tokens: np.ndarray
    distinct: np.ndarray  # the end included, if there is one
    all_distinct: int
    begins: int  # distinct first tokens
    words: Table
    grams: Table
    behind: Table  # distinct tokens behind pairs that have many, by context

    @property
    def all_tokens(self) -> int:
        return int(self.tokens.sum())

    def parts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of p(token | language) = a + b * spelling, tokens x languages."""
        t = self.all_distinct
        a = (counts.sum(1) / (self.all_tokens + t) if t else np.zeros(len(counts)))[:, None]
        b = t / (self.all_tokens + t) if t else 1.0
        total = self.tokens + self.distinct
        some = np.maximum(total, 1)
        return np.where(total > 0, (counts + self.distinct * a) / some, a), np.where(total > 0, self.distinct * b / some, b) * np.ones_like(a)


def backed(a: np.ndarray, b: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One tier up: a and b of states seen `total` times with `kinds` distinct
    arcs, of which this one n times; a state never seen fails for nothing."""
    whole = np.maximum(total + kinds, 1)[:, None]
    known = (total > 0)[:, None]
    return np.where(known, (n[:, None] + kinds[:, None] * a) / whole, a), np.where(known, kinds[:, None] * b / whole, b)


def word_counts(words_of: DataFrame, tables: DataFrame, begins: int | None, ends: list[int], share: float) -> Words:
    """words_of: key, n (an array, by language), t; tables: as of _word_grams;
    begins: distinct first tokens, if there are several."""
    size = len(ends)
    sums = words_of.agg(*[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)).alias(f"n{k}") for k in range(size)], *[F.count(F.when(F.col("n")[k] > 0, 1)).alias(f"t{k}") for k in range(size)], F.count("*").alias("t")).first()
    here = np.array(ends)
    tokens = np.array([sums[f"n{k}"] for k in range(size)]) + here
    distinct = np.array([sums[f"t{k}"] for k in range(size)]) + (here > 0)
    least = share * max(1, int(tokens.sum()))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)

    rows = words_of.where(total >= least).select("key", "n", "t").toArrow()
    n = rows.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
    t = rows.column("t").to_numpy().astype(np.int64)
    common = Table.of(rows.column("key").to_numpy().astype(np.int64).view(_U), np.hstack([n, t[:, None]]))

    def table(context: bool, keep=None) -> Table:
        told = _told(tables, context, keep)
        rows = told.toArrow()
        discard(told)
        return Table.of(rows.column("key").to_numpy().astype(np.int64).view(_U), rows.column("n").to_numpy().astype(np.int64))

    grams, behind = table(False), table(True, lambda keys: keys >> _U(63 - TOKEN_BITS) == 1)
    return Words(here, tokens, distinct, sums["t"] + int(here.any()), begins or int(here.any()), common, grams, behind)


def _words_found(docs: DataFrame, known, words_of: DataFrame) -> DataFrame:
    """block, key, n (by language), t of each block's words that are not
    broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch, max_bytes=SLICE):
                low = LOWER[buf]
                starts, ends, first = words(low, offs, SPACES)
                hashes = word_hashes(low, starts, ends)
                rare = ~known.value.words.find(hashes)[1]
                group = blocks[rows][np.repeat(np.arange(len(offs) - 1), np.diff(first))][rare]
                hashes = hashes[rare]
                for k in np.unique(group).tolist():
                    waiting.setdefault(k, []).append(np.unique(hashes[group == k]))
                for k in [k for k, held in waiting.items() if sum(map(len, held)) > CHUNK]:
                    waiting[k] = [np.unique(np.concatenate(waiting[k]))]
                    if len(waiting[k][0]) > CHUNK // 2:
                        yield out(k, waiting.pop(k)[0])
        for k, held in waiting.items():
            yield out(k, np.unique(np.concatenate(held)))

    def out(block: int, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(keys), block, np.int32)), "key": pa.array(keys.view(np.int64))})

    asked = docs.select("block", "text").repartition("block").mapInArrow(run, "block int, key bigint")
    return asked.join(words_of, "key").select("block", "key", "n", "t")


def _scored(docs: DataFrame, words_found: DataFrame, found: DataFrame, model: Automaton, known) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base (log10 of count + 0.1) and logs
    (by language) of every document; docs has doc_id, text, held_out and block,
    words_found and found the counts that are not broadcast, by block."""
    machine_of = docs.sparkSession.sparkContext.broadcast(model)
    columns = {"key": "bigint", "n": "array<bigint>", "t": "bigint", "context": "boolean", "keys": "binary", "ns": "binary", "doc_id": "bigint", "held_out": "boolean", "text": "string"}

    def row(df: DataFrame, kind: int, **own) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), *[(own.get(c, F.lit(None)).cast(t)).alias(c) for c, t in columns.items()])

    named = lambda *cs: {c: F.col(c) for c in cs}
    texts = row(docs, 1, **named("doc_id", "held_out"), text=F.coalesce("text", F.lit("")))
    counts = row(words_found, 0, **named("key", "n", "t")).union(row(found, 0, **named("context", "keys", "ns")))
    dealt = counts.union(texts).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, table = machine_of.value, known.value
        size, ends = len(table.ends), int(table.ends.sum())

        def sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
            t = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)])
            return t[edges[1:]] - t[edges[:-1]]

        for batch, rare in _by_block(batches, size):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch, max_bytes=SCORED):
                texts = rows.stop - rows.start
                stream, spelt, hashes, first, places = spell(buf, offs)
                tokens, edges, pairs, triples = sequences(hashes, first)
                text = np.repeat(np.arange(texts), np.diff(edges))
                heads, last = edges[:-1], edges[1:] - 1
                word = np.ones(len(tokens), bool)
                word[last] = False

                own = ~held[rows][text]  # a training document's pair counts one at least
                seen = np.zeros((len(hashes), size + 1), np.int64)
                two, three = own.astype(np.int64), own.astype(np.int64)
                for source in (table.words, rare.words):
                    source.put(hashes, seen)
                for source in (table.grams, rare.grams):
                    source.put(pairs, two)
                    source.put(triples, three)
                three[heads] = 0
                counts = np.tile(table.ends, (len(tokens), 1)).astype(np.int64)
                follow = np.zeros(len(tokens), np.int64)
                counts[word], follow[word] = seen[:, :size], seen[:, size]
                every = counts.sum(1)

                # What came before: the state that each tier is in.
                totals, kinds = np.roll(every, 1), np.roll(follow, 1)
                totals[heads], kinds[heads] = ends, table.begins
                deep = np.roll(two, 1)
                deep[heads] = 0
                deeper = np.ones(len(tokens), np.int64)  # if there is nothing to tell
                for source in (table.behind, rare.behind):
                    source.put(triples >> _U(TOKEN_BITS), deeper)
                deeper[deep == 0] = 0
                a, b = table.parts(counts)
                a, b = backed(a, b, two, totals, kinds)
                a, b = backed(a, b, three, deep, deeper)

                bytes_ = np.concatenate([[0.0], np.cumsum(machine.walk(stream), dtype=np.float64)])
                # A word ends where the next token of its text begins.
                begins = np.empty(len(tokens), np.int64)
                begins[word], begins[last] = places, spelt[1:] - 1
                stops = np.roll(begins, -1)
                stops[last] = spelt[1:]
                spelled = (bytes_[stops] - bytes_[begins])[:, None]
                with np.errstate(divide="ignore"):
                    logs = np.where(a > 0, np.log10(a + b * 10.0**spelled), np.log10(b) + spelled)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(rows.start, texts),
                    "held_out": batch.column("held_out").slice(rows.start, texts),
                    "n_tokens": pa.array(np.diff(edges), pa.int64()),
                    "n_known": pa.array(sums((every > 0).astype(np.float64), edges).astype(np.int64)),
                    "base": pa.array(sums(np.log10(every + 0.1), edges)),
                    "logs": lists(sums(logs, edges).ravel(), np.full(texts, size), pa.float64()),
                })

    return dealt.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, logs array<double>")


@dataclass(frozen=True)
class Rare:
    """What a block's documents hold and is not broadcast."""

    words: Table
    grams: Table
    behind: Table


def _by_block(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, Rare]]:
    """The texts of the batches, each with what its block's counts in front of
    it tell."""
    block, held, tables = None, [], None
    for batch in batches:
        blocks, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == z:
                continue
            if blocks[a] != block:
                block, held, tables = blocks[a], [], None
            part = batch.slice(a, z - a)
            if kinds[a] == 0:
                held.append(part.select(["key", "n", "t", "context", "keys", "ns"]))
                continue
            if tables is None:
                tables, held = _tables(held, size), []
            yield part, tables


def _tables(held: list[pa.RecordBatch], size: int) -> Rare:
    words_of = [(np.zeros(0, np.int64), np.zeros((0, size + 1), np.int64))]
    packed: tuple[list, list] = ([], [])
    while held:
        part = held.pop()
        own = part.filter(part.column("key").is_valid())
        n = own.column("n").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
        t = own.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
        words_of.append((own.column("key").to_numpy(zero_copy_only=False).astype(np.int64), np.hstack([n, t[:, None]])))
        for row in part.filter(part.column("keys").is_valid()).select(["context", "keys", "ns"]).to_pylist():
            # Counts of what is not broadcast are small.
            packed[row["context"]].append((unpack(row["keys"]), unplane(row["ns"]).astype(np.uint32)))
    key, n = (np.concatenate(x) for x in zip(*words_of))
    tables = []
    for of in packed:
        tables.append(Table.of(*(np.concatenate(x) for x in zip(*of))) if of else Table(np.zeros(0, _U), np.zeros(0, np.uint32)))
        of.clear()
    return Rare(Table.of(key.view(_U), n), *tables)


def _languages(rows: DataFrame) -> tuple[list[str | None], int]:
    """The languages with a state of their own (at most 1 / LANGUAGE_SHARE),
    and the bytes of all texts."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    sizes = rows.groupBy("lang").agg(F.sum(F.when(~F.col("held_out"), size)).alias("size"), F.sum(size).alias("every"))
    sums = sizes.agg(F.sum("size").alias("size"), F.sum("every").alias("every")).first()
    names = sizes.where(F.col("size") >= LANGUAGE_SHARE * (sums["size"] or 0)).orderBy("lang").collect()
    return [r["lang"] for r in names], sums["every"] or 0


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every document; the model learns from those that are not held out."""
    held_out = F.pmod(crc_of_id(), F.lit(10)) == 0
    rows = keyed(docs, "text", "lang").withColumn("held_out", held_out)
    names, n_bytes = _languages(rows)
    train = rows.where(~F.col("held_out"))
    size = len(names) + 1  # the last: all others
    language = F.lit(len(names))
    for k, name in enumerate(names):
        language = F.when(F.col("lang").eqNullSafe(F.lit(name)), k).otherwise(language)
    train = train.select("text", language.cast("int").alias("language"))

    # A gram per byte, of which most are repeats.
    counts = _counts(train, min(16, (n_bytes // (8 * RANGE_KEYS)).bit_length()))
    model = automaton(counts)
    by_language = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in range(size)]
    words_of = counts.where("kind >= 0").groupBy("key").agg(F.array(*by_language).alias("n"))
    words_of = materialize(words_of, "word-counts")
    discard(counts)
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    tokens = words_of.agg(F.sum(total)).first()[0] or 0
    documents = {r["language"]: r["n"] for r in train.groupBy("language").agg(F.count("*").alias("n")).collect()}
    bits = max(0, (2 * tokens // RANGE_KEYS).bit_length())
    blocks = -(-n_bytes // BLOCK_BYTES) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int"))
    tables = _word_grams(rows, bits, WORD_SHARE * max(1, tokens + sum(documents.values())))
    behind = _told(tables, True, lambda keys: keys >> _U(63 - TOKEN_BITS) == 0)  # words, and the begin
    behind = behind.select(F.col("key").alias("context"), F.col("n").alias("t"))
    # A word seen once has one token behind it.
    with_t = _with_context(words_of).join(behind, "context", "left").select("key", "n", F.coalesce("t", F.lit(1)).cast("bigint").alias("t"))
    words_t = materialize(with_t, "word-counts")
    discard(words_of)
    begin = behind.where(F.col("context") == int(contexts(np.array([_BEGIN]), False)[0])).first()
    known = word_counts(words_t, tables, begin and begin["t"], [documents.get(k, 0) for k in range(size)], WORD_SHARE)
    discard(behind)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    words_found = materialize(_words_found(rows, shared, words_t), "found-words", 2048, large=True)
    discard(words_t)
    joined, passes = None, min(SCORE_PASSES, blocks)
    for k in range(passes):
        ours = (F.col("block") >= 0) & (F.pmod("block", F.lit(passes)) == k)
        part = materialize(_scored(*(df.where(ours) for df in (rows, words_found, tables)), model, shared), "scores", 1024, large=True)
        joined = part if joined is None else joined.union(part)
    discard(words_found, tables)
    # The branches' probabilities, added; the largest is taken out for range.
    share = (known.ends + 1.0) / (known.ends.sum() + size)
    branch = F.array(*[F.col("logs")[k] + F.lit(float(np.log10(share[k]))) for k in range(size)])
    joined = joined.withColumn("branch", branch).withColumn("top", F.array_max("branch"))
    added = F.aggregate("branch", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("top")))
    norm = float(np.log10(known.all_tokens + 0.1 * (known.all_distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(known.all_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("top") + F.log10(added)).alias("score"),
    )
