"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has a logistic score over hashed
features (its words, and the 4-byte piece from the byte before each byte of a word on), and a
document is toxic if any sentence is: p = 1 - prod(1 - p_sentence), the
noisy-or.  Only document labels are known; the gradient of the document's
likelihood reaches each sentence in proportion to its share, which is how the
offending ones are found.

The model is fitted on a bounded sample of labelled rows: per label, the
`SAMPLE` documents with the smallest hash of their id, of these the ones of at
most a sixteenth of `SAMPLE_BYTES`, and the first `SAMPLE_BYTES` bytes' worth.
It is a vector of 2**BITS weights, so what is broadcast has a fixed size.
Scoring is one pass over all texts, no shuffle.

Edge cases: a null or empty text has no sentence; its score is that of one
empty sentence, the model's bias.  Repeated rows and shared or null doc_ids
give a row each; a document with several labels is trained on each.  Without
any labelled rows every score is that of the initial bias.  An empty table
gives no rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import crc_of_id
from tableflow.llm.flat import LOWER, SPACES, flatten, mix, slices, word_hashes, words

THRESHOLD = 0.7
#: Documents and bytes of text per label that the fit may use.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 24
BITS, PIECE = 20, 4
EPOCHS, RATE, DECAY, BIAS = 120, 0.35, 2e-4, -6.0

_U = np.uint64
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[0x0A, ord("."), ord("!"), ord("?")]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2**BITS
    bias: float


@dataclass(frozen=True)
class Bags:
    """The sentences of some texts and their features, which come in two
    families: one feature per word and one per byte of a word."""

    word_features: np.ndarray
    piece_features: np.ndarray
    words: np.ndarray  # per sentence
    pieces: np.ndarray  # per sentence
    sentences: np.ndarray  # per text
    starts: np.ndarray  # byte ranges
    ends: np.ndarray


def _bags(buf: np.ndarray, offs: np.ndarray) -> Bags:
    """A sentence is a run of words that ends at a line end or after a word
    that closes with . ! or ?."""
    # Spaces between the texts: no piece reaches from one into the next.
    texts, gap = len(offs) - 1, PIECE - 2
    low = np.full(len(buf) + gap * texts, 0x20, np.uint8)
    low[np.arange(len(buf)) + np.repeat(gap * np.arange(texts), np.diff(offs))] = LOWER[buf]
    starts, ends, first = words(low, offs + gap * np.arange(texts + 1), SPACES)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if not n:
        return Bags(none, none, none, none, np.zeros(len(offs) - 1, np.int64), none, none)
    lines = np.cumsum(low == 0x0A)
    opens = np.ones(n, bool)
    opens[1:] = _SENTENCE_END[low[ends[:-1] - 1]] | (lines[starts[1:]] != lines[ends[:-1] - 1])
    opens[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(opens)
    # Closing punctuation is no part of a word's feature.
    word_features = (word_hashes(low, starts, ends - _closing(low, ends, starts)) >> _U(64 - BITS)).astype(np.int64)
    spaced = np.where(SPACES[low], np.uint8(0x20), low)
    padded = np.concatenate([np.full(1, 0x20, np.uint8), spaced, np.full(PIECE, 0x20, np.uint8)]).astype(_U)
    piece = np.zeros(len(low), _U)
    for k in range(PIECE):
        piece = piece << _U(8) | padded[k : k + len(low)]
    inside = np.flatnonzero(~SPACES[low])
    piece_features = (mix(piece[inside] + _U(1 << 56)) >> _U(64 - BITS)).astype(np.int64)
    sentences = np.diff(np.searchsorted(at, first))
    moved = np.repeat(gap * np.arange(texts), sentences)
    return Bags(
        word_features,
        piece_features,
        np.diff(np.append(at, n)),
        np.diff(np.append(np.searchsorted(inside, starts[at]), len(inside))),
        sentences,
        starts[at] - moved,
        ends[np.append(at[1:], n) - 1] - moved,
    )


def _logits(bags: Bags, model: Model) -> np.ndarray:
    return model.bias + _sums(model.weights[bags.word_features], bags.words) + _sums(model.weights[bags.piece_features], bags.pieces)


def _closing(low: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 where a word of more than one byte closes with ASCII punctuation."""
    last = low[ends - 1]
    mark = (last < 0x30) | ((last > 0x39) & (last < 0x61)) | ((last > 0x7A) & (last < 0x80))
    return (mark & (ends - starts > 1)).astype(np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups; an empty group sums to 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


def _document_scores(logits: np.ndarray, sentences: np.ndarray, bias: float) -> np.ndarray:
    """Noisy-or per document: 1 - exp(sum of log(1 - p)).  Without sentences, the bias alone."""
    log_clean = -np.logaddexp(0.0, logits)
    total = _sums(log_clean, sentences)
    total[sentences == 0] = -np.logaddexp(0.0, bias)
    return -np.expm1(total)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Weights by gradient ascent on the likelihood of document labels."""
    y = np.asarray(labels, np.float64)
    weights, bias = np.zeros(1 << BITS), BIAS
    if not y.any() or y.all():  # no rows, or one label only
        return Model(weights.astype(np.float32), bias)
    bags = _joined([_bags(*flatten(pa.array(texts[k : k + 64], pa.large_string()))) for k in range(0, len(texts), 64)])
    # Only features that occur are fitted; slot: each one's place among them.
    occurs = np.zeros(1 << BITS, bool)
    occurs[bags.word_features] = True
    occurs[bags.piece_features] = True
    used = np.flatnonzero(occurs)
    slot = np.cumsum(occurs, dtype=np.int32) - 1
    by_word, by_piece = slot[bags.word_features], slot[bags.piece_features]
    blocks = _blocks(bags, len(y))
    w, squares, bias_squares = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    scale = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels weigh the same
    for _ in range(EPOCHS):
        g, bias_slope = -DECAY * w, 0.0
        for docs, sents, of_words, of_pieces in blocks:
            n_words, n_pieces, sentences = bags.words[sents], bags.pieces[sents], bags.sentences[docs]
            logits = bias + _sums(w[by_word[of_words]], n_words) + _sums(w[by_piece[of_pieces]], n_pieces)
            p_sentence = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            p = np.clip(_document_scores(logits, sentences, bias), 1e-9, 1 - 1e-9)
            # d log-likelihood / d logit of a sentence: a clean document blames
            # every sentence by p_s, a toxic one shares (1 - p) / p by p_s.
            share = np.where(y[docs] > 0, (1 - p) / p, -1.0) * scale[docs]
            slope = np.repeat(share, sentences) * p_sentence
            g += np.bincount(by_word[of_words], np.repeat(slope, n_words), len(used))
            g += np.bincount(by_piece[of_pieces], np.repeat(slope, n_pieces), len(used))
            bias_slope += slope.sum()
        squares += g * g
        w += RATE * g / np.sqrt(squares)
        bias_squares += bias_slope**2
        bias += 0.1 * RATE * bias_slope / np.sqrt(bias_squares)
    weights[used] = w
    return Model(weights.astype(np.float32), float(bias))


def _joined(parts: list[Bags]) -> Bags:
    """The bags of all texts; features at half the width."""
    join = lambda name, kind=np.int64: np.concatenate([getattr(b, name).astype(kind) for b in parts])
    small = {name: join(name, np.int32) for name in ("word_features", "piece_features")}
    return Bags(**small, **{name: join(name) for name in ("words", "pieces", "sentences", "starts", "ends")})


def _blocks(bags: Bags, n: int, size: int = 256) -> list[tuple[slice, slice, slice, slice]]:
    """Ranges of documents, and of their sentences, words and pieces, so that
    an epoch's temporaries stay small."""
    edge = lambda counts: np.concatenate([[0], np.cumsum(counts)])
    sents, by_word, by_piece = edge(bags.sentences), edge(bags.words), edge(bags.pieces)
    out = []
    for a in range(0, n, size):
        z = min(a + size, n)
        s, t = int(sents[a]), int(sents[z])
        out.append((slice(a, z), slice(s, t), slice(int(by_word[s]), int(by_word[t])), slice(int(by_piece[s]), int(by_piece[t]))))
    return out


def sentence_scores(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start byte, end byte, score) of every sentence."""
    buf, offs = flatten(pa.array([text], pa.large_string()))
    bags = _bags(buf, offs)
    return [(int(a), int(b), float(1 / (1 + np.exp(-x)))) for a, b, x in zip(bags.starts, bags.ends, _logits(bags, model))]


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` documents per label; `eligible` is a condition
    on doc_id that the training rows meet."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    marked = marked if eligible is None else marked.where(eligible)
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda y: marked.where(F.col("toxic") == y).orderBy(*place).limit(sample)
    # At most 2 * sample ids, so they may be broadcast; then their texts.
    chosen = F.broadcast(pick(0).union(pick(1)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    size = F.octet_length("text")
    upto = F.sum(size).over(Window.partitionBy("toxic").orderBy(*place, size).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.where(size <= SAMPLE_BYTES // 16).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            marks += batch.column("toxic").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], marks[i]))  # alike on every run
        model = fit([texts[i] for i in order], [marks[i] for i in order])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    # One task fits; its input is bounded by `sample` and `SAMPLE_BYTES`.
    row = rows.select("text", "toxic").repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return fit([], []) if row is None else Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs (which must include text) with `score` and
    `offending`, the byte ranges and scores of the sentences that alone reach
    one half.  They take the place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name.lower() not in ("score", "offending")]
    docs = docs.select(*["`" + f.name.replace("`", "``") + "`" for f in fields])
    plain = ["text" if f.name == "text" else f"c{i}" for i, f in enumerate(fields)]  # mapInArrow takes no dots in names
    docs, names = docs.toDF(*plain), [f.name for f in fields]
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, fields)] + _parse_datatype_string("score double, offending array<struct<start:bigint,end:bigint,score:double>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, buf, offs in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                bags = _bags(buf, offs)
                logits = _logits(bags, m)
                scores = _document_scores(logits, bags.sentences, m.bias)
                bad: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if (over := np.flatnonzero(logits >= 0)).size:
                    of = np.repeat(np.arange(part.num_rows), bags.sentences)
                    for i in over.tolist():
                        k = int(of[i])
                        bad[k].append({"start": int(bags.starts[i] - offs[k]), "end": int(bags.ends[i] - offs[k]), "score": float(1 / (1 + np.exp(-logits[i])))})
                columns = {c: part.column(c) for c in part.schema.names}
                columns |= {"score": pa.array(scores, pa.float64()), "offending": pa.array(bad, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema).toDF(*names, "score", "offending")


def in_training_part() -> Column:
    """Rows whose labels may be learned from."""
    return F.pmod(crc_of_id(), F.lit(3)) != 1
