"""Language model, toxicity, decontamination."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tableflow.llm import decontaminate, lm, toxicity
from tests.llm import brute, edge


def _held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def test_base_scores_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if r[0] is None else r[0] + 1000, r[1], r[2]) for r in edge.rows()]
    tokens = [(i, [*brute.words(t), b"\n"]) for i, t, _ in rows]
    c = Counter(x for i, w in tokens if not _held_out(i) for x in w)
    n, norm = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = Counter((i, _held_out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(c[x] + 0.1) for x in w) - len(w) * norm, 4)) for i, w in tokens)
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def _compiled(texts, share=0.0):
    stream, edges, *_ = lm.spell(*lm_flat(texts))
    grams = lm._grams(stream, edges)
    arcs, counts = [], []
    for m in range(lm.ORDER):
        arc, n = np.unique(grams & np.uint64((1 << 8 * (m + 1)) - 1), return_counts=True)
        context, at = np.unique(arc >> np.uint64(8), return_inverse=True)
        keep = np.bincount(at, n)[at] >= share * len(grams) if m else np.ones(len(arc), bool)
        arcs.append(arc[keep])
        counts.append(n[keep])
    return lm.compile_automaton(arcs, counts)


def lm_flat(texts):
    from tableflow.llm.flat import flatten

    return flatten(pa.array(texts, pa.large_string()))


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_spelling_states_are_distributions(share):
    machine = _compiled([edge.prose(k, 60) for k in range(5)], share)
    rows = 10.0 ** machine.weight.astype(float).reshape(-1, machine.width)
    unseen = 256 - (machine.width - 1)
    assert np.allclose(rows[:, :-1].sum(1) + unseen * rows[:, -1], 1, atol=1e-4)


def test_stretches_do_not_change_a_walk(monkeypatch):
    machine = _compiled([edge.prose(k, 60) for k in range(5)])
    stream, *_ = lm.spell(*lm_flat([edge.prose(9, 900)]))
    whole = machine.walk(stream)
    monkeypatch.setattr(lm, "STRETCH", 17)
    assert np.allclose(whole, machine.walk(stream))


def test_model_prefers_its_own_kind(spark):
    strange = [i for i in range(900, 1200) if _held_out(i)][:10]
    rows = [(i, edge.prose(i, 80), "en") for i in range(300)] + [(i, "zq xv jk wy " * 30, None) for i in strange]
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    own = [r.score / r.n_tokens for i, r in got.items() if i < 300 and r.held_out]
    odd = [r.score / r.n_tokens for i, r in got.items() if i in strange]
    assert len(odd) == 10 and all(got[i].held_out for i in strange)
    assert own and sum(own) / len(own) > sum(x for x in odd) / len(odd) - 4


def test_lm_without_training_rows_and_empty(spark):
    held = next(i for i in range(100) if _held_out(i))
    row = lm.lm_scores(spark.createDataFrame([(held, "ab", "en")], "doc_id bigint, text string, lang string")).first()
    assert row.base_score == 0 and row.n_known == 0 and row.train_tokens == 0
    assert row.score == pytest.approx(-4 * math.log10(256), rel=1e-4)  # a, b, space, end
    assert lm.lm_scores(edge.none(spark)).count() == 0


def _toxic_corpus(n=400):
    bad = ["idiot", "scum", "moron"]
    rows = []
    for i in range(n):
        sentences = edge.prose(i, 45).split(". ")
        toxic = i % 4 == 0
        if toxic:
            sentences.insert(i % (len(sentences) + 1), f"you {bad[i % 3]} and {bad[(i + 1) % 3]} go")
        rows.append((i, ". ".join(sentences), int(toxic)))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = _toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.in_training_part())
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((got[i].score >= toxicity.THRESHOLD) == bool(y) for i, _, y in held)
    assert right / len(held) > 0.97
    for i, text, y in held:
        if y and got[i].offending:
            worst = max(got[i].offending, key=lambda s: s.score)
            assert "you " in text.encode()[worst.start : worst.end].decode()


def test_noisy_or(spark):
    model = toxicity.Model(np.random.default_rng(1).normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32), -3.0)
    texts = [edge.prose(3, 50), "", None, " \n ", edge.prose(4, 3000)]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), model).collect()
    for r in got:
        each = [p for _, _, p in toxicity.sentence_scores(r.text or "", model)] or [1 / (1 + math.exp(3.0))]
        assert r.score == pytest.approx(1 - math.prod(1 - p for p in each), abs=1e-9)


def _mixed(x):
    x &= 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _plain_scores(text, weights, bias):
    """[(start, end, logit)] of a text's sentences, byte by byte."""
    raw = (text or "").encode()
    low = raw.translate(brute.LOWER)
    spaced = b" " + bytes(0x20 if c in b" \t\n\x0b\x0c\r" else c for c in low) + b"   "
    sentences = []
    for m in brute.SPACE_WORD.finditer(low):
        closed = sentences and (sentences[-1][-1].group()[-1:] in b".!?" or b"\n" in low[sentences[-1][-1].end() : m.start()])
        if not sentences or closed:
            sentences.append([])
        sentences[-1].append(m)
    out = []
    for s in sentences:
        logit = bias
        for m in s:
            word = m.group()
            bare = word[:-1] if len(word) > 1 and word[-1] < 0x80 and not chr(word[-1]).isalnum() else word
            total = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(bare)) % 2**64
            logit += weights[_mixed(total ^ len(bare) << 40) >> 64 - toxicity.BITS]
            for i in range(m.start(), m.end()):  # spaced[i] is the byte before
                logit += weights[_mixed(int.from_bytes(spaced[i : i + 4], "big") + 2**56) >> 64 - toxicity.BITS]
        out.append((s[0].start(), s[-1].end(), logit))
    return out


def test_scores_equal_a_plain_bag(spark):
    weights = np.random.default_rng(4).normal(0, 0.2, 1 << toxicity.BITS).astype(np.float32)
    model = toxicity.Model(weights, -2.0)
    texts = [t for _, t, *_ in edge.rows() if t is None or len(t) < 3000] + ["no space behind", "none before. Two!Three? (four) ...\nfive", "É.ü x"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), model).collect()
    for r in got:
        plain = _plain_scores(r.text, weights.astype(float), -2.0)
        p = [1 / (1 + math.exp(-x)) for *_, x in plain] or [1 / (1 + math.exp(2.0))]
        assert r.score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-6)
        assert [(s.start, s.end) for s in r.offending] == [(a, z) for a, z, x in plain if x >= 0]


def test_a_fit_takes_bounded_bytes(spark, monkeypatch):
    rows = _toxic_corpus(80) + [(500, "you idiot go " * 4000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 19)
    whole = toxicity.train(df.where("doc_id < 500").select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert np.array_equal(toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")).weights, whole.weights)


def test_toxicity_edges(spark):
    docs = edge.docs(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)  # no usable label
    assert toxicity.score(docs.select("doc_id", "text"), model).count() == len(edge.rows())
    assert toxicity.score(edge.none(spark).select("doc_id", "text"), model).count() == 0
    scored = toxicity.score(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score", "offending"]
    assert all(r[c] == 7 for r in scored.collect() for c in edge.AWKWARD)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "Short item"), (10, None), (None, "null id item text"), (3, "...")]


def _leak_docs():
    q = ITEMS[0][1]
    return [(1, f"Prose. {q.upper()}! More."), (2, "the quick brown fox jumps over the lazy dog near"), (3, "quick brown fox jumps over the lazy dog near"), (4, "a short,ITEM here short item"), (5, "null id item text"), (6, q.replace(" ", " -- ")), (7, "été " + q)]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 4])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows = _leak_docs() + [(None if r[0] is None else r[0] + 100, r[1]) for r in edge.rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()
    want = Counter((i, n, len(hit), tuple(of)) for i, t in rows for n, hit, of in [brute.leaks(t, ITEMS)])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    spans = {r.doc_id: [t.encode()[s.start : s.end].decode() for s in r.spans] for r in got for i, t in rows if i == r.doc_id and r.doc_id in range(1, 8)}
    assert spans[1] == [ITEMS[0][1].upper()] and spans[4] == ["short,ITEM", "short item"] and spans[3] == []


def test_decontamination_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        n, hit, of = brute.leaks(r.text, items)
        assert got[r.doc_id] == (n, len(hit), of)


def test_decontamination_empty_sides(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.decontaminate(edge.none(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(edge.docs(spark), bench.limit(0)).collect()} == {0}
