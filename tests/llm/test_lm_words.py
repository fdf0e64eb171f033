"""The word tiers of the language model, against a dictionary model."""

import glob
import math
import random
import tempfile
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tableflow.llm import lm
from tableflow.llm.common import materialize
from tests.llm import brute, edge
from tests.llm.test_models import _held_out, lm_flat


def _dictionary(rows, machine):
    """log10 score of each row; one language."""
    texts = {i: [*brute.words(t), None] for i, t in rows}
    train = [texts[i] for i, _ in rows if not _held_out(i)]
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for w in train:
        one.update(w)
        for k, x in enumerate(w):
            two[w[k - 1] if k else "begin"][x] += 1
            if k:
                three[(w[k - 2] if k > 1 else "begin", w[k - 1])][x] += 1
    n, t = sum(one.values()), len(one)

    def up(p, x, seen):
        total = sum(seen.values())
        return (seen[x] + len(seen) * p) / (total + len(seen)) if total else p

    out = {}
    for i, text in rows:
        w = texts[i]
        stream, edges, _, first, places = lm.spell(*lm_flat([text]))
        logs = machine.walk(stream).astype(float)
        spots = [*places.tolist(), int(edges[1]) - 1, int(edges[1])]
        own = other = 0.0  # the language's branch, and that of no language seen
        for k, x in enumerate(w):
            p = 10 ** logs[spots[k] : spots[k + 1]].sum()
            q = (one[x] + t * p) / (n + t)
            p = up(q, x, one)  # the language's state: here the same counts
            for state in [two.get(w[k - 1] if k else "begin"), three.get((w[k - 2] if k > 1 else "begin", w[k - 1])) if k else None]:
                p, q = (up(z, x, state or Counter()) for z in (p, q))
            own, other = own + math.log10(p), other + math.log10(q)
        out[i] = math.log10((10**own * (len(train) + 1) + 10**other) / (len(train) + 2))
    return out


@pytest.mark.parametrize("share", [lm.WORD_SHARE, 0.01, 1.0])
def test_scores_equal_the_dictionary_model(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "WORD_SHARE", share)
    machines = []
    compiled = lm.automaton
    monkeypatch.setattr(lm, "automaton", lambda *a: machines.append(compiled(*a)) or machines[0])
    phrase = edge.prose(1, 12)
    rows = [(i, f"{edge.prose(i % 9, 10 + i % 7)} {phrase} {edge.prose(500 + i, 5)}") for i in range(60)] + [(70, ""), (71, "one"), (72, "one two one two one")]
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string")).collect()}
    want = _dictionary(rows, machines[0])
    assert got == pytest.approx(want, abs=1e-3)


def test_order_of_words_counts(spark):
    held = [i for i in range(200) if _held_out(i)][:2]
    rows = [(i, "red fish swim under blue boats " * 5, "en") for i in range(200) if i not in held]
    rows += [(held[0], "red fish swim under blue boats", "en"), (held[1], "boats under fish blue red swim", "en")]
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[held[0]] > got[held[1]] + 2


def test_unknown_long_word_has_a_score(spark):
    held = next(i for i in range(100) if _held_out(i))
    rows = [(held, "q" * 3000, "en"), *[(i, edge.prose(i, 30), "en") for i in range(200, 210)]]
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[held] is not None and math.isfinite(got[held])


def test_ranges_of_sorted_keys():
    """Sorted keys, repeats too, are cut at the ranges' edges."""
    r = np.random.default_rng(4)
    every = [r.integers(1 << 63, size=4_000).astype(np.uint64) // np.uint64(1 << 50) << np.uint64(50) for _ in range(3)]
    keys = lm._sorted(list(every))
    assert (keys == np.sort(np.concatenate(every))).all()
    for bits in (0, 1, 5):
        got = list(lm._ranged(keys, bits))
        assert [k for k, _ in got] == np.unique(keys >> np.uint64(64 - bits) if bits else keys * np.uint64(0)).tolist()
        assert (np.concatenate([keys[at] for _, at in got]) == keys).all()
    assert list(lm._ranged(keys[:0], 3)) == []


def test_counting_in_parts_changes_no_score(spark, monkeypatch):
    rows = [(i, t, r.choice(["en", "de"])) for r in [random.Random(8)] for i, t in enumerate(edge.prose(40 + k, 80) for k in range(40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = {x.doc_id: (x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in lm.lm_scores(docs).collect()}
    for name, value in (("CHUNK", 64), ("WRITTEN", 16), ("PACKED", 2), ("RANGE_KEYS", 256), ("BLOCK_BYTES", 4096)):
        monkeypatch.setattr(lm, name, value)
    assert {x.doc_id: (x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in lm.lm_scores(docs).collect()} == want


def test_tables_stay_packed(spark, monkeypatch):
    """Grams and contexts go from the ranges to the answers in few packed rows."""
    monkeypatch.setattr(lm, "PIECE", 64)
    texts = [edge.prose(3 + k % 20, 40) for k in range(30)]
    docs = spark.createDataFrame([(k % 5 == 0, t) for k, t in enumerate(texts)], "held_out boolean, text string")
    keys = {ask: lm._grams_of(*lm_flat([t for k, t in enumerate(texts) if (k % 5 == 0) == ask]))[0].tolist() for ask in (False, True)}
    times, behind, got = Counter(keys[False]), Counter(), {False: {}, True: {}}
    for key in times:
        behind[key >> lm.TOKEN_BITS] += 1
    for row in lm._word_grams(docs, 2).collect():
        own, ns = lm.unpack(row["keys"]), lm.unplane(row["ns"])
        assert 0 < len(own) <= 64
        assert {k >> (62 - lm.TOKEN_BITS * row.context) for k in own.tolist()} == {row["range"]}
        got[row.context].update(zip(own.tolist(), ns.tolist()))
    assert got[False] == {k: n for k, n in times.items() if n > 1 or k in set(keys[True])}
    assert got[True] == {k: n for k, n in behind.items() if n > 1}


def test_blocks_are_told_the_counts_of_what_they_sent(spark):
    """What is counted goes back to the blocks that sent it and is not asked for again."""
    texts = [edge.prose(3 + k % 20, 40) for k in range(30)]
    rows = [(k % 5 == 0, t, k % 3) for k, t in enumerate(texts)]
    sent = {b: set(lm._grams_of(*lm_flat([t for _, t, x in rows if x == b]))[0].tolist()) for b in range(3)}
    times = Counter(lm._grams_of(*lm_flat([t for ask, t, _ in rows if not ask]))[0].tolist())
    asked = set(lm._grams_of(*lm_flat([t for ask, t, _ in rows if ask]))[0].tolist())
    behind = Counter(key >> lm.TOKEN_BITS for key in times)
    grams = {k: n for k, n in times.items() if n > 1 or k in asked}
    heads = {k: n for k, n in behind.items() if n > 1}
    is_word = lambda k: not k >> (63 - lm.TOKEN_BITS)
    want = {(-1, False): {k: n for k, n in grams.items() if n >= 4}, (-1, True): {k: n for k, n in heads.items() if n >= 4 or is_word(k)}}
    for b, keys in sent.items():
        own = {k >> lm.TOKEN_BITS for k in keys}
        want[b, False] = {k: n for k, n in grams.items() if n < 4 and k in keys}
        want[b, True] = {k: n for k, n in heads.items() if n < 4 and not is_word(k) and k in own}
    got = defaultdict(dict)
    for row in lm._word_grams(spark.createDataFrame(rows, "held_out boolean, text string, block int"), 3, 4).collect():
        for k, n in zip(lm.unpack(row["keys"]).tolist(), lm.unplane(row["ns"]).tolist()):
            assert k not in got[row.block, row.context]
            got[row.block, row.context][k] = n
    assert got == {at: told for at, told in want.items() if told}
    assert len(want[0, False]) > 5


def test_keys_in_any_order_are_found():
    r = np.random.default_rng(7)
    table = lm.Table.of(r.permutation(500).astype(np.uint64) * np.uint64(2), np.arange(500))
    keys = r.integers(1100, size=300).astype(np.uint64)
    for of in (keys, np.sort(keys), keys[:0]):
        at, there = table.find(of)
        assert there.tolist() == [int(k) % 2 == 0 and k < 1000 for k in of]
        assert (table.keys[at[there]] == of[there]).all()


def test_a_large_shuffle_is_gone_after_the_write(spark):
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', tempfile.gettempdir())}/blockmgr-*/*/shuffle_*"))
    before = files()
    out = materialize(spark.range(20_000).repartition("id"), "large", large=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 20_000
