"""The pipeline's near duplicates: 5-grams of words, similarity 0.8."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm import brute, edge


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    return sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, "unused").collect())


def _firsts(rows, n, percent):
    heads = brute.components([brute.shingles(t, n) for _, t in rows], percent)
    return [i for k, (i, _) in enumerate(rows) if heads[k] == k]


def test_near_duplicates_equal_brute_force(spark):
    r, rows = random.Random(3), []
    for base in range(6):
        words = edge.prose(800 + base, 150, end=10**9).split()
        rows.append((len(rows), " ".join(words)))
        for share in (0.1, 0.15, 0.18, 0.2, 0.22, 0.24, 0.27, 0.35):  # appended
            rows.append((len(rows), " ".join(words + edge.prose(1000 + len(rows), round(share * 150)).split())))
        for edits in (1, 2, 3, 4, 6):
            now = list(words)
            for at in r.sample(range(150), edits):
                now[at] = f"edit{len(rows)}x{at}"
            rows.append((len(rows), " ".join(now)))
    want = _firsts(rows, 5, 80)
    assert want != _firsts(rows, 4, 85)
    assert _kept(spark, rows) == want


@pytest.mark.parametrize("words", [100, 300, 1000])
def test_a_fifth_of_text_appended_is_a_near_duplicate(spark, words):
    text = edge.prose(5, words)
    rows = [(1, text), (2, text + " " + edge.prose(6, words // 5)), (3, text + " " + edge.prose(7, words // 3))]
    assert _kept(spark, rows) == [1, 3]
