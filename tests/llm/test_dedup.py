"""Suffix dedup, line dedup, n-gram Jaccard join."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableflow.llm import jaccard, lines, suffixes
from tableflow.llm.common import ROW, keyed
from tests.llm import brute, edge


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def _suffix_digests(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.sha) for r in df.withColumn("sha", F.sha2("kept", 256)).collect())


def _suffix_brute(rows):
    rows = _ordered(rows)
    return Counter((r[0], *b) for r, b in zip(rows, brute.removed_bytes([r[1] for r in rows])))


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    r = random.Random(4)
    line = edge.prose(50, 30)
    rows = [(i, edge.prose(100 + i % 17, 40 + i % 5) + " " + line[i % 60 : 100 + i % 80] + " " + edge.prose(300 + i, r.randrange(40))) for i in range(60)]
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert _suffix_digests(got) == _suffix_brute(rows)


def test_suffix_dedup_edges(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert _suffix_digests(suffixes.suffix_dedup(edge.docs(spark))) == _suffix_brute(rows)
    assert suffixes.suffix_dedup(edge.none(spark)).count() == 0


def test_suffix_dedup_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 700)
    monkeypatch.setattr("tableflow.llm.flat.SLICE_BYTES", 100)
    rows = [(1, edge.prose(1, 500)), (2, edge.prose(2, 300) + edge.prose(1, 200)), (3, edge.prose(2, 300))]
    from tableflow.llm.flat import slices

    monkeypatch.setattr(suffixes, "slices", lambda b: slices(b, max_bytes=100))
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert _suffix_digests(got) == _suffix_brute(rows)


def test_levels_merge_geometrically(spark):
    rows = [(i, edge.prose(i, 40)) for i in range(40)]
    docs = keyed(spark.createDataFrame(rows, "doc_id bigint, text string"), "text")
    index, sizes = suffixes.SuffixIndex(), []
    for k in range(0, 40, 8):
        index.add(docs.where((F.col(ROW) >= k) & (F.col(ROW) < k + 8)))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]


def test_any_number_of_batches_gives_the_same(spark):
    rows = [(i, edge.prose(i % 7, 60)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _suffix_digests(suffixes.suffix_dedup(df, batches=1)) == _suffix_digests(suffixes.suffix_dedup(df, batches=5)) == _suffix_brute(rows)


def _lines_brute(rows, min_words=lines.MIN_WORDS):
    seen, out = set(), []
    for doc_id, text in _ordered(rows):
        raw, spans = (text or "").encode(), []
        found = brute.units(text)
        for k, (start, words) in enumerate(found):
            end = found[k + 1][0] if k + 1 < len(found) else len(raw)
            if len(words) >= min_words:
                if words in seen:
                    spans.append((start, end))
                seen.add(words)
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + raw[at:a], z
        out.append((doc_id, None if text is None else (kept + raw[at:]).decode(), tuple(spans)))
    return Counter(out)


def test_line_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if i is None else i + 1000, t) for i, t, *_ in edge.rows()]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter((r.doc_id, r.text, tuple((s.start, s.end) for s in r.spans)) for r in got.collect()) == _lines_brute(rows)


def test_line_units_and_columns(spark):
    df = spark.createDataFrame([(1, "one two three four five six. seven eight nine ten eleven", "k")], "doc_id bigint, text string, extra string")
    twice = df.union(df.select(F.lit(2), "text", "extra"))
    whole = {r.doc_id: r for r in lines.line_dedup(twice, "line", 5, "extra").collect()}
    assert whole[1].n_removed == 0 and whole[2].n_removed == 1 and whole[2].text == "" and whole[2].extra == "k"
    assert {r.doc_id: r.n_removed for r in lines.line_dedup(twice, "sentence", 5).collect()} == {1: 0, 2: 2}
    assert lines.line_dedup(edge.none(spark)).count() == 0


def _check_components(spark, rows, **kw):
    rows = _ordered(rows)
    sets = [brute.shingles(t) for _, t in rows]
    heads = brute.components(sets)
    want = Counter((i, len(s), rows[h][0]) for (i, _), s, h in zip(rows, sets, heads))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), **kw)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_jaccard_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if i is None else i + 1000, t) for i, t, *_ in edge.rows()]
    _check_components(spark, rows)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 8])
def test_jaccard_stars_and_chains(spark, monkeypatch, block):
    """Copies of one text with edits of their own: most are linked with the
    original only, whatever its place, and some in chains."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(9)
    rows, i = [], 0
    for base in range(4):
        words = edge.prose(700 + base, 120).split()
        for _ in range(30):
            now = list(words)
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                now[r.randrange(len(now))] = f"edit{r.randrange(10**6)}"
            rows.append((i, " ".join(now)))
            i += 1
        step = list(words)
        for k in range(12):  # a chain: each a bit further from the text
            step = step[:]
            step[8 * k] = f"chain{base}{k}"
            rows.append((i, " ".join(step)))
            i += 1
    r.shuffle(rows)
    _check_components(spark, rows)


def test_jaccard_empty_table(spark):
    assert jaccard.jaccard_join(edge.none(spark)).count() == 0


def test_the_sketch_tells_common_shingles(spark):
    """The order comes from the profile's sketch alone: counts of what is common
    stand out at its level, and rare shingles stay below wherever they lie."""
    r = np.random.default_rng(5)
    rare, common = (r.integers(1 << 53, size=n).astype(np.uint64) for n in (200_000, 5_000))
    counters = np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    for h, n in ((rare, 1), (common, 6_000)):
        for at in jaccard._counters(h):
            np.add.at(counters, at, n)
    order = jaccard.Order.by(jaccard._level(counters))
    assert (order.of(common)[1] > jaccard.BLOCK).all()
    level, counts = order.of(rare)
    assert (counts > 0).mean() < 1e-3 and (level < order.of(common)[0].min()).mean() > 0.999
