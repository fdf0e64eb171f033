"""Licence scan and quality rules."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableflow.llm import licenses, quality_rules
from tests.llm import brute, edge

MIT = "Released under the MIT License."


def _dice(a, b):
    x, y = (Counter(zip(w, w[1:])) for w in (a.split(), b.split()))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def test_licence_lines_paragraphs_and_whole_texts(spark):
    text = "Intro words.\n\n" + licenses.TEMPLATES["ISC"].replace(" and ", "\nand ") + "\n\nOutro."
    rows = [(1, f"Some prose here.\n{MIT}\nMore prose."), (2, "released UNDER the mit licence"), (3, text), (4, "all rights, reserved!"), (5, "prose only")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (got[1].license_id, got[1].dice, got[1].n_matches) == ("MIT", 1.0, 1) and got[1].matches[0].unit == "released under the mit license"
    assert got[2].license_id is None  # 3 of 4 bigrams: 0.75
    assert (got[3].license_id, got[3].dice) == ("ISC", 1.0)
    assert got[4].license_id == "all-rights-reserved"
    assert got[5].license_id is None and got[5].n_matches == 0


def test_licence_inside_prose_and_over_lines(spark):
    prose = "Long words of prose stand here in front of it. {} And some more words follow behind it!"
    rows = [(i, prose.format(licenses.TEMPLATES[k])) for i, k in enumerate(["MIT", "CC-BY-SA-4.0", "GPL-3.0"])]
    wrapped = licenses.TEMPLATES["CC-BY-4.0"].replace(" a ", " a\n").replace(" 4.0", "\n  4.0")
    rows += [(10, f"A line of other words.\n{wrapped}\nAnother line of other words."), (11, "this work... is! licensed? under. nothing! at all"), (12, "Wait. All rights reserved! Really?")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [(got[i].license_id, got[i].dice) for i in (0, 1, 2, 10)] == [("MIT", 1.0), ("CC-BY-SA-4.0", 1.0), ("GPL-3.0", 1.0), ("CC-BY-4.0", 1.0)]
    assert got[11].license_id is None and got[12].license_id == "all-rights-reserved"


def test_dice_counts_repeats_and_threshold(spark):
    unit = "a b a b a b c d e f"
    templates = {"t": "a b a b c d e f g h", "long": "a b " * 40}
    df = spark.createDataFrame([(1, unit)], "doc_id int, text string")
    row = licenses.license_scan(df, templates, threshold=0.5).first()
    assert row.license_id == "t" and row.dice == pytest.approx(_dice(unit, templates["t"]))
    assert licenses.license_scan(df, templates, threshold=0.95).first().license_id is None


def test_licence_edges(spark):
    assert licenses.license_scan(edge.docs(spark)).count() == len(edge.rows())
    assert licenses.license_scan(edge.none(spark)).count() == 0


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = edge.docs(spark).select((F.coalesce("doc_id", F.lit(99)) + 10_000).alias("doc_id"), "text", "lang", "source")
    every = docs.union(extra)
    texts = Counter()
    for r in every.collect():
        n = brute.quality_counts(r.text)
        texts[(r.doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    got = quality_rules.quality_rules(every).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == texts
    assert not any(r.kept for r in got if r.base_failed)


def test_thresholds_adapt_to_the_source(spark):
    # Source a has symbols everywhere, source b nowhere but in one document.
    clean, marked = edge.prose(1, 60), " ".join(w + "#" for w in edge.prose(2, 60).split())
    rows = [(i, edge.prose(i, 60) if i % 2 else " ".join(w + "|" for w in edge.prose(i, 60).split()), "en", "b" if i % 2 else "a") for i in range(200)]
    rows += [(1000, marked, "en", "b"), (1001, marked, "en", "a"), (1002, clean, "en", "b")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[1000].kept and got[1000].failed_rules == ["symbol_ratio"]
    assert got[1001].kept and got[1002].kept


def test_sketches_merge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = quality_rules.measures(docs).cache()
    keys = ["lang", "source", "measure", "bucket"]
    parts = quality_rules.sketches(m.where("doc_id % 2 = 0")).union(quality_rules.sketches(m.where("doc_id % 2 = 1")))
    merged = {tuple(r) for r in parts.groupBy(*keys).agg(F.sum("n")).collect()}
    assert merged == {tuple(r) for r in quality_rules.sketches(m).select(*keys, "n").collect()}


def test_quality_edges(spark):
    assert quality_rules.quality_rules(edge.none(spark)).count() == 0


def test_no_python_in_native_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (licenses.license_scan(docs), quality_rules.measures(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
