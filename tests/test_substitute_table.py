"""Substitution from a mapping table against the ordered fold."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from tableflow.operators import substitute
from tableflow.operators.substitute import substitute_from_table

PAIRS = "ordinal bigint, placeholder string, value string"


def _fold(text, pairs):
    for _, k, v in sorted(pairs):
        text = None if text is None else text.replace(k, v)
    return text


def _check(spark, texts, pairs):
    df = spark.createDataFrame(list(enumerate(texts)), "`row id` int, `a.b` string").repartition(3)
    got = substitute_from_table(df, "a.b", spark.createDataFrame(pairs, PAIRS))
    assert got.columns == df.columns
    assert {r[0]: r[1] for r in got.collect()} == {i: _fold(t, pairs) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_ordered_fold(spark, seed):
    r = random.Random(seed)
    names = ["{a}", "{b}", "{c}", "{d.e}", "{}", "{x y}"]
    bits = [*names, "{", "}", "a", "b", " ", "{{", "$1", "\\"]
    pairs = [(i, r.choice(names), "".join(r.choice(["v", "{", "}", "{b}", "{c}", "w$0", "a", ""]) for _ in range(r.randrange(3)))) for i in range(8)]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(60)] + [None, "", "{a}{a}{b}"]
    _check(spark, texts, pairs)


def test_closed_texts_take_one_pass(spark, monkeypatch):
    import tableflow.operators.substitute as module

    rounds = []
    keep = module._keep
    monkeypatch.setattr(module, "_keep", lambda df, name: rounds.append(name) or keep(df, name))
    _check(spark, ["{a} and {b}", "none", None], [(1, "{a}", "x"), (2, "{b}", "y")])
    assert "folded-texts" not in rounds
    _check(spark, ["{a}", "{{b}}"], [(1, "{a}", "{b}"), (2, "{b}", "c"), (3, "{c}", "d")])
    assert rounds.count("folded-texts") == 3  # {{b}} -> {c} -> d, then none is left


def test_the_first_of_two_values(spark):
    _check(spark, ["{a} {b}"], [(5, "{a}", "late"), (1, "{a}", "early"), (0, "{b}", "{a}")])


@pytest.mark.parametrize("bad", [(1, "a", "x"), (1, "{a}}", "x"), (1, None, "x"), (1, "{a}", None), (None, "{a}", "x"), (1, "{a}\n", "x")])
def test_refused_pairs(spark, bad):
    with pytest.raises(ValueError):
        substitute_from_table(spark.createDataFrame([("t",)], "t string"), "t", spark.createDataFrame([bad], PAIRS))


def test_empty_sides_and_other_brackets(spark):
    none = spark.createDataFrame([], PAIRS)
    assert substitute_from_table(spark.createDataFrame([("{a}",)], "t string"), "t", none).collect() == [("{a}",)]
    pairs = spark.createDataFrame([(1, "[a]", "x")], PAIRS)
    assert substitute_from_table(spark.createDataFrame([("[a] {a}",)], "t string"), "t", pairs, "[", "]").collect() == [("x {a}",)]
    assert substitute_from_table(spark.createDataFrame([], "t string"), "t", pairs, "[", "]").count() == 0


def test_a_hundred_thousand_pairs(spark):
    pairs = spark.range(100_000).select(F.col("id").alias("ordinal"), F.format_string("{k%d}", "id").alias("placeholder"), F.format_string("v%d", F.col("id") * 7).alias("value"))
    rows = spark.range(3000).select("id", F.format_string("a {k%d} b {k%d}", F.col("id") * 31, F.lit(5)).alias("t"))
    got = substitute_from_table(rows, "t", pairs)
    want = F.when(F.col("id") * 31 < 100_000, F.format_string("a v%d b v35", F.col("id") * 217)).otherwise(F.format_string("a {k%d} b v35", F.col("id") * 31))
    assert got.where(F.col("t") != want).count() == 0 and got.count() == 3000


def test_no_python_in_the_plan(spark):
    pairs = spark.createDataFrame([(1, "{a}", "x")], PAIRS)
    plan = plan_text(substitute_from_table(spark.createDataFrame([("{a}",)], "t string"), "t", pairs))
    assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_common_placeholders(spark, monkeypatch, broadcast):
    """Some are in the mapping, once or twice, some not; values open texts."""
    monkeypatch.setattr(substitute, "COMMON", 5)
    monkeypatch.setattr(substitute, "BROADCAST", broadcast)
    texts = [f"{{none}} {{a}} {{k{i}}} {{b}}" for i in range(40)] + [None, "", "{a}", "{a{b}}", "plain"]
    pairs = [(1, "{a}", "A"), (2, "{b}", "{c}"), (3, "{c}", "C"), (4, "{a}", "late"), (5, "{c}", "later"), (6, "{k3}", "three"), (7, "{k4}", "{a}")]
    _check(spark, texts, pairs)
    _check(spark, texts, [p for p in pairs if "{" not in p[2]])


def test_common_placeholders_stay_in_their_tasks(spark, monkeypatch):
    """All rows of a common one went to one task."""
    monkeypatch.setattr(substitute, "COMMON", 1000)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    asked = spark.range(0, 8000, 1, 8).select("id", F.explode(F.array(F.lit("{all}"), F.lit("{none}"), F.format_string("{%d}", "id"))).alias("placeholder"))
    pairs = spark.range(8000).select(F.format_string("{%d}", "id").alias("placeholder"), F.lit("v").alias("value")).union(spark.sql("SELECT '{all}', 'w'"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        found = substitute._matches(asked, pairs)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 16000 and max(sizes) < 4000
