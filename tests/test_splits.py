"""Split predicates: disjoint, total, even."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tableflow.sources.splits import cut_points, range_predicates, split_predicates, split_report, sql_literal


def _counts(df, column, ranges):
    rows = split_report(df, split_predicates(df, column, ranges)).orderBy("part").collect()
    assert {(r.n_none, r.n_several) for r in rows} == {(0, 0)}
    assert sum(r.n_rows for r in rows) == df.count()
    return [r.n_rows for r in rows]


def test_skewed_numbers_are_even(spark):
    df = spark.range(20_000).select(F.pow("id", F.lit(4)).cast("bigint").alias("k"))
    counts = _counts(df, "k", 10)
    assert len(counts) == 10 and max(counts) <= 1.2 * 2000


def test_hot_value_and_nulls(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("it's `k`"))
    counts = _counts(df, "it's `k`", 8)
    assert 3000 <= max(counts) <= 3000 + 1.2 * 9000 / 8  # the hot value and what shares its range


@pytest.mark.parametrize("kind", ["string", "date", "timestamp_ntz", "decimal(12,2)", "double"])
def test_other_types(spark, kind):
    k = {"string": F.concat(F.lit("n'"), F.lpad(F.col("id").cast("string"), 6, "0")), "date": F.date_add(F.lit(dt.date(2001, 2, 3)), F.col("id").cast("int")),
         "timestamp_ntz": F.timestamp_seconds(F.col("id") * 977), "decimal(12,2)": F.col("id") / 7, "double": F.col("id") / 7}[kind]
    counts = _counts(spark.range(4000).select(k.cast(kind).alias("k")), "k", 8)
    assert len(counts) == 8 and max(counts) <= 1.2 * 500


def test_on_the_tables(spark):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert max(_counts(lines, "l_orderkey", 12)) <= 1.2 * lines.count() / 12


def test_edges(spark):
    for df in (spark.createDataFrame([], "k int"), spark.createDataFrame([(None,)] * 3, "k int"), spark.createDataFrame([(5,)] * 4, "k int"), spark.createDataFrame([], "k string")):
        for ranges in (1, 4):
            _counts(df, "k", ranges)
    assert cut_points(spark.range(10), "id", 1) == []
    with pytest.raises(ValueError):
        cut_points(spark.range(10), "id", 0)


def test_sql_text():
    assert range_predicates("k", []) == ["k IS NULL OR k IS NOT NULL"]
    assert range_predicates("k", [1, 5]) == ["k IS NULL OR k <= 1", "k > 1 AND k <= 5", "k > 5"]
    assert sql_literal("it's") == "'it''s'" and sql_literal(dt.date(2020, 1, 2)) == "DATE '2020-01-02'"
    with pytest.raises(TypeError):
        sql_literal(None)
