"""One key holding a third of all rows: results stay whole and the plans
split the hot key instead of sending it to one task."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tableflow.operators.joins import cascade_filter, equi_join, lookup_report
from tableflow.operators.quality import keep_last
from tableflow.operators.reconcile import upsert

N = 60_000


@contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    # key 0 holds a third of the rows
    big = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("seq"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("payload"),
    ).repartition(8)
    small = spark.range(N).select(F.col("id").alias("dk"), (F.col("id") * 10).alias("dv"))
    return big, small


def final_plan(df) -> str:
    df.collect()  # runs this frame's own adaptive plan to its final form
    return df._jdf.queryExecution().executedPlan().toString()


def test_inner_join_splits_hot_key(spark, skewed):
    big, small = skewed
    with conf(spark, **SKEW):
        out = equi_join(big, small, "k", "dk")
        assert out.count() == N
        assert "skew=true" in final_plan(out)


def test_semi_and_outer_joins_split_hot_key(spark, skewed):
    big, small = skewed
    with conf(spark, **SKEW):
        semi = cascade_filter(small, big, {"k": "dk"})
        assert semi.count() == N
        assert "skew=true" in final_plan(semi)
        report = lookup_report(big.select("k", "payload"), "k", small, "dk")
        assert report.filter("found").count() == N
        assert "skew=true" in final_plan(report)


def test_keep_last_hot_key_whole(spark, skewed):
    big, _ = skewed
    out = keep_last(big, "k", "seq")
    rows = {r.k: r.seq for r in out.collect()}
    assert len(rows) == N - N // 3 + 1
    assert rows[0] == max(i for i in range(N) if i % 3 == 0)


def test_upsert_hot_target_key_whole(spark, skewed):
    big, small = skewed
    src = small.select(F.col("dk").alias("k"), F.lit(-1).cast("bigint").alias("seq"), F.lit("s").alias("payload")).filter("k < 10")
    with conf(spark, **SKEW):
        out = upsert(big, src, "k")
        # key 0 (a third of the target) is replaced by one source row
        assert out.filter("k = 0").count() == 1
        assert out.count() == N - N // 3 - len([i for i in range(1, 10) if i % 3 != 0]) + 10


@pytest.fixture
def parquet_sides(spark, skewed, scratch):
    """Source rows with a hot key, target keys; from files."""
    big, small = skewed
    paths = scratch("big"), scratch("small")
    big.write.parquet(paths[0])
    small.withColumnRenamed("dk", "k").write.parquet(paths[1])
    return spark.read.parquet(paths[0]), spark.read.parquet(paths[1])


def test_reconcile_and_lookup_split_a_hot_source_key(spark, parquet_sides):
    from tableflow.operators.reconcile import insert_missing, partition_match, sync_plan

    big, small = parquet_sides
    arrays = big.withColumn("v", F.array(F.col("k").cast("string")))
    entries = arrays.groupBy("v").agg(F.count("*").alias("n"))
    forms = {
        "sync_plan": lambda: sync_plan(big, small, "k"),
        "insert_missing": lambda: insert_missing(small.withColumn("seq", F.lit(0)).withColumn("payload", F.lit("")).drop("dv"), big, "k"),
        "upsert": lambda: upsert(big, small.select("k", F.lit(1).alias("seq"), F.lit("").alias("payload")), "k", order_by="seq"),
        "lookup_report": lambda: lookup_report(big.withColumnRenamed("k", "name"), "name", keep_last(small, "k", "dv"), "k"),
        "partition_match": lambda: partition_match(arrays, entries, "v"),
    }
    with conf(spark, **SKEW):
        for name, form in forms.items():
            df = form()
            assert "skew=true" in final_plan(df), name
        assert forms["sync_plan"]().count() == N
        assert forms["lookup_report"]().count() == N
        assert forms["partition_match"]().count() == N
