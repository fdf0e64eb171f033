"""Partitions from paths; files of equal bytes."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from tableflow.sinks import files
from tableflow.sinks.balanced import write_balanced_csv
from tableflow.sinks.csv import read_csv
from tableflow.sinks.partitioned import partition_upsert
from tableflow.sources.partitions import listed_partitions, partition_plan, partition_values

ODD = ["a=b", "50%", "x y", "p+q", "é 中", "a/b:c", "%2F", "quote'\"", "[1]{2}", None, "", "plain", "back\\slash", "tab\there", "~!$&,;@"]


def _rows(spark):
    return spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(ODD)], "id int, `odd.name` string, n int")


def test_listing_equals_a_scan(spark, scratch):
    path = partition_upsert(_rows(spark), scratch(), ["odd.name", "n"])
    listed = listed_partitions(spark, path, ["odd.name", "n"])
    got = {tuple(r["values"]): r.n_files for r in listed.collect()}
    assert set(got) == {tuple(r["values"]) for r in partition_values(_rows(spark), ["odd.name", "n"]).collect()}
    assert set(got) == {(v or None, str(i % 2)) for i, v in enumerate(ODD)} and set(got.values()) == {1}
    plan = plan_text(listed)
    assert "FileScan parquet" not in plan and "ReadSchema: struct<path:string,length:bigint>" in plan


def test_plan_of_an_upsert(spark, scratch):
    path = partition_upsert(_rows(spark).where("id % 3 = 0"), scratch(), ["odd.name", "n"])
    plan = {tuple(r["values"]): r.action for r in partition_plan(_rows(spark), path, ["odd.name", "n"]).collect()}
    want = {}
    for i, v in enumerate(ODD):
        want[(v or None, str(i % 2))] = "overwrite" if i % 3 == 0 else want.get((v or None, str(i % 2)), "create")
    # Null values never match, as in sync_plan.
    assert {k: a for k, a in plan.items() if None not in k} == {k: a for k, a in want.items() if None not in k}


def test_files_of_equal_bytes(spark, scratch):
    r = random.Random(4)
    rows = [(k, "x" * r.choice([1, 5, 200]) + ',"é\n'[: r.randrange(4)]) for k in r.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "`a.k` int, s string").repartition(7)
    path = write_balanced_csv(df, scratch(), "a.k", 6)
    names = [n for n in files.names(spark, path) if n.startswith("part-")]
    sizes = [len(files.read_text(spark, f"{path}/{n}").encode()) for n in names]
    assert len(names) == 6 and max(sizes) - min(sizes) < 450 and max(sizes) <= 1.05 * sum(sizes) / 6
    back = [row for n in names for row in read_csv(spark, f"{path}/{n}", "k int, s string", multi_line=True).collect()]
    assert [(b.k, b.s) for b in back] == sorted(rows)


@pytest.mark.parametrize("n,num_files", [(0, 3), (2, 5), (9, 1)])
def test_few_rows(spark, scratch, n, num_files):
    path = write_balanced_csv(spark.range(n).select(F.col("id"), F.lit(None).cast("string").alias("s")), scratch(), "id", num_files)
    assert sorted(r.id for r in read_csv(spark, path, "id bigint, s string").collect()) == list(range(n))
