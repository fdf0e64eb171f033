"""Staged export: one evaluation, old output kept, checks on the way."""

import pytest
from pyspark.sql import functions as F

from tableflow.operators.quality import expect_predicates
from tableflow.sinks import files
from tableflow.sinks.csv import read_csv, write_csv
from tableflow.sinks.staged import publish_csv

SCHEMA = "id BIGINT"


def _ids(spark, path):
    return sorted(r.id for r in read_csv(spark, path, SCHEMA).collect())


def _siblings(spark, path):
    return [n for n in files.names(spark, path.rsplit("/", 1)[0]) if n.startswith(path.rsplit("/", 1)[1])]


def test_the_input_runs_once(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = scratch()
    done = publish_csv(spark.range(0, 1000, 1, 5).mapInArrow(look, SCHEMA), path, [("low", F.col("id") < 990)])
    assert seen.value == 1000 and (done.written, done.n_rows, done.failed, done.passed) == (True, 1000, {"low": 10}, False)
    assert _ids(spark, path) == list(range(1000)) and len(_siblings(spark, path)) == 1


@pytest.mark.parametrize("empty", ["filter", "relation", "false"])
def test_empty_input_leaves_the_old_output(spark, scratch, empty):
    path = write_csv(spark.range(3), scratch())
    df = {"filter": spark.range(9).where("id > 50"), "relation": spark.createDataFrame([], SCHEMA), "false": spark.range(9).where(F.lit(False))}[empty]
    done = publish_csv(df, path, [("any", F.col("id") > 0)])
    assert (done.written, done.n_rows, done.passed) == (False, 0, True)
    assert _ids(spark, path) == [0, 1, 2] and len(_siblings(spark, path)) == 1


def test_overwrite_and_new(spark, scratch):
    path = scratch()
    assert publish_csv(spark.range(2), path).written and _ids(spark, path) == [0, 1]
    assert publish_csv(spark.range(5, 7), path, num_files=1).written and _ids(spark, path) == [5, 6]
    assert len([n for n in files.names(spark, path) if n.startswith("part-")]) == 1


def test_a_failed_write_leaves_the_old_output(spark, scratch):
    path = write_csv(spark.range(3), scratch())
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("boom")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        publish_csv(broken, path)
    assert _ids(spark, path) == [0, 1, 2] and len(_siblings(spark, path)) == 1


def test_gate_and_report(spark, scratch):
    path = write_csv(spark.range(3), scratch())
    df = spark.createDataFrame([(1,), (None,), (7,)], SCHEMA)
    checks = [("small", F.col("id") < 5), ("all", F.lit(True))]
    done = publish_csv(df, path, checks, gate=True)
    assert not done.written and _ids(spark, path) == [0, 1, 2]
    assert sorted(map(tuple, done.report(spark).collect())) == sorted(map(tuple, expect_predicates(df, checks).collect()))
    assert publish_csv(df, path, checks[1:], gate=True).written


def test_several_outputs_of_one_pass(spark, scratch):
    from tableflow.sinks.staged import CsvBranch, publish_branches

    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "id BIGINT, `a.b` STRING, t TIMESTAMP_NTZ"
    values = ['say "hi"', "a,b", " x ", "", None, "back\\slash", "line\nbreak"]
    at = F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % 7).cast("int"))
    rows = spark.range(0, 70, 1, 3).mapInArrow(look, "id bigint").select("id", at.alias("a.b"), F.expr("TIMESTAMP_NTZ'2024-01-02 03:04:05.123456'").alias("t"))
    base = scratch()
    old = write_csv(spark.range(3), f"{base}/kept")
    branches = {
        "every": CsvBranch(f"{base}/every"),
        "some": CsvBranch(f"{base}/some", ("t", F.col("`a.b`").alias("x")), F.col("id") < 14),
        "kept": CsvBranch(old, ("id",), F.col("id") > 100, guarded=True),
        "none": CsvBranch(f"{base}/none", ("id",), F.col("id") > 100),
    }
    done = publish_branches(rows, branches)
    assert seen.value == 70
    assert {k: (p.written, p.n_rows) for k, p in done.items()} == {"every": (True, 70), "some": (True, 14), "kept": (False, 0), "none": (True, 0)}
    assert _ids(spark, old) == [0, 1, 2] and read_csv(spark, f"{base}/none", SCHEMA).count() == 0
    plain = write_csv(rows, scratch("plain"))
    key = lambda path, s: sorted(map(str, read_csv(spark, path, s, multi_line=True).collect()))
    assert key(f"{base}/every", schema) == key(plain, schema)
    plain = write_csv(rows.where("id < 14").select("t", "`a.b`"), scratch("plain2"))
    assert key(f"{base}/some", "t TIMESTAMP_NTZ, x STRING") == key(plain, "t TIMESTAMP_NTZ, x STRING")
    assert [n for n in files.names(spark, base) if "staged" in n or "old" in n] == []
