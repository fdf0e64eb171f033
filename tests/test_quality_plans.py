from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from tableflow.operators.quality import expect_predicates, expect_row_count, non_empty, preview, row_count
from tableflow.plans.export import ExportJob, custom_transform, fan_out
from tableflow.queries import QUERIES


def test_counts_and_expectations(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 700.0)], "id int, v double")
    assert row_count(df).first().row_count == 3
    assert non_empty(df).first().non_empty is True
    assert non_empty(df.filter("id > 10")).first().non_empty is False
    r = expect_row_count(df, 3).first()
    assert (r.check_name, r.expected, r.actual, r.passed) == ("row_count", 3, 3, True)
    rep = {r.check_name: r for r in expect_predicates(df, [("v_small", F.col("v") < 600)]).collect()}
    assert (rep["v_small"].n_rows, rep["v_small"].n_failed, rep["v_small"].passed) == (3, 2, False)
    empty = expect_predicates(df.filter("id > 10"), [("v_small", F.col("v") < 600)]).first()
    assert (empty.n_rows, empty.n_failed, empty.passed) == (0, 0, True)


def test_preview_is_stable(spark):
    df = spark.range(100).repartition(5)
    assert [r.id for r in preview(df, 3, order_by="id").collect()] == [0, 1, 2]


def test_custom_transform_contract(spark):
    df = spark.range(3)
    out = custom_transform(spark, lambda _s, frames: {"out": frames["in"]}, {"in": df})
    assert out["out"].count() == 3
    import pytest
    with pytest.raises(TypeError):
        custom_transform(spark, lambda _s, frames: [1], {"in": df})


def test_fan_out_releases_cache(spark):
    df = spark.range(10)
    res = fan_out(df, {"a": lambda d: d.count(), "b": lambda d: d.filter("id < 5").count()})
    assert res == {"a": 10, "b": 5}
    assert not df.is_cached


def test_fan_out_modes(spark):
    df = spark.range(20).selectExpr("id", "id * 2 AS v")
    for mode in ["persist", "checkpoint", "none"]:
        res = fan_out(df, {"n": lambda d: d.count(), "s": lambda d: d.agg({"v": "sum"}).first()[0]}, persist=mode)
        assert res == {"n": 20, "s": 380}, mode
    import pytest
    with pytest.raises(ValueError):
        fan_out(df, {}, persist="bogus")


def test_entry_smoke(spark):
    import __spark_entry__ as entry_mod
    df = entry_mod.entry(spark)
    assert df.count() > 0
    from tableflow.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLES) <= set(entry_mod.oracle_sql())


def test_export_job_writes_both_outputs(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "id INT, s STRING")
    job = ExportJob(schema="id BIGINT, s STRING", target_path=scratch("t"), step_path=scratch("s"))
    out = job.run(spark, df)
    assert out["out"].dtypes == [("id", "bigint"), ("s", "string")]
    assert spark.read.csv(job.target_path).count() == 1
    assert spark.read.csv(job.step_path).count() == 1


def test_no_python_udf_and_no_cartesian_in_any_query(spark):
    for name, q in QUERIES.items():
        plan = plan_text(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_keep_last_limits_before_the_shuffle(spark):
    df = QUERIES["keep_last"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_prefix_filter_is_pushed_to_scan(spark):
    plan = plan_text(QUERIES["prefix_filter"](spark, SF_SMALL))
    assert "StringStartsWith(event_type,c)" in plan


def test_projection_prunes_scan(spark):
    plan = plan_text(QUERIES["substitute"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
