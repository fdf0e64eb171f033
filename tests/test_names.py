"""Column names with any character, through every operator that takes names."""

import pytest
from pyspark.sql import functions as F

from tableflow.functions.text import prefix_names, split_list
from tableflow.operators import filters, joins, project, quality, reconcile

NAMES = ["a.b", "a`b", "a b"]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "x,y", "p"), (2, "z", None), (3, None, "q")], "`a.b` int, `a``b` string, `a b` string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reconcile(df):
    source = df.where("`a.b` > 1").withColumn("a b", F.lit("new"))
    target = df.where("`a.b` < 3")
    new = [(2, "z", "new"), (3, None, "new")]
    assert _rows(reconcile.upsert(target, source, "a.b")) == [(1, "x,y", "p"), *new]
    assert _rows(reconcile.upsert(target, source, "a.b", order_by="a`b")) == [(1, "x,y", "p"), *new]
    for small in (False, True):
        assert _rows(reconcile.insert_missing(target, source, "a.b", small_source=small)) == [(1, "x,y", "p"), (2, "z", None), new[1]]
        plan = reconcile.sync_plan(source, target, ["a.b"], small_source=small)
        assert {(r[0], r.action) for r in plan.collect()} == {(2, "overwrite"), (3, "create")}
    assert _rows(reconcile.insert_missing(target, source, "a.b", order_by="a`b")) == [(1, "x,y", "p"), (2, "z", None), new[1]]
    assert reconcile.partition_match(df.select(F.array("a.b") if False else F.array(F.col("`a.b`")).alias("v.s"), "`a b`"), df.select(F.array(F.col("`a.b`")).alias("v.s")), "v.s").count() == 3


def test_joins(df):
    assert joins.equi_join(df, df, "a.b", "a.b", on_collision="prefix_right").columns == [*NAMES, *["right_" + n for n in NAMES]]
    assert joins.cascade_filter(df.where("`a.b` = 2"), df, "a.b").count() == 1
    assert joins.cascade_filter(df.where("`a.b` = 2"), df, {"a.b": "a.b", "a`b": "a`b"}).count() == 1
    found = joins.lookup_report(df.select(F.col("`a.b`").alias("n.m")), "n.m", df.where("`a.b` < 3"), "a.b")
    assert sorted(r.found for r in found.collect()) == [False, True, True]


def test_filters(df):
    assert filters.filter_by_names(df, "a`b", "z,q").count() == 1
    assert filters.filter_by_names(df, "a`b", df.select("`a``b`")).count() == 2
    assert filters.composite_key_filter(df, {"a.b": 1, "a b": "p"}).count() == 1
    assert filters.prefix_filter(df, "a b", "p").count() == 1
    kept = filters.keep_unskipped(filters.skip_rules(df, [("one", F.col("`a.b`") == 1)], "why.not"), "why.not")
    assert kept.columns == NAMES and kept.count() == 2


def test_quality(df):
    assert [r[0] for r in quality.preview(df, 2, order_by="a.b").collect()] == [1, 2]
    assert _rows(quality.keep_last(df, "a`b", "a.b"))[0] == (1, "x,y", "p")


def test_text_and_projection(df):
    assert [tuple(r) for r in split_list(df, "a`b").orderBy("`a.b`", "pos").collect()] == [(1, "p", 0, "x"), (1, "p", 1, "y"), (2, None, 0, "z")]
    assert _rows(prefix_names(df, "a b", "n-"))[0][2] == "n-p"
    assert project.drop_fields(df, ["a.b"]).columns == NAMES[1:]
    assert project.rename_fields(df, [("a.b", "c.d")]).columns == ["c.d", *NAMES[1:]]
    boxed = df.select(F.struct(F.col("`a.b`").alias("x.y"), F.lit(1).alias("z")).alias("s.t"))
    assert project.drop_nested_fields(boxed, "s.t", ["x.y"]).schema.simpleString() == "struct<s.t:struct<z:int>>"
    assert project.lift_nested_field(boxed, "s.t", "x.y").columns == ["s.t", "x.y"]
    filled = project.default_map_field(project.default_map_field(boxed, "m.n", "s.t"), "o.p")
    assert filled.columns == ["s.t", "o.p"] and filled.schema["s.t"].dataType.names == ["x.y", "z", "m.n"]


def test_a_path_is_still_a_path(spark):
    df = spark.sql("SELECT named_struct('b', 'x,y') AS a")
    assert [r.name for r in split_list(df, "a.b", position=None).collect()] == ["x", "y"]
    assert filters.filter_by_names(df, "a.b", ["x,y"]).count() == 1
