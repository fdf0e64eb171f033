from pyspark.sql import functions as F
import pytest

from tableflow.operators.filters import (
    composite_key_filter,
    filter_by_names,
    keep_unskipped,
    parse_name_list,
    prefix_filter,
    skip_rules,
    starts_with,
)
from tableflow.operators.project import (
    default_map_field,
    drop_fields,
    drop_nested_fields,
    lift_nested_field,
    rename_fields,
)


def test_drop_missing_is_noop(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert drop_fields(df, ["nope", "name"]).columns == ["id"]


def test_rename_chain_and_missing(spark):
    df = spark.createDataFrame([(1, "a", 2)], "id int, name string, x int")
    out = rename_fields(df, [("id", "org_id"), ("name", "org_name"), ("missing", "m")])
    assert out.columns == ["org_id", "org_name", "x"]
    chained = rename_fields(df, [("id", "k"), ("k", "key")])
    assert chained.columns == ["key", "name", "x"]
    with pytest.raises(ValueError):
        rename_fields(df, {"id": "x"})


def test_drop_then_rename_commutes_on_disjoint_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, v double")
    a = rename_fields(drop_fields(df, ["v"]), {"id": "k"})
    b = drop_fields(rename_fields(df, {"id": "k"}), ["v"])
    assert a.columns == b.columns and a.collect() == b.collect()


def test_drop_nested_struct_array_map_and_null(spark):
    df = spark.createDataFrame(
        [({"a": 1, "CreatedOn": "x"}, [{"a": 1, "CreatedOn": "y"}], {"k": {"a": 1, "CreatedOn": "z"}}),
         (None, None, None)],
        "s struct<a:int,CreatedOn:string>, arr array<struct<a:int,CreatedOn:string>>, "
        "m map<string,struct<a:int,CreatedOn:string>>",
    )
    for c in ["s", "arr", "m"]:
        df = drop_nested_fields(df, c, ["CreatedOn", "NotThere"])
    assert df.schema["s"].dataType.fieldNames() == ["a"]
    assert df.schema["arr"].dataType.elementType.fieldNames() == ["a"]
    assert df.schema["m"].dataType.valueType.fieldNames() == ["a"]
    rows = df.collect()
    assert rows[0].s.a == 1 and rows[0].arr[0].a == 1 and rows[0].m["k"].a == 1
    assert rows[1].s is None and rows[1].arr is None


def test_default_map_field_absent_null_present(spark):
    df = spark.createDataFrame(
        [({"Name": "a", "ConnectionProperties": {"k": "v"}},), ({"Name": "b", "ConnectionProperties": None},)],
        "c struct<Name:string, ConnectionProperties:map<string,string>>",
    )
    out = default_map_field(df, "ConnectionProperties", struct_column="c").collect()
    assert out[0].c.ConnectionProperties == {"k": "v"}
    assert out[1].c.ConnectionProperties == {}
    absent = spark.createDataFrame([({"Name": "a"},)], "c struct<Name:string>")
    out = default_map_field(absent, "ConnectionProperties", struct_column="c").collect()
    assert out[0].c.ConnectionProperties == {}
    top = default_map_field(spark.createDataFrame([(1,)], "id int"), "props").collect()
    assert top[0].props == {}


def test_lift_nested_field(spark):
    df = spark.createDataFrame([({"DatabaseName": "db", "Name": "t"},)], "t struct<DatabaseName:string, Name:string>")
    out = lift_nested_field(df, "t", "DatabaseName")
    assert out.columns == ["t", "DatabaseName"]
    assert out.schema["t"].dataType.fieldNames() == ["Name"]
    assert out.first().DatabaseName == "db"


def test_name_list_parsing():
    assert parse_name_list(None) is None
    assert parse_name_list("") is None
    assert parse_name_list("a, b") == ["a", " b"]


def test_filter_by_names(spark):
    df = spark.createDataFrame([("a",), ("b",), (" b",), (None,)], "n string")
    assert filter_by_names(df, "n", None).count() == 4
    assert sorted(r.n for r in filter_by_names(df, "n", "a, b").collect()) == [" b", "a"]
    names = spark.createDataFrame([("b",)], "x string")
    assert [r.n for r in filter_by_names(df, "n", names).collect()] == ["b"]


def test_skip_rules_first_match_wins_null_counts_false(spark):
    df = spark.createDataFrame(
        [(1, True, True), (2, False, False), (3, None, True), (4, None, None)], "id int, a boolean, b boolean"
    )
    out = skip_rules(df, [("rule_a", F.col("a")), ("rule_b", F.col("b"))])
    got = {r.id: r.skip_reason for r in out.collect()}
    assert got == {1: "rule_a", 2: None, 3: "rule_b", 4: None}
    assert sorted(r.id for r in keep_unskipped(out).collect()) == [2, 4]


def test_composite_key_filter(spark):
    df = spark.createDataFrame([("d", "t", 1), ("d", "u", 2), (None, "t", 3)], "db string, t string, v int")
    assert [r.v for r in composite_key_filter(df, {"db": "d", "t": "t"}).collect()] == [1]
    keys = spark.createDataFrame([("d", "u"), (None, "t")], "db string, t string")
    assert [r.v for r in composite_key_filter(df, keys).collect()] == [2]


def test_prefix_filter_null_and_empty(spark):
    df = spark.createDataFrame([("dev-x",), ("",), (None,), ("prod",)], "tag string")
    assert [r.tag for r in prefix_filter(df, "tag", "dev").collect()] == ["dev-x"]
    assert [r.tag for r in prefix_filter(df, "tag", "").collect()] == ["dev-x", "prod"]
    flags = df.select(starts_with("tag", "dev").alias("f")).collect()
    assert [r.f for r in flags] == [True, False, False, False]


def test_drop_fields_dotted_paths(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1, "b": {"c": 2, "d": 3}})], "id int, s struct<a:int, b:struct<c:int, d:int>>"
    )
    out = drop_fields(df, ["s.b.c", "s.zz", "nope.x", "id.x"])
    assert out.schema["s"].dataType.simpleString() == "struct<a:int,b:struct<d:int>>"
    assert out.columns == ["id", "s"]
    dotted = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert drop_fields(dotted, ["a.b"]).columns == ["c"]


def test_rename_nested_paths(spark):
    df = spark.createDataFrame(
        [(1, {"first": "a", "inner": {"x": 1, "y": 2}}), (2, None)],
        "id int, info struct<first:string, inner:struct<x:int, y:int>>",
    )
    out = rename_fields(df, [("info.first", "info.given"), ("info.inner.x", "info.inner.z"), ("info.nope", "info.q")])
    assert out.schema["info"].dataType.simpleString() == "struct<given:string,inner:struct<z:int,y:int>>"
    rows = out.orderBy("id").collect()
    assert rows[0].info.given == "a" and rows[0].info.inner.z == 1 and rows[1].info is None
    with pytest.raises(ValueError):
        rename_fields(df, [("info.first", "other.first")])
    with pytest.raises(ValueError):
        rename_fields(df, [("info.first", "info.inner")])
