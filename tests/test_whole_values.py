"""Values, orders and keys that must come through unchanged."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tableflow.functions.config import flatten_placeholders, malformed_documents
from tableflow.functions.nested import substitute_nested
from tableflow.functions.text import collect_mapping, substitute
from tableflow.operators.filters import composite_key_filter, filter_by_names
from tableflow.operators.quality import non_empty
from tableflow.plans.catalog import CatalogSync
from tableflow.plans.export import fan_out
from tableflow.plans.sync import DefinitionSync
from tableflow.session import shared_dir
from tableflow.sinks.csv import output_file_stats, read_csv, single_file_csv, write_csv
from tableflow.sinks.json import write_json, write_resource_documents
from tableflow.sources.jdbc import read_jdbc
from tableflow.sources.json import read_json, read_json_documents
from tableflow.sources.schema import apply_schema


def test_csv_keeps_white_space(spark, scratch):
    rows = [(1, "  pad  "), (2, "\t"), (3, " x"), (4, "y ")]
    path = write_csv(spark.createDataFrame(rows, "i int, s string"), scratch())
    assert sorted(map(tuple, read_csv(spark, path, "i INT, s STRING").collect())) == rows
    trimmed = write_csv(spark.createDataFrame(rows[:1], "i int, s string"), scratch("t"), trim=True)
    assert read_csv(spark, trimmed, "i INT, s STRING").first().s == "pad"


def test_empty_single_file_is_counted(spark, scratch):
    path = single_file_csv(spark.createDataFrame([], "i int"), scratch())
    assert tuple(output_file_stats(spark, path, "i INT").first()) == (1, 0)


def test_malformed_json_raises(spark, scratch):
    path = scratch()
    spark.createDataFrame([('{"i":1,"s":"a"}',), ('{"i":2,"s":',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        read_json(spark, path, "i INT, s STRING").collect()
    kept = read_json(spark, path, "i INT, s STRING", corrupt_column="bad").collect()
    assert sorted((r.i is None, r.bad) for r in kept) == [(False, None), (True, '{"i":2,"s":')]
    doc = scratch("doc")
    spark.createDataFrame([('{"jobs": [{"Name": "a"}, {"Na',)], "value string").coalesce(1).write.text(doc)
    with pytest.raises(Exception):
        read_json_documents(spark, doc, "jobs", "Name STRING").collect()


def test_json_keeps_null_columns(spark, scratch):
    df = spark.createDataFrame([(1, None, (None, "x")), (2, None, None)], "i int, gone string, s struct<a:string,b:string>")
    path = write_json(df, scratch())
    back = read_json(spark, path)
    assert set(back.columns) == {"i", "gone", "s"}
    assert apply_schema(read_json(spark, path), "i INT, gone STRING").count() == 2
    texts = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {"i": 1, "gone": None, "s": {"a": None, "b": "x"}} in texts


def test_pretty_printed_document_of_several_kinds(spark, scratch):
    path = scratch()
    doc = {"databases": [{"Name": "d"}], "jobs": [{"Name": "a", "Role": None}, {"Name": "b"}], "tables": []}
    spark.createDataFrame([(json.dumps(doc, indent=4),)], "value string").coalesce(1).write.text(path)
    assert sorted(r.Name for r in read_json_documents(spark, path, "jobs", "Name STRING, Role STRING").collect()) == ["a", "b"]
    assert [r.Name for r in read_json_documents(spark, path, "databases", "Name STRING").collect()] == ["d"]
    assert read_json_documents(spark, path, "tables", "Name STRING").count() == 0
    out = write_resource_documents({"jobs": spark.createDataFrame([("a", None)], "Name string, Role string")}, scratch("o"))
    assert json.loads(spark.read.text(f"{out}/jobs").first().value) == {"jobs": [{"Name": "a", "Role": None}]}


def _flat(doc):
    out = {}
    for k, v in doc.items():
        if isinstance(v, str):
            out["{" + k + "}"] = v
        elif k == "jobs" and isinstance(v, dict):
            for job, members in v.items():
                for x, y in members.items() if isinstance(members, dict) else ():
                    if isinstance(y, str):
                        out["{" + job + "." + x + "}"] = y
    return list(out.items())


def test_config_order_is_document_order(spark):
    docs = [
        {"jobs": {"j": {"k": "v"}}, "z": "1"},
        {"a": "1", "jobs": {"j": {"k": "v", "a": "w"}, "b": {"x": "y"}}, "z": "2"},
        {"jobs": {"j": {"k": "v"}}, "j.k": "TOP"},
        {"j.k": "TOP", "jobs": {"j": {"k": "v"}}, "n": 1, "l": ["x"], "jobs2": {"a": "b"}},
        {"jobs": '{"j": {"k": "v"}}', "e": ""},
    ]
    r = random.Random(3)
    for _ in range(40):
        items = [(c, r.choice(["s", 1, None, {"x": "y"}])) for c in r.sample("abcdefg", 4)]
        items.insert(r.randrange(5), ("jobs", {j: r.choice([{"k": "1", "a": "2"}, "s", 3]) for j in r.sample("mnop", 2)}))
        docs.append(dict(items))
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, doc string")
    got = {}
    for row in flatten_placeholders(df, "doc", keep=["i"]).orderBy("i", "ordinal").collect():
        got.setdefault(row.i, []).append((row.placeholder, row.value))
    assert [got.get(i, []) for i in range(len(docs))] == [_flat(x) for x in docs]


def test_malformed_config_is_loud_or_reported(spark):
    df = spark.createDataFrame([(1, '{"a": "b"}'), (2, '{"a": '), (3, None)], "`a.b` int, doc string")
    assert [r["a.b"] for r in malformed_documents(df, "doc").collect()] == [2]
    with pytest.raises(Exception):
        flatten_placeholders(df, "doc", keep=["a.b"]).collect()
    assert flatten_placeholders(df.where("doc is null or `a.b` = 1"), "doc", keep=["a.b"]).columns[0] == "a.b"


def test_long_mappings_and_mapping_columns(spark):
    pairs = [(f"{{p{i}}}", f"v{i}" if i else "{p1}") for i in range(5000)]
    df = spark.createDataFrame([("{p0} {p4999} {none}", {"k": "{p7}"})], "s string, m map<string,string>")
    assert df.select(substitute("s", pairs)).first()[0] == "v1 v4999 {none}"
    assert substitute_nested(df, pairs).first().m == {"k": "v7"}
    rows = spark.createDataFrame([(1, 1, "{b}", "x"), (1, 0, "{a}", "{b}{b}")], "k int, ordinal int, placeholder string, value string")
    text = spark.createDataFrame([(1, "{a}-{b}"), (2, "{a}")], "k int, s string")
    joined = text.join(collect_mapping(rows, ["k"]), "k", "left")
    assert {r.k: r.t for r in joined.select("k", substitute("s", F.col("mapping")).alias("t")).collect()} == {1: "xx-x", 2: "{a}"}


def test_variant_is_refused(spark):
    df = spark.sql("select parse_json('{\"a\": \"{x}\"}') v, '{x}' s")
    with pytest.raises(TypeError):
        substitute_nested(df, {"{x}": "y"})
    assert substitute_nested(df, {"{x}": "y"}, columns=["s"]).select("s").first().s == "y"


def test_filters_keep_column_order(spark):
    df = spark.createDataFrame([(1, 2, "x"), (3, 4, "y")], "a int, b int, c string")
    keys = spark.createDataFrame([("x",)], "c string")
    for out in (composite_key_filter(df, keys), filter_by_names(df, "c", keys)):
        assert out.columns == ["a", "b", "c"] and out.collect()[0].a == 1
    assert composite_key_filter(df, df.select("c", "a")).columns == ["a", "b", "c"]


def test_jobs_are_looked_up_by_their_raw_name(spark):
    defs = spark.createDataFrame([("{env}_job", "{env}"), ("{env}_new", "{env}")], "Name string, Role string")
    target = spark.createDataFrame([("{env}_job",)], "n string")
    sync = DefinitionSync(mapping=[("{env}", "dev")], script_field=None)
    rows = {r.Role + r.action: r.Name for r in sync.plan(defs, target).collect()}
    assert rows == {"devoverwrite": "{env}_job", "devcreate": "dev_new"}
    raw = DefinitionSync(mapping=[("{env}", "dev")], script_field=None, substitute_name=False)
    assert {r.Name for r in raw.plan(defs, target).collect()} == {"{env}_job", "{env}_new"}


def _catalog(spark):
    dbs = spark.createDataFrame([("{env}_d", "{env}"), ("other", "")], "Name string, Description string")
    tables = spark.createDataFrame([("{env}_d", "{env}_t", "EXTERNAL_TABLE"), ("{env}_d", "u", "EXTERNAL_TABLE")], "DatabaseName string, Name string, TableType string")
    parts = spark.createDataFrame([("{env}_d", "{env}_t", ["{env}", "1"]), ("{env}_d", "{env}_t", ["1", "{env}"])], "DatabaseName string, TableName string, Values array<string>")
    target = (
        spark.createDataFrame([("{env}_d",)], "n string"),
        spark.createDataFrame([("{env}_d", "{env}_t")], "d string, t string"),
        spark.createDataFrame([("dev_d", "dev_t", ["dev", "1"])], "d string, t string, v array<string>"),
    )
    return dbs, tables, parts, *target


def test_catalog_keys_by_kind(spark):
    plans = CatalogSync(mapping=[("{env}", "dev")]).plan(*_catalog(spark))
    assert {(r.Name, r.action, r.Description) for r in plans["databases"].collect()} == {("{env}_d", "overwrite", "dev"), ("other", "create", "")}
    assert {(r.DatabaseName, r.Name, r.action) for r in plans["tables"].collect()} == {("dev_d", "dev_t", "overwrite"), ("dev_d", "u", "create")}
    assert {(r.DatabaseName, r.TableName, tuple(r.Values), r.action) for r in plans["partitions"].collect()} == {
        ("dev_d", "dev_t", ("dev", "1"), "overwrite"),
        ("dev_d", "dev_t", ("1", "dev"), "create"),
    }
    assert "not_found" not in plans


def test_catalog_names_and_not_found(spark):
    plans = CatalogSync().plan(*_catalog(spark), database_names="{env}_d,nope", table_names=["u", "zz"])
    assert [r.Name for r in plans["databases"].collect()] == ["{env}_d"]
    assert [r.Name for r in plans["tables"].collect()] == ["u"]
    assert {tuple(r) for r in plans["not_found"].collect()} == {("database", "nope"), ("table", "zz")}


def test_fan_out_leaves_the_callers_cache(spark):
    df = spark.range(10).cache()
    fan_out(df, {"n": lambda x: x.count()}, persist=True)
    assert df.is_cached
    df.unpersist()
    own = spark.range(10)
    fan_out(own, {"n": lambda x: x.count()}, persist=True)
    assert not own.is_cached


def test_non_empty(spark):
    assert non_empty(spark.range(5)).first()[0] is True
    assert non_empty(spark.range(0)).first()[0] is False


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_jdbc_split_needs_a_count_first(spark):
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x", "t", partition_column="id")
