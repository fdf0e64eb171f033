import pytest
from pyspark.sql import functions as F

from tableflow.operators.joins import bridge_join, cascade_chain, equi_join, lookup_report
from tableflow.operators.quality import keep_last
from tableflow.operators.reconcile import insert_missing, partition_match, sync_plan, upsert


def test_equi_join_null_and_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, lv string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "m")], "rk int, rv string")
    out = equi_join(left, right, "k", "rk")
    assert out.columns == ["k", "lv", "rk", "rv"]
    assert out.count() == 4  # 2 x 2 on key 1, nulls never match


def test_equi_join_collision_policy(spark):
    left = spark.createDataFrame([(1, "a")], "k int, name string")
    right = spark.createDataFrame([(1, "b")], "k2 int, name string")
    with pytest.raises(ValueError):
        equi_join(left, right, "k", "k2")
    out = equi_join(left, right, "k", "k2", on_collision="prefix_right")
    assert out.columns == ["k", "name", "k2", "right_name"]
    assert out.first().right_name == "b"


def test_self_join_is_unambiguous(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "id int, parent int")
    out = equi_join(df, df, "parent", "id", on_collision="prefix_right")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 2, 3)]


def test_bridge_join_drops_keys(spark):
    orgs = spark.createDataFrame([(10, "org")], "org_id int, org_name string")
    persons = spark.createDataFrame([(1, "p")], "id int, pname string")
    members = spark.createDataFrame([(1, 10, "m"), (2, 10, "x")], "person_id int, organization_id int, role string")
    out = bridge_join(orgs, persons, members, "id", "person_id", "org_id", "organization_id")
    assert out.columns == ["org_name", "id", "pname", "organization_id", "role"]
    assert out.count() == 1


def test_lookup_report_found_flag(spark):
    names = spark.createDataFrame([("a",), ("zz",), ("a",)], "name string")
    defs = spark.createDataFrame([("a", 1)], "Name string, v int")
    out = sorted(lookup_report(names, "name", defs, "Name").collect(), key=lambda r: r.name)
    assert [(r.name, r.found, r.v) for r in out] == [("a", True, 1), ("a", True, 1), ("zz", False, None)]


def test_cascade_chain(spark):
    dbs = spark.createDataFrame([("d1",)], "db string")
    tables = spark.createDataFrame([("d1", "t1"), ("d2", "t2")], "db string, t string")
    parts = spark.createDataFrame([("d1", "t1", "p"), ("d2", "t2", "q"), ("d1", "t9", "r")], "db string, t string, v string")
    _, t_out, p_out = cascade_chain([dbs, tables, parts], ["db", {"db": "db", "t": "t"}])
    assert [r.t for r in t_out.collect()] == ["t1"]
    assert [r.v for r in p_out.collect()] == ["p"]


def test_keep_last_picks_greatest_order(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 5, "only")], "k string, pos int, v string")
    got = {r.k: r.v for r in keep_last(df, "k", "pos").collect()}
    assert got == {"a": "new", "b": "only"}
    assert keep_last(df, "k", "pos").columns == df.columns


@pytest.fixture
def inventories(spark):
    target = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "k int, v string")
    source = spark.createDataFrame([(2, "s2"), (4, "s4")], "k int, v string")
    return target, source


def test_sync_plan(inventories):
    target, source = inventories
    plan = {r.k: r.action for r in sync_plan(source, target, "k").collect()}
    assert plan == {2: "overwrite", 4: "create"}
    plan = {r.k: r.action for r in sync_plan(source, target, "k", allow_overwrite=False).collect()}
    assert plan == {2: "keep", 4: "create"}


def test_upsert_and_insert_missing(inventories):
    target, source = inventories
    up = {r.k: r.v for r in upsert(target, source, "k").collect()}
    assert up == {1: "t1", 2: "s2", 3: "t3", 4: "s4"}
    ins = {r.k: r.v for r in insert_missing(target, source, "k").collect()}
    assert ins == {1: "t1", 2: "t2", 3: "t3", 4: "s4"}


def test_upsert_idempotent_and_counts_agree_with_plan(inventories):
    target, source = inventories
    once = upsert(target, source, "k")
    twice = upsert(once, source, "k")
    assert sorted(once.collect()) == sorted(twice.collect())
    creates = sync_plan(source, target, "k").filter(F.col("action") == "create").count()
    assert once.count() == target.count() + creates


def test_upsert_duplicate_source_keys_and_empties(spark, inventories):
    target, _ = inventories
    dup = spark.createDataFrame([(2, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    out = upsert(target.withColumn("seq", F.lit(0)), dup, "k", order_by="seq")
    assert {r.k: r.v for r in out.collect()} == {1: "t1", 2: "b", 3: "t3"}
    empty = spark.createDataFrame([], "k int, v string")
    assert sorted(upsert(target, empty, "k").collect()) == sorted(target.collect())
    assert sorted(r.k for r in upsert(empty, target, "k").collect()) == [1, 2, 3]


def test_partition_match_same_values_same_order(spark):
    entries = spark.createDataFrame([(["2024", "01"], "a"), (["01", "2024"], "b")], "values array<string>, loc string")
    errors = spark.createDataFrame([(["2024", "01"],)], "values array<string>")
    out = partition_match(errors, entries, "values").collect()
    assert [r.loc for r in out] == ["a"]


def test_lookup_report_small_names_prefilter(spark):
    names = spark.createDataFrame([("a",), ("zz",), ("a",)], "name string")
    defs = spark.createDataFrame([("a", 1), ("b", 2)], "Name string, v int")
    for small in (False, True):
        out = sorted(lookup_report(names, "name", defs, "Name", names_are_small=small).collect(), key=lambda r: r.name)
        assert [(r.name, r.found, r.v) for r in out] == [("a", True, 1), ("a", True, 1), ("zz", False, None)]


def test_small_source_prefilter_gives_same_results(inventories):
    target, source = inventories
    for small in (False, True):
        plan = {r.k: r.action for r in sync_plan(source, target, "k", small_source=small).collect()}
        assert plan == {2: "overwrite", 4: "create"}
        ins = {r.k: r.v for r in insert_missing(target, source, "k", small_source=small).collect()}
        assert ins == {1: "t1", 2: "t2", 3: "t3", 4: "s4"}


def test_partition_match_shared_columns(spark):
    entries = spark.createDataFrame([(["a"], "x", 1)], "values array<string>, loc string, n int")
    rows = spark.createDataFrame([(["a"], "y"), (["b"], "z")], "values array<string>, loc string")
    out = partition_match(rows, entries, "values")
    assert out.columns == ["values", "loc", "right_loc", "n"]
    assert [tuple(r) for r in out.collect()] == [(["a"], "y", "x", 1)]


def test_equi_join_semi_and_anti(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "rk int, w string")
    assert [r.k for r in equi_join(left, right, "k", "rk", how="left_semi").collect()] == [1]
    anti = equi_join(left, right, "k", "rk", how="left_anti")
    assert anti.columns == ["k", "v"] and sorted(r.v for r in anti.collect()) == ["b", "n"]
