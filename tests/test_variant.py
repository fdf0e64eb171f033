"""JSON through VARIANT: types that drift, one parse."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from tableflow.sinks.json import write_json
from tableflow.sources.json import read_json
from tableflow.sources.variant import fitted, inferred_schema, parse_json_once, read_json_fitted

RECORDS = [
    {"id": 1, "v": 1.5, "s": "x", "o": {"a": 1}, "l": [1, 2]},
    {"id": "2", "v": "2.5", "s": 7, "o": {"a": "no"}, "l": []},
    {"id": "three", "v": None, "s": {"deep": [1]}, "l": "flat", "a.b": 5, "it's": 6, "'\"": 8, "": 7},
    {"id": 4.25, "v": True, "s": None, "o": 9},
    {},
]
DECLARED = "id BIGINT, v DOUBLE, s STRING, o STRUCT<a: INT>, l ARRAY<INT>"


def _write(spark, path, records):
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").write.text(path)
    return path


def test_declared_schema_keeps_what_does_not_fit(spark, scratch):
    got = read_json_fitted(spark, _write(spark, scratch(), RECORDS), DECLARED).collect()
    by = {json.dumps(r.asDict(True), sort_keys=True, default=str): r for r in got}
    assert len(got) == 5 and len(by) == 5
    one, two, three, four, none = (next(r for r in got if test(r)) for test in (
        lambda r: r.id == 1, lambda r: r.id == 2, lambda r: "a.b" in r.rest, lambda r: r.rest.get("o") == "9", lambda r: r.rest == {} and r.id is None))
    assert (one.v, one.s, one.o.a, one.l, one.rest) == (1.5, "x", 1, [1, 2], {})
    assert (two.v, two.s, two.o.a, two.l, two.rest) == (2.5, "7", None, [], {"o": '{"a":"no"}'})
    assert (three.id, three.v, three.s, three.l) == (None, None, '{"deep":[1]}', None)
    assert three.rest == {"id": '"three"', "l": '"flat"', "a.b": "5", "it's": "6", "'\"": "8", "": "7"}
    assert four.s is None and four.rest["o"] == "9"


def test_parts_of_nested_values_are_not_lost(spark, scratch):
    records = [{"k": 1, "o": {"a": 1, "z": 2}}, {"k": 2, "o": {"a": None}}, {"k": 3, "o": {}}, {"k": 4, "l": [1, "x"]}, {"k": 5, "l": [1, 2], "o": {"a": 5}}]
    got = {r.k: r for r in read_json_fitted(spark, _write(spark, scratch(), records), "k INT, o STRUCT<a: INT>, l ARRAY<INT>").collect()}
    assert got[1].o.a == 1 and got[1].rest == {"o": '{"a":1,"z":2}'}
    assert got[2].rest == got[3].rest == got[5].rest == {} and got[5].l == [1, 2]
    assert got[4].rest == {"l": '[1,"x"]'}


def test_records_that_are_no_objects(spark, scratch):
    got = read_json_fitted(spark, _write(spark, scratch(), [[1, 2], 3, {"id": 1}]), "id INT").collect()
    assert sorted((r.id is None, sorted(r.rest.items())) for r in got) == [(False, []), (True, [("", "3")]), (True, [("", "[1,2]")])]


def test_schema_of_drifting_records(spark, scratch):
    records = parse_json_once(spark, _write(spark, scratch(), RECORDS))
    kinds = {f.name: f.dataType.simpleString() for f in inferred_schema(records).fields}
    assert kinds == {"": "bigint", "'\"": "bigint", "a.b": "bigint", "id": "string", "it's": "bigint", "l": "string", "o": "string", "s": "string", "v": "string"}
    rows = fitted(records).collect()
    assert {(r["'\""], r[""], r["it's"], r["a.b"]) for r in rows} == {(8, 7, 6, 5), (None,) * 4}
    assert sorted(r.id or "" for r in rows) == ["", "1", "2", "4.25", "three"]
    assert all(r.rest == {} for r in rows)
    numbers = parse_json_once(spark, _write(spark, scratch("n"), [{"x": 1, "n": None}, {"x": 2.5, "n": None}]))
    assert inferred_schema(numbers).simpleString() == "struct<n:string,x:double>"
    assert inferred_schema(numbers.limit(0)).fields == []


def test_same_rows_as_a_declared_read(spark, scratch):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").drop("l_shipdate")
    path = scratch()
    write_json(lines, path)
    ours = read_json_fitted(spark, path, lines.schema, rest=None)
    assert ours.schema.simpleString() == lines.schema.simpleString()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ours) == key(read_json(spark, path, lines.schema)) == key(lines)


def test_text_is_parsed_once(spark, scratch):
    path = _write(spark, scratch(), RECORDS)
    declared = plan_text(read_json_fitted(spark, path, DECLARED))
    assert declared.count("FileScan json") == 1 and "Exchange" not in declared
    inferred = plan_text(read_json_fitted(spark, path))  # what is left reads the binary form
    assert "FileScan json" not in inferred and inferred.count("FileScan parquet") == 1


def test_malformed_raises(spark, scratch):
    path = scratch()
    spark.createDataFrame([('{"id": 1}',), ('{"id": ',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_fitted(spark, path, "id INT").agg(F.sum("id")).collect()


def test_rest_names_each_column_once(spark, scratch):
    """Columns were looked up again for every field of the record."""
    path = _write(spark, scratch(), [{"a": 1, "b": "2", "c": "x", "d": 4}])
    frame = read_json_fitted(spark, path, "a BIGINT, b INT, c INT")
    plan = plan_text(frame)
    assert plan.count("map_filter") == 1 and "map_filter(fields" in plan
    kept = plan[plan.index("map_filter(fields") :].split("\n")[0]
    assert "try_variant_get" not in kept
    row = frame.first()
    assert (row.a, row.b, row.c, row.rest) == (1, 2, None, {"c": '"x"', "d": "4"})


def test_texts_and_other_values_as_integers(spark, scratch):
    values = ["12", " 7 ", "-3", "+4", "1.5", "", "one", "1e3", "\u00a05", "\u0663", True, False, 2.0, 2.5, 1e3, None, [1], {"x": 1}, "99999999999"]
    path = _write(spark, scratch(), [{"i": i, "v": v} for i, v in enumerate(values)])
    got = {r.i: (r.v, r.rest) for r in read_json_fitted(spark, path, "i INT, v INT").collect()}
    plain = parse_json_once(spark, path, staged=False).select(F.expr("variant_get(record, '$.i', 'int')").alias("i"), F.try_variant_get("record", "$.v", "int").alias("v"))
    for r in plain.collect():
        v = values[r.i]
        assert got[r.i][0] == r.v, v
        assert ("v" in got[r.i][1]) == (r.v is None and v is not None), v


def test_many_columns_and_fields(spark, scratch):
    path = _write(spark, scratch(), [{f"f{k}": k for k in range(80)} | {"f3": "x", "more": [1]}])
    row = read_json_fitted(spark, path, ", ".join(f"f{k} INT" for k in range(80))).first()
    assert [row[f"f{k}"] for k in range(80)] == [None if k == 3 else k for k in range(80)]
    assert row.rest == {"f3": '"x"', "more": "[1]"}
