import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tableflow.sinks.csv import _shape, guarded_csv_export, output_file_stats, read_csv, single_file_csv, write_csv
from tableflow.sinks.json import write_json
from tableflow.sinks.partitioned import partition_upsert
from tableflow.sources.jdbc import jdbc_options
from tableflow.sources.json import read_json, read_json_documents
from tableflow.sources.schema import apply_schema

SCHEMA = "id INT, s STRING, ts TIMESTAMP_NTZ"
TS = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)


def edge_rows(spark):
    rows = [(1, None, TS), (2, "", TS), (3, 'say "hi"', TS), (4, "a,b", TS), (5, "line\nbreak", TS)]
    return spark.createDataFrame(rows, SCHEMA)


def test_csv_round_trip_edge_values(spark, scratch):
    path = write_csv(edge_rows(spark), scratch())
    back = {r.id: r for r in read_csv(spark, path, SCHEMA, multi_line=True).collect()}
    assert back[1].s is None and back[2].s is None  # "" and null both read as null
    assert back[3].s == 'say "hi"' and back[4].s == "a,b" and back[5].s == "line\nbreak"
    assert all(r.ts == TS for r in back.values())  # microseconds survive


def test_guarded_export_keeps_old_output_when_empty(spark, scratch):
    path = scratch()
    df = edge_rows(spark)
    _, wrote = guarded_csv_export(df.filter(F.col("id") == 1), path)
    assert wrote
    _, wrote = guarded_csv_export(df.filter(F.col("id") > 100), path)
    assert not wrote
    assert [r.id for r in read_csv(spark, path, SCHEMA).collect()] == [1]
    _, wrote = guarded_csv_export(df.filter(F.col("id") == 4), path)
    assert [r.id for r in read_csv(spark, path, SCHEMA).collect()] == [4]


@pytest.mark.parametrize("strategy", ["repartition", "coalesce"])
def test_single_file(spark, scratch, strategy):
    df = spark.range(1000).repartition(7).selectExpr("CAST(id AS INT) id", "'x' s", "TIMESTAMP_NTZ'2024-01-01' ts")
    path = single_file_csv(df, scratch(), strategy=strategy)
    stats = output_file_stats(spark, path, SCHEMA).first()
    assert (stats.n_files, stats.n_rows) == (1, 1000)


def test_single_file_reads_packed_batches(spark, scratch):
    """The one task that writes reads batches, with every kind of value."""
    kinds = "i int, l bigint, d double, n decimal(9,2), b boolean, s string, o date, z timestamp, w timestamp_ntz"
    stamp = dt.datetime(2024, 5, 6, 7, 8, 9, 12)
    rows = [(i, -i << 40, i / 7, decimal.Decimal(i) / 4, i % 2 == 0, f' a"{i}, ', stamp.date(), stamp, stamp) for i in range(50)]
    df = spark.createDataFrame([*rows, (None,) * 9], kinds).repartition(3)
    packed = _shape(df, 1, "packed")
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2 and packed.dtypes == df.dtypes
    lines = [sorted(r.value for r in spark.read.text(single_file_csv(df, scratch(s), strategy=s)).collect()) for s in ("packed", "repartition")]
    assert lines[0] == lines[1] and len(lines[0]) == 51
    spans = spark.sql("SELECT INTERVAL '3' DAY AS s")  # not packed
    assert spark.read.text(single_file_csv(spans, scratch("spans"))).count() == 1


def test_json_recursive_scan_and_schema(spark, scratch):
    base = scratch()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, s STRING")
    write_json(df.filter("id = 1"), f"{base}/x")
    write_json(df.filter("id = 2"), f"{base}/y/z")
    back = read_json(spark, base)
    assert dict(back.dtypes)["id"] == "bigint"  # inference widens
    typed = apply_schema(back, "id INT, s STRING")
    assert sorted(tuple(r) for r in typed.collect()) == [(1, "a"), (2, "b")]


def test_json_sink_writes_times_as_text(spark, scratch):
    df = spark.createDataFrame(
        [(TS, dt.date(2024, 1, 2)), (dt.datetime(2024, 1, 2), None)], "ts TIMESTAMP_NTZ, d DATE"
    )
    path = write_json(df, scratch())
    texts = sorted(r.value for r in spark.read.text(path).collect())
    assert texts == ['{"ts":"2024-01-02 00:00:00","d":null}', '{"ts":"2024-01-02 03:04:05.123456","d":"2024-01-02"}']


def test_apply_schema_missing(spark):
    df = spark.createDataFrame([(1,)], "a INT")
    with pytest.raises(ValueError):
        apply_schema(df, "a INT, b STRING")
    out = apply_schema(df, "a BIGINT, b STRING", missing="null")
    assert out.dtypes == [("a", "bigint"), ("b", "string")] and out.first().b is None


def test_json_documents_pretty_and_missing_array(spark, scratch):
    base = scratch()
    import os
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/doc1.json", "w") as f:
        f.write('{\n  "jobs": [\n    {"Name": "a", "MaxRetries": 1},\n    {"Name": "b"}\n  ]\n}\n')
    with open(f"{base}/doc2.json", "w") as f:
        f.write('{\n  "databases": [{"Name": "d"}]\n}\n')
    rows = read_json_documents(spark, base, "jobs", "Name STRING, MaxRetries INT").collect()
    assert sorted((r.Name, r.MaxRetries) for r in rows) == [("a", 1), ("b", None)]


def test_partition_upsert(spark, scratch):
    path = scratch()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "v INT, p STRING")
    partition_upsert(df, path, ["p"])
    partition_upsert(spark.createDataFrame([(20, "b"), (40, "d")], "v INT, p STRING"), path, ["p"])
    back = sorted(tuple(r) for r in spark.read.schema("v INT, p STRING").parquet(path).collect())
    assert back == [(1, "a"), (3, "c"), (20, "b"), (40, "d")]


def test_jdbc_options_validation():
    opts = jdbc_options("jdbc:postgresql://h/db", "member", partition_column="member_id",
                        lower_bound=0, upper_bound=100, num_partitions=4)
    assert opts["numPartitions"] == "4" and opts["partitionColumn"] == "member_id"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")


def test_read_jdbc_reaches_driver_lookup(spark):
    """No database is started in this build; the reader's wiring is checked
    up to the JDBC driver lookup (no PostgreSQL driver is on the class path,
    so nothing is contacted)."""
    from tableflow.sources.jdbc import read_jdbc

    with pytest.raises(Exception) as err:
        read_jdbc(spark, "jdbc:postgresql://db.invalid/postgres", "member",
                  properties={"driver": "org.postgresql.Driver"})
    assert "org.postgresql.Driver" in str(err.value) or "ClassNotFound" in str(err.value)


def test_apply_schema_nested_and_odd_names(spark):
    df = spark.createDataFrame([(1, {"a b": 2})], "`x y` INT, s STRUCT<`a b`: INT>")
    out = apply_schema(df, "`x y` BIGINT, s STRUCT<`a b`: BIGINT>")
    assert out.dtypes == [("x y", "bigint"), ("s", "struct<a b:bigint>")]
    assert out.first()["s"]["a b"] == 2


def test_resource_documents_round_trip(spark, scratch):
    from tableflow.sinks.json import write_resource_documents

    jobs = spark.createDataFrame([("a", 1, TS), ("b", None, TS)], "Name STRING, MaxRetries INT, CreatedOn TIMESTAMP_NTZ")
    dbs = spark.createDataFrame([("d",)], "Name STRING")
    path = write_resource_documents({"jobs": jobs, "databases": dbs}, scratch())
    back = read_json_documents(spark, path, "jobs", "Name STRING, MaxRetries INT, CreatedOn STRING", multi_line=False)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(
        [("a", 1, "2024-01-02 03:04:05.123456"), ("b", None, "2024-01-02 03:04:05.123456")], key=str
    )
    assert read_json_documents(spark, path, "tables", "Name STRING", multi_line=False).count() == 0


def test_csv_compression_and_header(spark, scratch):
    import os

    df = spark.createDataFrame([(1, "a", TS), (2, "b", TS)], SCHEMA)
    path = write_csv(df, scratch(), compression="gzip", header=True, num_files=1)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 1 and files[0].endswith(".csv.gz")
    back = read_csv(spark, path, SCHEMA, header=True)
    assert sorted(r.id for r in back.collect()) == [1, 2]
    raw = spark.read.text(path).collect()
    assert raw[0].value == "id,s,ts"


def test_json_sink_nested_times_as_text(spark, scratch):
    df = spark.createDataFrame(
        [({"at": TS, "n": 1}, [dt.date(2024, 1, 2)], {"k": TS})],
        "s STRUCT<at: TIMESTAMP_NTZ, n: INT>, arr ARRAY<DATE>, m MAP<STRING, TIMESTAMP_NTZ>",
    )
    path = write_json(df, scratch())
    text = spark.read.text(path).first().value
    assert text == (
        '{"s":{"at":"2024-01-02 03:04:05.123456","n":1},"arr":["2024-01-02"],'
        '"m":{"k":"2024-01-02 03:04:05.123456"}}'
    )


def test_jdbc_bounds_query():
    from tableflow.sources.jdbc import bounds_query

    q = bounds_query("public.member", "member_id")
    assert q == "(SELECT MIN(member_id) AS lo, MAX(member_id) AS hi FROM public.member) tableflow_bounds"


def test_json_sink_zoned_timestamp_like_python_str(spark, scratch):
    import datetime as _dt

    aware = [_dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=_dt.timezone.utc),
             _dt.datetime(2024, 1, 2, 3, 4, 5, 123456, tzinfo=_dt.timezone.utc)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(aware)], "i INT, ts TIMESTAMP")
    path = write_json(df, scratch())
    got = {r.i: r.ts for r in spark.read.schema("i INT, ts STRING").json(path).collect()}
    assert got == {i: str(t) for i, t in enumerate(aware)}


def test_compressed_json_in_files_of_some_rows(spark, scratch):
    from tableflow.sources.json import read_json

    path = write_json(spark.range(25).coalesce(1), scratch(), compression="gzip", rows_per_file=10)
    files = read_json(spark, path).inputFiles()
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    assert sorted(r.id for r in read_json(spark, path).collect()) == list(range(25))


def test_bridge_join_json_writes_less_than_its_text(spark, monkeypatch):
    import os

    from conftest import SF_SMALL
    from tableflow import queries

    written = []
    monkeypatch.setattr(queries, "write_json", lambda df, path, **kw: written.append((df, write_json(df, path, **kw))) or path)
    queries.q_bridge_join_json(spark, SF_SMALL)
    for df, path in written:
        text = sum(len(r.value) + 1 for r in spark.read.text(path).collect())
        size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
        assert spark.read.text(path).count() == df.count() and size < text / 2
