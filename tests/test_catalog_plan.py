from tableflow.plans.catalog import CatalogSync


def test_catalog_cascade_skip_and_partition_overwrite(spark):
    dbs = spark.createDataFrame(
        [("d1", "{env} one", None, "c"), ("d2", "two", "linked", "c"), ("d3", "three", None, "c")],
        "Name string, Description string, TargetDatabase string, CatalogId string",
    )
    tables = spark.createDataFrame(
        [("d1", "t1", "EXTERNAL_TABLE", None, "{env}/t1", "v1"),
         ("d1", "g", "GOVERNED", None, "x", "v1"),
         ("d1", "l", "EXTERNAL_TABLE", "other", "x", "v1"),
         ("d2", "t2", "EXTERNAL_TABLE", None, "x", "v1"),
         ("d9", "orphan", "EXTERNAL_TABLE", None, "x", "v1")],
        "DatabaseName string, Name string, TableType string, TargetTable string, Location string, VersionId string",
    )
    parts = spark.createDataFrame(
        [("d1", "t1", ["2024", "01"], "{env}/p1", "c"), ("d1", "t1", ["2024", "02"], "p2", "c"),
         ("d1", "g", ["2024", "01"], "p3", "c"), ("d2", "t2", ["2024", "01"], "p4", "c")],
        "DatabaseName string, TableName string, Values array<string>, Location string, CatalogId string",
    )
    tgt_dbs = spark.createDataFrame([("d1",)], "n string")
    tgt_tabs = spark.createDataFrame([("d1", "t1")], "d string, n string")
    tgt_parts = spark.createDataFrame([("d1", "t1", ["2024", "01"]), ("d1", "t1", ["01", "2024"])],
                                      "d string, t string, v array<string>")
    plans = CatalogSync(mapping=[("{env}", "dev")], overwrite_databases=False).plan(
        dbs, tables, parts, tgt_dbs, tgt_tabs, tgt_parts
    )
    d = {r.Name: (r.skip_reason, r.action, r.Description) for r in plans["databases"].collect()}
    assert d == {"d1": (None, "keep", "dev one"), "d2": ("resource_link", None, "two"), "d3": (None, "create", "three")}
    assert "CatalogId" not in plans["databases"].columns
    t = {r.Name: (r.skip_reason, r.action) for r in plans["tables"].collect()}
    assert t == {"t1": (None, "overwrite"), "g": ("governed", None), "l": ("resource_link", None)}
    assert "VersionId" not in plans["tables"].columns
    p = {tuple(r.Values): (r.action, r.Location) for r in plans["partitions"].collect()}
    assert p == {("2024", "01"): ("overwrite", "dev/p1"), ("2024", "02"): ("create", "p2")}
