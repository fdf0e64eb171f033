from pyspark.sql import functions as F

from tableflow.plans.sync import DefinitionSync


def defs(spark):
    return spark.createDataFrame(
        [
            ("a", "{role}", {"Name": "etl", "ScriptLocation": "{root}/scripts/a.py"}, {"n": "x"}, 1, 0),
            ("a", "{role}-2", {"Name": "etl", "ScriptLocation": "{root}/scripts/a.py"}, {"n": "x"}, 1, 1),
            ("b", "{role}", {"Name": "etl", "ScriptLocation": "{root}/scripts/b.py"}, None, 2, 0),
            ("c", "{role}", {"Name": "etl", "ScriptLocation": "{root}/scripts/c.py"}, {"{role}": "y"}, 3, 0),
        ],
        "Name string, Role string, Command struct<Name:string, ScriptLocation:string>, "
        "CodeGenConfigurationNodes map<string,string>, MaxCapacity int, seq int",
    )


MAPPING = [("{role}", "arn:r"), ("{root}", "s3://x")]


def job_sync() -> DefinitionSync:
    return DefinitionSync(
        mapping=MAPPING,
        name_prefix="dev-",
        skip_rules=[("no_dag", F.col("CodeGenConfigurationNodes").isNull())],
        order_by=("seq",),
    )


def test_plan_from_a_name_list(spark):
    target = spark.createDataFrame([("dev-c",)], "n string")
    sync = job_sync()
    rows = {r.requested_name: r for r in sync.plan(defs(spark), target, "a,b,c,zz").collect()}
    assert rows["a"].action == "create" and rows["a"].Role == "arn:r-2"
    assert rows["a"].Name == "dev-a" and rows["a"].Command.ScriptLocation == "s3://x/scripts/dev-a.py"
    assert rows["b"].skip_reason == "no_dag" and rows["b"].action is None
    assert rows["c"].action == "overwrite"
    assert rows["c"].CodeGenConfigurationNodes == {"{role}": "y"}  # map keys untouched
    assert rows["zz"].found is False and rows["zz"].action is None
    assert "MaxCapacity" not in sync.plan(defs(spark), target).columns


def test_plan_all_definitions_without_overwrite(spark):
    target = spark.createDataFrame([("dev-c",)], "n string")
    sync = DefinitionSync(mapping=MAPPING, name_prefix="dev-", order_by=("seq",), allow_overwrite=False)
    rows = {r.requested_name: r.action for r in sync.plan(defs(spark), target).collect()}
    assert rows == {"a": "create", "b": "create", "c": "keep"}


def test_connection_defaults_and_apply(spark):
    from tableflow.plans.sync import CONNECTION_SYSTEM_FIELDS, apply_plan

    conns = spark.createDataFrame(
        [("jdbc", {"URL": "{host}/db"}, "READY"), ("bare", None, "READY")],
        "Name string, ConnectionProperties map<string,string>, Status string",
    )
    sync = DefinitionSync(
        mapping=[("{host}", "jdbc:pg://h")], script_field=None,
        system_fields=CONNECTION_SYSTEM_FIELDS, default_maps=("ConnectionProperties",),
    )
    target = spark.createDataFrame([("jdbc", {"URL": "old"}), ("keep", {})], "Name string, ConnectionProperties map<string,string>")
    plan = sync.plan(conns, target.select("Name"))
    rows = {r.Name: (r.action, r.ConnectionProperties) for r in plan.collect()}
    assert rows == {"jdbc": ("overwrite", {"URL": "jdbc:pg://h/db"}), "bare": ("create", {})}
    assert "Status" not in plan.columns
    after = {r.Name: r.ConnectionProperties for r in apply_plan(target, plan, "Name").collect()}
    assert after == {"jdbc": {"URL": "jdbc:pg://h/db"}, "bare": {}, "keep": {}}
