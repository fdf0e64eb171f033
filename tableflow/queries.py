"""Registered queries: each operator run over the driver's tables, with the
equivalent DuckDB SQL as an independent oracle.

Every query reads whole tables (or data Spark derives from them); queries
with sinks write to a new folder under the shared folder and read the
output back, so the result checks what landed in the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.functions.config import flatten_placeholders
from tableflow.functions.nested import substitute_nested
from tableflow.functions.text import collect_mapping, infix_path, prefix_names, split_list, substitute
from tableflow.functions.url import split_object_url
from tableflow.operators.filters import (
    composite_key_filter,
    filter_by_names,
    keep_unskipped,
    prefix_filter,
    skip_rules,
)
from tableflow.operators.joins import cascade_chain, equi_join, lookup_report
from tableflow.operators.project import (
    default_map_field,
    drop_fields,
    drop_nested_fields,
    lift_nested_field,
    rename_fields,
)
from tableflow.operators.quality import (
    expect_row_count,
    keep_last,
    non_empty,
    preview,
    row_count,
    run_gate,
)
from tableflow.operators.reconcile import (
    insert_missing,
    partition_match,
    sync_plan,
    upsert,
)
from tableflow.plans.bridge import bridge_job, bridge_job_from_json
from tableflow.plans.catalog import CatalogSync
from tableflow.plans.sync import CONNECTION_SYSTEM_FIELDS, DefinitionSync
from tableflow.plans.export import ExportJob, custom_transform, fan_out, guarded_export_step
from tableflow.session import scratch_path
from tableflow.sinks.csv import (
    guarded_csv_export,
    output_file_stats,
    read_csv,
    single_file_csv,
    write_csv,
)
from tableflow.sinks.json import write_json, write_resource_documents
from tableflow.sinks.partitioned import partition_upsert
from tableflow.sources.json import read_json, read_json_documents
from tableflow.sources.schema import apply_schema

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Declared schemas of the driver tables (as Spark reads the Parquet files).
CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
# The export job's declared output (the member-table stand-in).
ORDER_EXPORT = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate DATE, "
    "o_totalprice DOUBLE, o_orderpriority STRING"
)

# ---------------------------------------------------------------- joins


@register(
    "bridge_join",
    """
    SELECT s.s_name AS org_name, s.s_nationkey, p.*, l.* EXCLUDE (l_partkey)
    FROM part p
    JOIN lineitem l ON p.p_partkey = l.l_partkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    """,
)
def q_bridge_join(spark, d):
    """orgs = supplier, persons = part, memberships = lineitem."""
    return bridge_job(
        table(spark, d, "supplier"),
        table(spark, d, "part"),
        table(spark, d, "lineitem"),
        org_drop=["s_acctbal"],
        org_renames=[("s_suppkey", "org_id"), ("s_name", "org_name")],
        person_key="p_partkey",
        membership_person_key="l_partkey",
        org_key="org_id",
        membership_org_key="l_suppkey",
    )


_BRIDGE_OUT = (
    "org_name STRING, s_nationkey INT, p_partkey BIGINT, p_name STRING, p_brand STRING, "
    "p_type STRING, p_size INT, p_retailprice DOUBLE, l_orderkey BIGINT, l_suppkey BIGINT, "
    "l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
)


#: Rows of a compressed JSON file: about 100 MB of text.
JSON_ROWS = 400_000


@register("bridge_join_json", ORACLE_BRIDGE := """
    SELECT s.s_name AS org_name, s.s_nationkey, p.*, l.* EXCLUDE (l_partkey)
    FROM part p
    JOIN lineitem l ON p.p_partkey = l.l_partkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    """)
def q_bridge_join_json(spark, d):
    """The documented join job end to end: the three inputs as JSON files,
    scanned recursively with inferred schemas, joined, then typed."""
    base = scratch_path(spark, "bridge_json")
    for name in ("supplier", "part", "lineitem"):
        write_json(table(spark, d, name), f"{base}/{name}", compression="gzip", rows_per_file=JSON_ROWS)
    joined = bridge_job_from_json(
        spark,
        f"{base}/supplier",
        f"{base}/part",
        f"{base}/lineitem",
        org_drop=["s_acctbal"],
        org_renames=[("s_suppkey", "org_id"), ("s_name", "org_name")],
        person_key="p_partkey",
        membership_person_key="l_partkey",
        org_key="org_id",
        membership_org_key="l_suppkey",
    )
    return apply_schema(joined, _BRIDGE_OUT)


@register(
    "equi_join",
    "SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def q_equi_join(spark, d):
    return equi_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")


@register(
    "equi_join_collision",
    """
    SELECT l.* EXCLUDE (l_linestatus), l.l_linestatus AS status,
           o.* EXCLUDE (o_orderstatus), o.o_orderstatus AS right_status
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    """,
)
def q_equi_join_collision(spark, d):
    """Both sides carry a column named ``status``; the right one is
    prefixed."""
    lines = rename_fields(table(spark, d, "lineitem"), [("l_linestatus", "status")])
    orders = rename_fields(table(spark, d, "orders"), [("o_orderstatus", "status")])
    return equi_join(lines, orders, "l_orderkey", "o_orderkey", on_collision="prefix_right")


@register(
    "lookup_report",
    """
    SELECT n.name, c.c_name IS NOT NULL AS found, c.*
    FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) n
    LEFT JOIN customer c ON n.name = c.c_name
    """,
)
def q_lookup_report(spark, d):
    customer = table(spark, d, "customer")
    names = customer.select(F.col("c_name").alias("name")).unionByName(
        table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    )
    return lookup_report(names, "name", customer, "c_name")


@register(
    "cascade_filter",
    """
    SELECT * FROM lineitem
    WHERE l_orderkey IN (
        SELECT o_orderkey FROM orders
        WHERE NOT coalesce(o_orderstatus = 'P', false)
          AND o_custkey IN (
              SELECT c_custkey FROM customer
              WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)))
    """,
)
def q_cascade_filter(spark, d):
    """database -> table -> partition as customer -> orders -> lineitem;
    a skipped parent removes all of its children."""
    customers = keep_unskipped(
        skip_rules(table(spark, d, "customer"), [("building", F.col("c_mktsegment") == "BUILDING")])
    )
    orders = keep_unskipped(
        skip_rules(table(spark, d, "orders"), [("pending", F.col("o_orderstatus") == "P")])
    )
    levels = cascade_chain(
        [customers, orders, table(spark, d, "lineitem")],
        [{"o_custkey": "c_custkey"}, {"l_orderkey": "o_orderkey"}],
    )
    return levels[-1]


# ---------------------------------------------------------------- projections


@register("drop_fields", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def q_drop_fields(spark, d):
    return drop_fields(table(spark, d, "supplier"), ["s_acctbal", "s_comment"])


@register(
    "rename_fields",
    "SELECT s_suppkey AS org_id, s_name AS org_name, s_nationkey, s_acctbal FROM supplier",
)
def q_rename_fields(spark, d):
    return rename_fields(
        table(spark, d, "supplier"), [("s_suppkey", "org_id"), ("s_name", "org_name"), ("id", "x")]
    )


@register(
    "drop_nested_fields",
    """
    SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_name AS rec_name,
           CAST(1 AS INTEGER) AS rec_width
    FROM customer
    """,
)
def q_drop_nested_fields(spark, d):
    nested = table(spark, d, "customer").select(
        "c_custkey",
        F.struct("c_name", "c_nationkey", "c_acctbal", "c_mktsegment").alias("rec"),
        F.array(F.struct("c_name", "c_acctbal")).alias("recs"),
    )
    dropped = drop_nested_fields(nested, "rec", ["c_acctbal", "CreatedOn"])
    dropped = drop_nested_fields(dropped, "recs", ["c_acctbal", "CreatedOn"])
    first = F.element_at("recs", 1)
    return dropped.select(
        "c_custkey",
        "rec.*",
        first["c_name"].alias("rec_name"),
        F.size(F.json_object_keys(F.to_json(first))).alias("rec_width"),
    )


@register(
    "default_map_field",
    """
    SELECT c_custkey, c_name AS name,
           CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END AS n_props,
           CASE WHEN c_acctbal >= 5000 THEN c_mktsegment END AS segment
    FROM customer
    """,
)
def q_default_map_field(spark, d):
    c = table(spark, d, "customer")
    props = F.when(F.col("c_acctbal") >= 5000, F.create_map(F.lit("segment"), F.col("c_mktsegment")))
    conn = c.select(
        "c_custkey", F.struct(F.col("c_name").alias("Name"), props.alias("ConnectionProperties")).alias("conn")
    )
    filled = default_map_field(conn, "ConnectionProperties", struct_column="conn")
    m = F.col("conn.ConnectionProperties")
    return filled.select(
        "c_custkey",
        F.col("conn.Name").alias("name"),
        F.size(m).alias("n_props"),
        F.try_element_at(m, F.lit("segment")).alias("segment"),
    )


@register(
    "lift_nested_field",
    """
    SELECT c_custkey, c_nationkey AS DatabaseName, c_name AS Name, c_mktsegment AS TableType
    FROM customer
    """,
)
def q_lift_nested_field(spark, d):
    nested = table(spark, d, "customer").select(
        "c_custkey",
        F.struct(
            F.col("c_nationkey").alias("DatabaseName"),
            F.col("c_name").alias("Name"),
            F.col("c_mktsegment").alias("TableType"),
        ).alias("TableInput"),
    )
    lifted = lift_nested_field(nested, "TableInput", "DatabaseName")
    return lifted.select("c_custkey", "DatabaseName", "TableInput.*")


# ---------------------------------------------------------------- filters


@register(
    "filter_by_names",
    "SELECT * FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#13', 'Brand#99')",
)
def q_filter_by_names(spark, d):
    return filter_by_names(table(spark, d, "part"), "p_brand", "Brand#1,Brand#7,Brand#13,Brand#99")


@register(
    "composite_key_filter",
    """
    SELECT l.* FROM lineitem l
    WHERE EXISTS (SELECT 1 FROM orders o
                  WHERE o.o_orderpriority = '1-URGENT'
                    AND o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1)
    """,
)
def q_composite_key_filter(spark, d):
    keys = (
        table(spark, d, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    )
    return composite_key_filter(table(spark, d, "lineitem"), keys)


@register(
    "prefix_filter",
    "SELECT * FROM events WHERE starts_with(event_type, 'c') AND event_type <> ''",
)
def q_prefix_filter(spark, d):
    return prefix_filter(table(spark, d, "events"), "event_type", "c")


@register(
    "skip_rules",
    """
    SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'pending'
                   WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS skip_reason
    FROM orders
    """,
)
def q_skip_rules(spark, d):
    return skip_rules(
        table(spark, d, "orders"),
        [("pending", F.col("o_orderstatus") == "P"), ("urgent", F.col("o_orderpriority") == "1-URGENT")],
    )


# ---------------------------------------------------------------- counts and checks


@register("row_count", "SELECT count(*) AS row_count FROM lineitem")
def q_row_count(spark, d):
    return row_count(table(spark, d, "lineitem"))


@register("non_empty", "SELECT count(*) > 0 AS non_empty FROM lineitem")
def q_non_empty(spark, d):
    return non_empty(table(spark, d, "lineitem"))


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, d):
    return preview(table(spark, d, "orders"), 20, order_by="o_orderkey")


@register(
    "keep_last",
    """
    SELECT * FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
    """,
)
def q_keep_last(spark, d):
    return keep_last(table(spark, d, "conversations"), "conv_id", "turn")


@register(
    "expect_row_count",
    """
    SELECT 'row_count' AS check_name, CAST(10000 AS BIGINT) AS expected,
           count(*) AS actual, count(*) = 10000 AS passed
    FROM events
    """,
)
def q_expect_row_count(spark, d):
    return expect_row_count(table(spark, d, "events"), 10000)


@register(
    "expect_predicates",
    """
    SELECT 'state' AS check_name, count(*) AS n_rows,
           count(*) FILTER (WHERE NOT coalesce(event_type = 'error', false)) AS n_failed,
           count(*) FILTER (WHERE NOT coalesce(event_type = 'error', false)) = 0 AS passed
    FROM events WHERE starts_with(event_type, 'e') AND event_type <> ''
    UNION ALL
    SELECT 'duration', count(*),
           count(*) FILTER (WHERE NOT coalesce(value < 600, false)),
           count(*) FILTER (WHERE NOT coalesce(value < 600, false)) = 0
    FROM events WHERE starts_with(event_type, 'e') AND event_type <> ''
    UNION ALL
    SELECT 'fast', count(*),
           count(*) FILTER (WHERE NOT coalesce(value < 100, false)),
           count(*) FILTER (WHERE NOT coalesce(value < 100, false)) = 0
    FROM events WHERE starts_with(event_type, 'e') AND event_type <> ''
    """,
)
def q_expect_predicates(spark, d):
    """The run gate: rows tagged with the prefix must be in the expected
    state and under the duration limits."""
    return run_gate(
        table(spark, d, "events"),
        "event_type",
        "e",
        [
            ("state", F.col("event_type") == "error"),
            ("duration", F.col("value") < 600),
            ("fast", F.col("value") < 100),
        ],
    )


# ---------------------------------------------------------------- reconcile

_SRC_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")
_TGT_SEGMENTS = ("FURNITURE", "HOUSEHOLD", "MACHINERY")
_SRC_SQL = (
    "SELECT c_custkey, c_name, c_nationkey, CAST(0.0 AS DOUBLE) AS c_acctbal, c_mktsegment "
    "FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')"
)
_TGT_SQL = "SELECT * FROM customer WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD', 'MACHINERY')"


def _source_target(spark, d):
    """Two overlapping inventories: the source holds changed balances."""
    c = table(spark, d, "customer")
    src = c.filter(F.col("c_mktsegment").isin(*_SRC_SEGMENTS)).withColumn(
        "c_acctbal", F.lit(0.0).cast("double")
    )
    tgt = c.filter(F.col("c_mktsegment").isin(*_TGT_SEGMENTS))
    return src, tgt


@register(
    "sync_plan",
    f"""
    WITH src AS ({_SRC_SQL}), tgt AS ({_TGT_SQL})
    SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM tgt t WHERE t.c_custkey = s.c_custkey)
                     THEN 'overwrite' ELSE 'create' END AS action
    FROM src s
    """,
)
def q_sync_plan(spark, d):
    src, tgt = _source_target(spark, d)
    return sync_plan(src, tgt, "c_custkey")


@register(
    "sync_plan_no_overwrite",
    f"""
    WITH src AS ({_SRC_SQL}), tgt AS ({_TGT_SQL})
    SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM tgt t WHERE t.c_custkey = s.c_custkey)
                     THEN 'keep' ELSE 'create' END AS action
    FROM src s
    """,
)
def q_sync_plan_no_overwrite(spark, d):
    src, tgt = _source_target(spark, d)
    return sync_plan(src, tgt, "c_custkey", allow_overwrite=False)


@register(
    "upsert",
    f"""
    WITH src AS ({_SRC_SQL}), tgt AS ({_TGT_SQL})
    SELECT * FROM src
    UNION ALL
    SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.c_custkey = t.c_custkey)
    """,
)
def q_upsert(spark, d):
    src, tgt = _source_target(spark, d)
    return upsert(tgt, src, "c_custkey")


@register(
    "insert_missing",
    f"""
    WITH src AS ({_SRC_SQL}), tgt AS ({_TGT_SQL})
    SELECT * FROM tgt
    UNION ALL
    SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.c_custkey = s.c_custkey)
    """,
)
def q_insert_missing(spark, d):
    src, tgt = _source_target(spark, d)
    return insert_missing(tgt, src, "c_custkey")


@register(
    "upsert_dedup",
    """
    WITH src AS (
        SELECT * FROM conversations WHERE role = 'assistant'
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
    tgt AS (SELECT * FROM conversations WHERE role <> 'assistant')
    SELECT * FROM src
    UNION ALL
    SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.conv_id = t.conv_id)
    """,
)
def q_upsert_dedup(spark, d):
    """A source with many rows per key (every answer): the last one (by
    ``turn``) replaces the key's target rows (every question); keys without
    an answer keep them."""
    conv = table(spark, d, "conversations")
    source = conv.filter(F.col("role") == "assistant")
    target = conv.filter(F.col("role") != "assistant")
    return upsert(target, source, "conv_id", order_by="turn")


@register(
    "partition_match",
    """
    SELECT o.*, p.n_orders
    FROM orders o
    JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
          FROM orders GROUP BY o_orderstatus, o_orderpriority) p
      ON o.o_orderstatus = p.o_orderstatus AND o.o_orderpriority = p.o_orderpriority
    """,
)
def q_partition_match(spark, d):
    """Rows matched to partition entries by the full value list
    (status, priority)."""
    orders = table(spark, d, "orders")
    values = F.array("o_orderstatus", "o_orderpriority")
    entries = (
        orders.groupBy(values.alias("part_values"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    rows = orders.withColumn("part_values", values)
    return partition_match(rows, entries, "part_values").drop("part_values")


@register(
    "partition_upsert",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL
    SELECT c_custkey, c_name, c_nationkey, CAST(0.0 AS DOUBLE), c_mktsegment
    FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'FURNITURE_NEW'
    FROM customer WHERE c_mktsegment = 'FURNITURE'
    """,
)
def q_partition_upsert(spark, d):
    """Partitioned table by segment; one existing partition is replaced, one
    new partition is created, all others are left alone."""
    c = table(spark, d, "customer")
    path = scratch_path(spark, "partition_upsert")
    partition_upsert(c, path, ["c_mktsegment"])
    changed = c.filter(F.col("c_mktsegment") == "BUILDING").withColumn("c_acctbal", F.lit(0.0))
    new = c.filter(F.col("c_mktsegment") == "FURNITURE").withColumn(
        "c_mktsegment", F.lit("FURNITURE_NEW")
    )
    partition_upsert(changed.unionByName(new), path, ["c_mktsegment"])
    back = spark.read.schema(CUSTOMER).parquet(path)
    return apply_schema(back, CUSTOMER)


# ---------------------------------------------------------------- text and nested values

_NAME_MAPPING = [("Customer#", "{kind}#"), ("{kind}", "cust"), ("#0000", "-")]


@register(
    "substitute",
    """
    SELECT c_custkey,
           replace(replace(replace(c_name, 'Customer#', '{kind}#'), '{kind}', 'cust'), '#0000', '-')
             AS c_name
    FROM customer
    """,
)
def q_substitute(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", substitute("c_name", _NAME_MAPPING).alias("c_name"))


_PRIORITY_MAPPING = [("1-URGENT", "{urgent}"), ("{urgent}", "P1"), ("-", "_")]


def _prio_sql(col: str) -> str:
    return f"replace(replace(replace({col}, '1-URGENT', '{{urgent}}'), '{{urgent}}', 'P1'), '-', '_')"


@register(
    "substitute_nested",
    f"""
    SELECT o_orderkey,
           {_prio_sql('o_orderpriority')} AS priority,
           {_prio_sql('o_orderstatus')} AS status,
           o_totalprice AS price,
           {_prio_sql('o_orderpriority')} AS tag_value,
           'o-priority' AS tag_key,
           {_prio_sql('o_orderpriority')} AS v0,
           {_prio_sql('o_orderstatus')} AS v1
    FROM orders
    """,
)
def q_substitute_nested(spark, d):
    """Strings inside a struct, a map (values only) and an array."""
    nested = table(spark, d, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"),
        ).alias("info"),
        F.create_map(F.lit("o-priority"), F.col("o_orderpriority")).alias("tags"),
        F.array("o_orderpriority", "o_orderstatus").alias("vals"),
    )
    out = substitute_nested(nested, _PRIORITY_MAPPING)
    return out.select(
        "o_orderkey",
        F.col("info.priority").alias("priority"),
        F.col("info.status").alias("status"),
        F.col("info.price").alias("price"),
        F.try_element_at("tags", F.lit("o-priority")).alias("tag_value"),
        F.element_at(F.map_keys("tags"), 1).alias("tag_key"),
        F.element_at("vals", 1).alias("v0"),
        F.element_at("vals", 2).alias("v1"),
    )


def _config_docs(spark, d) -> DataFrame:
    """One config document per customer (JSON text): strings and numbers at
    the top level, a nested object outside ``jobs``, and two jobs."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    docs = c.join(n, c.c_nationkey == n.n_nationkey)
    text = F.concat(
        F.lit('{"assets_path":"s3://assets-'), F.col("n_name"),
        F.lit('","region_key":'), F.col("n_regionkey").cast("string"),
        F.lit(',"env":"'), F.col("c_mktsegment"),
        F.lit('","github":{"repo":"repo-'), F.col("n_name"),
        F.lit('"},"jobs":{"'), F.col("c_name"),
        F.lit('-job":{"table_name":"'), F.lower(F.col("c_name")),
        F.lit('","retries":3,"input_path":"s3://in/'), F.col("c_custkey").cast("string"),
        F.lit('/"},"'), F.col("n_name"),
        F.lit('-job":{"table_name":"'), F.col("n_name"),
        F.lit('"}}}'),
    )
    return docs.select(F.col("c_custkey").alias("doc_id"), text.alias("doc"))


@register(
    "flatten_placeholders",
    """
    SELECT c_custkey AS doc_id, 0 AS ordinal, '{assets_path}' AS placeholder,
           's3://assets-' || n_name AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_custkey, 1, '{env}', c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_custkey, 2, '{' || c_name || '-job.table_name}', lower(c_name)
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_custkey, 3, '{' || c_name || '-job.input_path}',
           's3://in/' || CAST(c_custkey AS VARCHAR) || '/'
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_custkey, 4, '{' || n_name || '-job.table_name}', n_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def q_flatten_placeholders(spark, d):
    return flatten_placeholders(_config_docs(spark, d), "doc", keep=["doc_id"])


@register(
    "prefix_names",
    "SELECT c_custkey, 'dev-' || c_name AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def q_prefix_names(spark, d):
    return prefix_names(table(spark, d, "customer"), "c_name", "dev-")


@register("infix_path", "SELECT page_id, replace(url, '.com/', '.com/dev-') AS url FROM pages")
def q_infix_path(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", infix_path("url", "dev-", marker=".com/").alias("url"))


@register(
    "split_list",
    """
    SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS name
    FROM (SELECT p_partkey, string_split(concat_ws(',', p_type, p_brand, p_name), ',') AS parts
          FROM part) t,
         LATERAL (SELECT unnest(range(1, len(t.parts) + 1)) AS i) u
    """,
)
def q_split_list(spark, d):
    lists = table(spark, d, "part").select(
        "p_partkey", F.concat_ws(",", "p_type", "p_brand", "p_name").alias("names")
    )
    return split_list(lists, "names", alias="name", position="pos")


_URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


@register(
    "split_object_url",
    f"""
    WITH urls AS (
        SELECT 'page' AS src, page_id AS id, url FROM pages
        UNION ALL
        SELECT 'customer', c_custkey,
               's3://bucket-' || CAST(c_nationkey AS VARCHAR) || '/scripts/'
               || replace(c_name, '#', '%23') || '%20v1+final.py'
        FROM customer
    ), parts AS (
        SELECT *, lower(regexp_extract(url, '{_URL_RE}', 1)) AS scheme,
               regexp_extract(url, '{_URL_RE}', 2) AS bucket,
               substr(url_decode(regexp_extract(url, '{_URL_RE}', 3)), 2) AS key
        FROM urls
    )
    SELECT src, id, url, scheme, bucket, key, regexp_extract(key, '([^/]*)$', 1) AS base_name
    FROM parts
    """,
)
def q_split_object_url(spark, d):
    pages = table(spark, d, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), "url"
    )
    c = table(spark, d, "customer")
    built = c.select(
        F.lit("customer").alias("src"),
        F.col("c_custkey").alias("id"),
        F.concat(
            F.lit("s3://bucket-"), F.col("c_nationkey").cast("string"), F.lit("/scripts/"),
            F.replace(F.col("c_name"), F.lit("#"), F.lit("%23")), F.lit("%20v1+final.py"),
        ).alias("url"),
    )
    return split_object_url(pages.unionByName(built), "url")


# ---------------------------------------------------------------- sources and sinks


@register("json_scan", "SELECT * FROM customer")
def q_json_scan(spark, d):
    """The table as JSON at two folder depths, read back recursively with an
    inferred schema, then typed by the declared schema."""
    c = table(spark, d, "customer")
    base = scratch_path(spark, "json_scan")
    positive = F.coalesce(F.col("c_acctbal") >= 0, F.lit(False))
    write_json(c.filter(positive), f"{base}/a")
    write_json(c.filter(~positive), f"{base}/b/c")
    return apply_schema(read_json(spark, base), CUSTOMER)


@register(
    "apply_schema",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate,
           o_totalprice, o_orderpriority
    FROM orders
    """,
)
def q_apply_schema(spark, d):
    return apply_schema(table(spark, d, "orders"), ORDER_EXPORT)


@register("json_sink", "SELECT * FROM events")
def q_json_sink(spark, d):
    """Timestamps written as text (microseconds kept), read back with a
    declared schema and cast back."""
    path = write_json(table(spark, d, "events"), scratch_path(spark, "json_sink"))
    raw_schema = EVENTS.replace("ts TIMESTAMP_NTZ", "ts STRING")
    return apply_schema(read_json(spark, path, schema=raw_schema), EVENTS)


@register(
    "json_document_explode",
    """
    SELECT c_name AS Name, 'role-' || n_name AS Role, c_nationkey AS MaxRetries
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_name || '-copy', 'role-' || n_name, c_nationkey + 1
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def q_json_document_explode(spark, d):
    """Resource documents (one per line): customer documents with a two-job
    array, nation documents without one (they give no job rows)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    role = F.concat(F.lit("role-"), F.col("n_name"))
    job_docs = cn.select(
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.col("c_name").alias("Name"), role.alias("Role"),
                             F.col("c_nationkey").alias("MaxRetries")),
                    F.struct(F.concat("c_name", F.lit("-copy")).alias("Name"), role.alias("Role"),
                             (F.col("c_nationkey") + 1).alias("MaxRetries")),
                ).alias("jobs")
            )
        ).alias("value")
    )
    db_docs = n.select(
        F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("Name"))).alias("databases"))).alias(
            "value"
        )
    )
    path = scratch_path(spark, "json_documents")
    job_docs.unionByName(db_docs).write.text(path)
    return read_json_documents(
        spark, path, "jobs", "Name STRING, Role STRING, MaxRetries INT", multi_line=False
    )


@register(
    "resource_documents",
    """
    SELECT 'jobs' AS kind, c_name AS Name, 'role-' || c_mktsegment AS Role, c_nationkey AS MaxRetries FROM customer
    UNION ALL SELECT 'databases', n_name, NULL, NULL FROM nation
    """,
)
def q_resource_documents(spark, d):
    """Serialise two resource kinds as per-row documents, read both back."""
    jobs = table(spark, d, "customer").select(
        F.col("c_name").alias("Name"),
        F.concat(F.lit("role-"), F.col("c_mktsegment")).alias("Role"),
        F.col("c_nationkey").alias("MaxRetries"),
    )
    databases = table(spark, d, "nation").select(F.col("n_name").alias("Name"))
    path = write_resource_documents(
        {"jobs": jobs, "databases": databases}, scratch_path(spark, "resource_documents")
    )
    jobs_back = read_json_documents(
        spark, path, "jobs", "Name STRING, Role STRING, MaxRetries INT", multi_line=False
    )
    databases_back = read_json_documents(spark, path, "databases", "Name STRING", multi_line=False)
    return jobs_back.select(F.lit("jobs").alias("kind"), "*").unionByName(
        databases_back.select(F.lit("databases").alias("kind"), "*"), allowMissingColumns=True
    )


@register("csv_sink", "SELECT * FROM orders")
def q_csv_sink(spark, d):
    path = write_csv(table(spark, d, "orders"), scratch_path(spark, "csv_sink"))
    return read_csv(spark, path, ORDERS)


@register("csv_sink_partitioned", "SELECT * FROM customer")
def q_csv_sink_partitioned(spark, d):
    path = write_csv(
        table(spark, d, "customer"), scratch_path(spark, "csv_sink_part"), partition_by=["c_mktsegment"]
    )
    return apply_schema(read_csv(spark, path, CUSTOMER), CUSTOMER)


@register(
    "single_file_output",
    "SELECT CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows FROM orders",
)
def q_single_file_output(spark, d):
    path = single_file_csv(table(spark, d, "orders"), scratch_path(spark, "single_file"))
    return output_file_stats(spark, path, ORDERS)


@register("guarded_csv_export", "SELECT * FROM orders")
def q_guarded_csv_export(spark, d):
    path = scratch_path(spark, "guarded")
    guarded_csv_export(table(spark, d, "orders"), path)
    return read_csv(spark, path, ORDERS)


@register("guarded_csv_export_empty", "SELECT * FROM orders")
def q_guarded_csv_export_empty(spark, d):
    """An earlier export exists; an empty frame must leave it in place."""
    orders = table(spark, d, "orders")
    path = write_csv(orders, scratch_path(spark, "guarded_empty"))
    _, wrote = guarded_csv_export(orders.filter(F.col("o_orderkey").isNull()), path)
    assert not wrote
    return read_csv(spark, path, ORDERS)


_TWO_BRANCHES = """
    SELECT '{a}' AS branch, {cols} FROM orders
    UNION ALL
    SELECT '{b}' AS branch, {cols} FROM orders
"""


@register("fan_out", _TWO_BRANCHES.format(a="target", b="step", cols="*"))
def q_fan_out(spark, d):
    """One persisted source, two consumers (a CSV target and the export
    step), each read back and labelled."""
    target_path = scratch_path(spark, "fan_out_target")
    step_path = scratch_path(spark, "fan_out_step")
    fan_out(
        table(spark, d, "orders"),
        {
            "target": lambda df: write_csv(df, target_path),
            "step": lambda df: guarded_csv_export(df, step_path),
        },
    )
    return read_csv(spark, target_path, ORDERS).select(F.lit("target").alias("branch"), "*").unionByName(
        read_csv(spark, step_path, ORDERS).select(F.lit("step").alias("branch"), "*")
    )


@register("custom_transform", "SELECT * FROM orders")
def q_custom_transform(spark, d):
    """The export step as a custom transform: named frames in and out; the
    rows come from the file that the step wrote."""
    path = scratch_path(spark, "custom_step")
    out = custom_transform(
        spark, guarded_export_step("orders_node", path), {"orders_node": table(spark, d, "orders")}
    )
    return read_csv(spark, path, ORDERS).select(*out["out"].columns)


_EXPORT_COLS = (
    "o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, "
    "o_totalprice, o_orderpriority"
)


@register("export_job", _TWO_BRANCHES.format(a="target", b="step", cols=_EXPORT_COLS))
def q_export_job(spark, d):
    """Source -> declared schema -> {CSV target, export step}; both outputs
    read back and labelled."""
    job = ExportJob(
        schema=ORDER_EXPORT,
        target_path=scratch_path(spark, "export_target"),
        step_path=scratch_path(spark, "export_step"),
    )
    job.run(spark, table(spark, d, "orders"))
    target = read_csv(spark, job.target_path, ORDER_EXPORT)
    step = read_csv(spark, job.step_path, ORDER_EXPORT)
    return target.select(F.lit("target").alias("branch"), "*").unionByName(
        step.select(F.lit("step").alias("branch"), "*")
    )


# ---------------------------------------------------------------- definition sync

_SYNC_MAPPING = [("{assets_path}", "s3://assets-dev"), ("{deploy.job_role}", "arn:role/dev")]


@register(
    "definition_sync",
    """
    WITH defs AS (
        SELECT c_name, c_mktsegment,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'arn:role/dev-v2' ELSE 'arn:role/dev' END AS Role
        FROM customer),
    req AS (SELECT c_name AS requested_name FROM customer UNION ALL SELECT s_name FROM supplier),
    tgt AS (SELECT 'dev-' || c_name AS n FROM customer WHERE c_acctbal > 5000)
    SELECT r.requested_name,
           d.c_name IS NOT NULL AS found,
           CASE WHEN d.c_name IS NOT NULL AND d.c_mktsegment = 'HOUSEHOLD' THEN 'no_dag' END
             AS skip_reason,
           CASE WHEN d.c_name IS NULL OR d.c_mktsegment = 'HOUSEHOLD' THEN NULL
                WHEN EXISTS (SELECT 1 FROM tgt WHERE tgt.n = 'dev-' || d.c_name) THEN 'overwrite'
                ELSE 'create' END AS action,
           'dev-' || d.c_name AS Name,
           d.Role,
           CASE WHEN d.c_name IS NOT NULL THEN 'etl' END AS command_name,
           's3://assets-dev/scripts/dev-' || d.c_name || '.py' AS script_location,
           CASE WHEN d.c_name IS NOT NULL THEN 's3://assets-dev/temporary/' END AS temp_dir,
           CASE WHEN d.c_name IS NOT NULL THEN d.c_mktsegment <> 'HOUSEHOLD' END AS has_dag
    FROM req r LEFT JOIN defs d ON r.requested_name = d.c_name
    """,
)
def q_definition_sync(spark, d):
    """Job definitions built from ``customer`` (one redefined later for one
    segment), requested names from ``customer`` and ``supplier`` (the
    latter unknown), target jobs = prefixed names of high-balance
    customers; jobs without a graph are skipped."""
    c = table(spark, d, "customer")

    def jobs(role: str, seq: int, rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("c_name").alias("Name"),
            F.lit(role).alias("Role"),
            F.struct(
                F.lit("etl").alias("Name"),
                F.concat(F.lit("{assets_path}/scripts/"), F.col("c_name"), F.lit(".py")).alias(
                    "ScriptLocation"
                ),
            ).alias("Command"),
            F.create_map(F.lit("--TempDir"), F.lit("{assets_path}/temporary/")).alias("DefaultArguments"),
            F.col("c_nationkey").alias("AllocatedCapacity"),
            F.col("c_nationkey").alias("MaxCapacity"),
            F.when(
                F.col("c_mktsegment") != "HOUSEHOLD",
                F.create_map(F.lit("node-1"), F.col("c_mktsegment")),
            ).alias("CodeGenConfigurationNodes"),
            F.lit(seq).alias("seq"),
        )

    definitions = jobs("{deploy.job_role}", 0, c).unionByName(
        jobs("{deploy.job_role}-v2", 1, c.filter(F.col("c_mktsegment") == "BUILDING"))
    )
    requested = c.select(F.col("c_name").alias("n")).unionByName(
        table(spark, d, "supplier").select(F.col("s_name").alias("n"))
    )
    target = c.filter(F.col("c_acctbal") > 5000).select(F.concat(F.lit("dev-"), F.col("c_name")))
    sync = DefinitionSync(
        mapping=_SYNC_MAPPING,
        name_prefix="dev-",
        skip_rules=[("no_dag", F.col("CodeGenConfigurationNodes").isNull())],
        order_by=("seq",),
    )
    plan = sync.plan(definitions, target, requested)
    return plan.select(
        "requested_name",
        "found",
        "skip_reason",
        "action",
        "Name",
        "Role",
        F.col("Command.Name").alias("command_name"),
        F.col("Command.ScriptLocation").alias("script_location"),
        F.try_element_at("DefaultArguments", F.lit("--TempDir")).alias("temp_dir"),
        F.when(F.col("found"), F.col("CodeGenConfigurationNodes").isNotNull()).alias("has_dag"),
    )


_CONN_MAPPING = [("{jdbc_host}", "jdbc:postgresql://db.dev:5432"), ("{user}", "etl")]


@register(
    "connection_sync",
    """
    SELECT 'conn_' || c_name AS requested_name, true AS found,
           CAST(NULL AS VARCHAR) AS skip_reason,
           CASE WHEN c_acctbal < 0 THEN 'overwrite' ELSE 'create' END AS action,
           'conn_' || c_name AS Name,
           CASE WHEN c_mktsegment <> 'MACHINERY'
                THEN 'jdbc:postgresql://db.dev:5432/db' || CAST(c_nationkey AS VARCHAR) END AS url,
           CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'etl' END AS user_name,
           CASE WHEN c_mktsegment <> 'MACHINERY' THEN 2 ELSE 0 END AS n_props
    FROM customer
    """,
)
def q_connection_sync(spark, d):
    """Connection definitions: system fields dropped, a missing property
    map becomes empty, placeholders substituted in map values."""
    c = table(spark, d, "customer")
    props = F.when(
        F.col("c_mktsegment") != "MACHINERY",
        F.create_map(
            F.lit("JDBC_CONNECTION_URL"), F.concat(F.lit("{jdbc_host}/db"), F.col("c_nationkey").cast("string")),
            F.lit("USERNAME"), F.lit("{user}"),
        ),
    )
    connections = c.select(
        F.concat(F.lit("conn_"), F.col("c_name")).alias("Name"),
        props.alias("ConnectionProperties"),
        F.lit("READY").alias("Status"),
        F.lit("2024-01-01T00:00:00").alias("CreationTime"),
    )
    target = c.filter(F.col("c_acctbal") < 0).select(F.concat(F.lit("conn_"), F.col("c_name")))
    sync = DefinitionSync(
        mapping=_CONN_MAPPING, script_field=None,
        system_fields=CONNECTION_SYSTEM_FIELDS, default_maps=("ConnectionProperties",),
    )
    m = F.col("ConnectionProperties")
    return sync.plan(connections, target).select(
        "requested_name", "found", "skip_reason", "action", "Name",
        F.try_element_at(m, F.lit("JDBC_CONNECTION_URL")).alias("url"),
        F.try_element_at(m, F.lit("USERNAME")).alias("user_name"),
        F.size(m).alias("n_props"),
    )


# ---------------------------------------------------------------- catalog sync

_CATALOG_MAPPING = [("{env}", "dev"), ("{bucket}", "s3://data-dev")]


def _catalog_inputs(spark, d):
    """database -> table -> partition built from customer -> orders ->
    lineitem, with system fields, placeholders, resource links and governed
    tables; targets: high-balance customers, urgent orders, shipped lines."""
    c, o, li = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    db_name = lambda k: F.concat(F.lit("db_"), F.col(k).cast("string"))
    t_name = lambda k: F.concat(F.lit("t_"), F.col(k).cast("string"))
    databases = c.select(
        db_name("c_custkey").alias("Name"),
        F.concat(F.lit("{env} database of "), F.col("c_name")).alias("Description"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", db_name("c_custkey")).alias("TargetDatabase"),
        F.lit("123456789012").alias("CatalogId"),
        F.lit("2024-01-01T00:00:00").alias("CreateTime"),
    )
    tables = o.select(
        db_name("o_custkey").alias("DatabaseName"),
        t_name("o_orderkey").alias("Name"),
        F.when(F.col("o_orderstatus") == "P", F.lit("GOVERNED")).otherwise(F.lit("EXTERNAL_TABLE")).alias("TableType"),
        F.concat(F.lit("{bucket}/orders/"), F.col("o_orderkey").cast("string")).alias("Location"),
        F.lit("123456789012").alias("CatalogId"),
        F.lit("1").alias("VersionId"),
    )
    lines = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    values = F.array(F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    partitions = lines.select(
        db_name("o_custkey").alias("DatabaseName"),
        t_name("l_orderkey").alias("TableName"),
        values.alias("Values"),
        F.concat(
            F.lit("{bucket}/orders/"), F.col("l_orderkey").cast("string"), F.lit("/"),
            F.col("l_linenumber").cast("string"),
        ).alias("Location"),
        F.lit("123456789012").alias("CatalogId"),
        F.lit("2024-01-01T00:00:00").alias("CreationTime"),
    )
    target_dbs = c.filter(F.col("c_acctbal") > 5000).select(db_name("c_custkey"))
    target_tables = o.filter(F.col("o_orderpriority") == "1-URGENT").select(
        db_name("o_custkey"), t_name("o_orderkey")
    )
    target_parts = lines.filter(F.col("l_linestatus") == "F").select(
        db_name("o_custkey"), t_name("l_orderkey"), values
    )
    return databases, tables, partitions, target_dbs, target_tables, target_parts


@register(
    "catalog_sync",
    """
    WITH dbs AS (
        SELECT 'db_' || CAST(c_custkey AS VARCHAR) AS name, c_name, c_mktsegment FROM customer),
    live_db AS (SELECT name FROM dbs WHERE c_mktsegment <> 'AUTOMOBILE'),
    tabs AS (
        SELECT 'db_' || CAST(o_custkey AS VARCHAR) AS db, 't_' || CAST(o_orderkey AS VARCHAR) AS name,
               o_orderkey, o_orderstatus
        FROM orders WHERE 'db_' || CAST(o_custkey AS VARCHAR) IN (SELECT name FROM live_db)),
    live_tab AS (SELECT o_orderkey FROM tabs WHERE o_orderstatus <> 'P'),
    tgt_db AS (SELECT 'db_' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_acctbal > 5000),
    tgt_tab AS (
        SELECT 'db_' || CAST(o_custkey AS VARCHAR) AS db, 't_' || CAST(o_orderkey AS VARCHAR) AS name
        FROM orders WHERE o_orderpriority = '1-URGENT'),
    lines AS (
        SELECT 'db_' || CAST(o_custkey AS VARCHAR) AS db, 't_' || CAST(l_orderkey AS VARCHAR) AS tab,
               l_returnflag || '/' || CAST(l_linenumber AS VARCHAR) AS vals,
               l_orderkey, l_linenumber, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    parts AS (SELECT * FROM lines WHERE l_orderkey IN (SELECT o_orderkey FROM live_tab)),
    tgt_part AS (SELECT db, tab, vals FROM lines WHERE l_linestatus = 'F')
    SELECT 'database' AS level, name AS database_name, CAST(NULL AS VARCHAR) AS table_name,
           CAST(NULL AS VARCHAR) AS part_values,
           CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'resource_link' END AS skip_reason,
           CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL
                WHEN name IN (SELECT name FROM tgt_db) THEN 'overwrite' ELSE 'create' END AS action,
           'dev database of ' || c_name AS detail
    FROM dbs
    UNION ALL
    SELECT 'table', db, name, NULL,
           CASE WHEN o_orderstatus = 'P' THEN 'governed' END,
           CASE WHEN o_orderstatus = 'P' THEN NULL
                WHEN EXISTS (SELECT 1 FROM tgt_tab t WHERE t.db = tabs.db AND t.name = tabs.name)
                THEN 'overwrite' ELSE 'create' END,
           's3://data-dev/orders/' || CAST(o_orderkey AS VARCHAR)
    FROM tabs
    UNION ALL
    SELECT 'partition', db, tab, vals, NULL,
           CASE WHEN EXISTS (SELECT 1 FROM tgt_part t
                             WHERE t.db = parts.db AND t.tab = parts.tab AND t.vals = parts.vals)
                THEN 'overwrite' ELSE 'create' END,
           's3://data-dev/orders/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)
    FROM parts
    """,
)
def q_catalog_sync(spark, d):
    plans = CatalogSync(mapping=_CATALOG_MAPPING).plan(*_catalog_inputs(spark, d))
    none = F.lit(None).cast("string")
    dbs = plans["databases"].select(
        F.lit("database").alias("level"), F.col("Name").alias("database_name"), none.alias("table_name"),
        none.alias("part_values"), "skip_reason", "action", F.col("Description").alias("detail"),
    )
    tabs = plans["tables"].select(
        F.lit("table").alias("level"), F.col("DatabaseName").alias("database_name"),
        F.col("Name").alias("table_name"), none.alias("part_values"), "skip_reason", "action",
        F.col("Location").alias("detail"),
    )
    parts = plans["partitions"].select(
        F.lit("partition").alias("level"), F.col("DatabaseName").alias("database_name"),
        F.col("TableName").alias("table_name"), F.array_join("Values", "/").alias("part_values"),
        "skip_reason", "action", F.col("Location").alias("detail"),
    )
    return dbs.unionByName(tabs).unionByName(parts)


@register(
    "config_to_substitution",
    """
    SELECT p_partkey, 'part ' || p_name || ' of ' || p_brand || ' by job ' || p_type AS label FROM part
    """,
)
def q_config_to_substitution(spark, d):
    """Config documents become placeholder rows, the rows a mapping per
    document, and the mapping is applied to that document's text."""
    part = table(spark, d, "part")
    docs = part.select(
        "p_partkey",
        F.to_json(
            F.struct(
                F.col("p_name").alias("name"),
                F.struct(F.struct(F.col("p_type").alias("type")).alias("load")).alias("jobs"),
                F.col("p_brand").alias("brand"),
            )
        ).alias("doc"),
    )
    mapping = collect_mapping(flatten_placeholders(docs, "doc", keep=["p_partkey"]), ["p_partkey"])
    text = part.select("p_partkey", F.lit("part {name} of {brand} by job {load.type}").alias("label"))
    return text.join(mapping, "p_partkey").select("p_partkey", substitute("label", F.col("mapping")).alias("label"))


@register(
    "catalog_sync_names",
    """
    SELECT 'database' AS level, 'db_' || CAST(s_suppkey AS VARCHAR) AS name, TRUE AS found FROM supplier
    WHERE s_suppkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'database', 'db_' || CAST(s_suppkey AS VARCHAR), FALSE FROM supplier
    WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'database', 'db_nation_' || CAST(n_nationkey AS VARCHAR), FALSE FROM nation
    """,
)
def q_catalog_sync_names(spark, d):
    """The catalog sync for requested databases: which of them are planned
    and which are unknown."""
    requested = table(spark, d, "supplier").select(F.concat(F.lit("db_"), F.col("s_suppkey").cast("string")).alias("name")).union(
        table(spark, d, "nation").select(F.concat(F.lit("db_nation_"), F.col("n_nationkey").cast("string")))
    )
    plans = CatalogSync(mapping=_CATALOG_MAPPING).plan(*_catalog_inputs(spark, d), database_names=requested)
    planned = plans["databases"].select(F.lit("database").alias("level"), F.col("Name").alias("name"), F.lit(True).alias("found"))
    return planned.union(plans["not_found"].withColumn("found", F.lit(False)))


from tableflow import scale_queries  # noqa: E402,F401  (registers its own)
