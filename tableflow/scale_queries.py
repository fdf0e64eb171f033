"""Registered queries of the operators made for tables that one pass, one
driver or one rewrite cannot take: merge by touched files, JSON through
VARIANT, substitution from a mapping table, staged and checked export, split
predicates.  ``queries.py`` loads this module."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tableflow.operators.hierarchy import cascade_tree
from tableflow.operators.substitute import substitute_from_table
from tableflow.queries import ORDERS, register, table
from tableflow.session import scratch_path
from tableflow.sinks.balanced import write_balanced_csv
from tableflow.sinks.csv import read_csv, write_csv
from tableflow.sinks.json import write_json
from tableflow.sinks.merge import FileTable
from tableflow.sinks.partitioned import partition_upsert
from tableflow.sinks.staged import CsvBranch, publish_branches, publish_csv
from tableflow.sources.partitions import partition_plan
from tableflow.sources.splits import split_predicates, split_report
from tableflow.sources.variant import read_json_fitted

# ---------------------------------------------------------------- merge

#: Changed and new orders: of the lower half of the keys every third, repriced,
#: and every tenth under a new key.
_CHANGES = """
    SELECT {key} AS o_orderkey, o_custkey, o_orderstatus, {price} AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders) / 2 AND o_orderkey % {step} = 0
"""
_SOURCE = _CHANGES.format(key="o_orderkey", price="o_totalprice + 1", step=3) + "UNION ALL" + _CHANGES.format(key="o_orderkey + 1000000000", price="o_totalprice", step=10)


def _merge_inputs(spark, d):
    orders = table(spark, d, "orders")
    half = F.lit((orders.agg(F.max("o_orderkey")).first()[0] or 0) / 2)
    lower = orders.where(F.col("o_orderkey") <= half)
    changed = lower.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    new = lower.where("o_orderkey % 10 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    target = FileTable(spark, scratch_path(spark, "merge"))
    target.replace(orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey"))
    return target, changed.unionByName(new)


@register(
    "merge_touched_files",
    f"""
    WITH source AS ({_SOURCE})
    SELECT * FROM source
    UNION ALL
    SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.o_orderkey = o.o_orderkey)
    """,
)
def q_merge_touched_files(spark, d):
    """Upsert in place: files of the upper half of the keys stay as they are."""
    target, source = _merge_inputs(spark, d)
    target.merge(source, "o_orderkey")
    return target.read()


@register(
    "merge_insert_only",
    f"""
    WITH source AS ({_SOURCE})
    SELECT * FROM orders
    UNION ALL
    SELECT * FROM source s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE s.o_orderkey = o.o_orderkey)
    """,
)
def q_merge_insert_only(spark, d):
    """The same source where existing rows win: every old file stays."""
    target, source = _merge_inputs(spark, d)
    target.merge(source, "o_orderkey", overwrite=False)
    return target.read()


# ---------------------------------------------------------------- JSON

LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING"
)
_LINE_COLUMNS = [c.split()[0] for c in LINEITEM.split(", ")]


def _drifting_lines(spark, d) -> str:
    """``lineitem`` as JSON Lines whose types drift: some quantities are text
    that reads as a number, some line numbers text that does not, some records
    have a field that no schema names."""
    lines = table(spark, d, "lineitem").select(*_LINE_COLUMNS)
    plain = "l_orderkey % 4 > 1"
    path = scratch_path(spark, "drifting")
    write_json(lines.where(plain), f"{path}/plain")
    write_json(lines.where("l_orderkey % 4 = 1").withColumn("l_quantity", F.col("l_quantity").cast("string")), f"{path}/text")
    odd = lines.where("l_orderkey % 4 = 0").withColumn("l_linenumber", F.concat(F.lit("no "), "l_linenumber"))
    write_json(odd.withColumn("note", F.struct(F.col("l_suppkey").alias("by"))), f"{path}/odd")
    return path


@register(
    "json_variant_declared",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_orderkey % 4 <> 0 THEN l_linenumber END AS l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
           CASE WHEN l_orderkey % 4 = 0 THEN '"no ' || l_linenumber || '"' END AS rest_line,
           CASE WHEN l_orderkey % 4 = 0 THEN '{"by":' || l_suppkey || '}' END AS rest_note
    FROM lineitem
    """,
)
def q_json_variant_declared(spark, d):
    """One parse into a declared schema; what does not fit stays beside."""
    rows = read_json_fitted(spark, _drifting_lines(spark, d), LINEITEM)
    return rows.select(*_LINE_COLUMNS, F.col("rest")["l_linenumber"].alias("rest_line"), F.col("rest")["note"].alias("rest_note"))


@register(
    "json_variant_inferred",
    """
    SELECT l_discount, l_extendedprice,
           CASE WHEN l_orderkey % 4 = 0 THEN 'no ' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) END AS l_linenumber,
           l_linestatus, l_orderkey, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag, l_suppkey, l_tax,
           CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey END AS by
    FROM lineitem
    """,
)
def q_json_variant_inferred(spark, d):
    """The schema of all records by one aggregation: columns whose values
    disagree widen to strings."""
    rows = read_json_fitted(spark, _drifting_lines(spark, d), rest=None)
    return rows.select("*", F.col("note.by").alias("by")).drop("note").withColumn("l_quantity", F.col("l_quantity").cast("double"))


# ---------------------------------------------------------------- substitution


@register(
    "substitute_mapping_table",
    """
    WITH filled AS (
        SELECT l_orderkey, l_linenumber, l_suppkey,
               CASE WHEN o_orderkey IS NULL THEN '{o' || l_orderkey || '}'
                    WHEN o_orderkey % 5 = 0 THEN coalesce('via ' || c.c_name, 'via {c' || o_custkey || '}')
                    ELSE o_orderpriority END AS o,
               coalesce(s.c_name, '{c' || l_suppkey || '}') AS c
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
        LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer s ON s.c_custkey = l_suppkey)
    SELECT l_orderkey, l_linenumber, l_suppkey, 'line ' || l_linenumber || ' of ' || o || ' by ' || c || ' and {none}' AS text FROM filled
    """,
)
def q_substitute_mapping_table(spark, d):
    """Every order and customer is a pair; the values of some orders name a
    customer, which a later pair fills in."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    text = F.format_string("line %d of {o%d} by {c%d} and {none}", "l_linenumber", "l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(
        F.format_string("{o%d}", "o_orderkey").alias("placeholder"),
        F.when(F.col("o_orderkey") % 5 == 0, F.format_string("via {c%d}", "o_custkey")).otherwise(F.col("o_orderpriority")).alias("value"),
        F.col("o_orderkey").alias("ordinal"),
    )
    customers = table(spark, d, "customer").select(F.format_string("{c%d}", "c_custkey").alias("placeholder"), F.col("c_name").alias("value"), (F.col("c_custkey") + 10**12).alias("ordinal"))
    return substitute_from_table(lines.withColumn("text", text), "text", orders.union(customers))


# ---------------------------------------------------------------- staged export


@register("staged_csv_export", "SELECT * FROM orders")
def q_staged_csv_export(spark, d):
    """Counted while it is written, published afterwards."""
    path = scratch_path(spark, "staged")
    write_csv(table(spark, d, "orders").limit(5), path)
    done = publish_csv(table(spark, d, "orders"), path)
    assert done.written
    return read_csv(spark, path, ORDERS)


@register("staged_csv_export_empty", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_staged_csv_export_empty(spark, d):
    """No row: the earlier output stays."""
    path = scratch_path(spark, "staged")
    orders = table(spark, d, "orders")
    write_csv(orders.where("o_orderstatus = 'F'"), path)
    done = publish_csv(orders.where("o_orderkey < 0"), path)
    assert not done.written
    return read_csv(spark, path, ORDERS)


@register(
    "checked_export",
    """
    SELECT check_name, n_rows, n_failed, n_failed = 0 AS passed, n_rows AS n_exported
    FROM (SELECT 'priced' AS check_name, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS n_failed FROM orders
          UNION ALL
          SELECT 'open or filled', count(*), count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)) FROM orders)
    """,
)
def q_checked_export(spark, d):
    """All checks along the write that happens anyway; no pass of their own."""
    path = scratch_path(spark, "checked")
    checks = [("priced", F.col("o_totalprice") > 0), ("open or filled", F.col("o_orderstatus").isin("O", "F"))]
    done = publish_csv(table(spark, d, "orders"), path, checks)
    return done.report(spark).withColumn("n_exported", F.lit(read_csv(spark, path, ORDERS).count()).cast("bigint"))


@register(
    "fan_out_one_pass",
    """
    SELECT 'all' AS branch, o_orderkey, o_orderstatus, o_orderdate, n AS n_counted FROM orders, (SELECT count(*) AS n FROM orders)
    UNION ALL
    SELECT 'open', o_orderkey, o_orderstatus, o_orderdate, n FROM orders, (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O') WHERE o_orderstatus = 'O'
    """,
)
def q_fan_out_one_pass(spark, d):
    """Two outputs of different rows and columns from one pass over orders."""
    path = scratch_path(spark, "branches")
    key, status, date = "o_orderkey BIGINT", "o_orderstatus STRING", "o_orderdate TIMESTAMP_NTZ"
    branches = {
        "all": CsvBranch(f"{path}/all", ("o_orderkey", "o_orderstatus", "o_orderdate")),
        "open": CsvBranch(f"{path}/open", ("o_orderdate", "o_orderkey", F.lower("o_orderstatus").alias("status")), F.col("o_orderstatus") == "O", guarded=True),
    }
    done = publish_branches(table(spark, d, "orders"), branches)
    every = read_csv(spark, f"{path}/all", f"{key}, {status}, {date}").select(F.lit("all").alias("branch"), "*", F.lit(done["all"].n_rows).cast("bigint").alias("n_counted"))
    some = read_csv(spark, f"{path}/open", f"{date}, {key}, {status}").withColumn("o_orderstatus", F.upper("o_orderstatus"))
    return every.union(some.select(F.lit("open"), "o_orderkey", "o_orderstatus", "o_orderdate", F.lit(done["open"].n_rows).cast("bigint")))


# ---------------------------------------------------------------- splits


@register(
    "split_predicates",
    """
    SELECT 'number' AS kind, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_none, CAST(0 AS BIGINT) AS n_several, true AS even FROM lineitem
    UNION ALL SELECT 'string', count(*), 0, 0, true FROM customer
    UNION ALL SELECT 'time', count(*), 0, 0, true FROM orders
    """,
)
def q_split_predicates(spark, d):
    """Ranges of a skewed number (nulls too), a string and a time: every row
    meets one predicate, and no range is far above the mean."""
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, None).otherwise(F.pow("l_orderkey", F.lit(3))).alias("skewed key"))
    out = None
    for kind, df, column, ranges, slack in (
        ("number", lines, "skewed key", 12, 1.2),
        ("string", table(spark, d, "customer"), "c_name", 8, 1.2),
        ("time", table(spark, d, "orders"), "o_orderdate", 12, 1.2),
    ):
        nulls = df.where(F.col(f"`{column}`").isNull()).count()
        parts = split_report(df, split_predicates(df, column, ranges))
        # The nulls are one value, which no range parts.
        size = F.col("n_rows") - F.when(F.col("part") == 0, nulls).otherwise(0)
        even = F.max(size) <= F.lit(slack) * F.sum(size) / F.lit(ranges) + 1
        row = parts.agg(F.lit(kind).alias("kind"), F.sum("n_rows").alias("n_rows"), F.max("n_none").alias("n_none"), F.max("n_several").alias("n_several"), even.alias("even"))
        out = row if out is None else out.union(row)
    return out


# ---------------------------------------------------------------- hierarchy


@register(
    "cascade_tree",
    """
    WITH RECURSIVE nodes AS (
        SELECT 'tree' AS kind, c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN -1 - c_custkey WHEN c_custkey >= 7 THEN c_custkey // 7 END AS p,
               c_mktsegment = 'BUILDING' AND c_custkey % 5 = 0 AS s FROM customer
        UNION ALL
        SELECT 'chain', s_suppkey, CASE WHEN s_suppkey > (SELECT min(s_suppkey) FROM supplier) THEN s_suppkey - 1 END, s_suppkey % 70 = 69 FROM supplier),
    walk AS (
        SELECT kind, k, k AS top, p, s, CAST(0 AS BIGINT) AS depth FROM nodes
        UNION ALL
        SELECT w.kind, w.k, n.k, n.p, w.s OR n.s, w.depth + 1 FROM walk w JOIN nodes n ON n.kind = w.kind AND n.k = w.p),
    ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY kind, k ORDER BY depth DESC) = 1)
    SELECT kind, k AS key, CASE WHEN p IS NULL THEN depth END AS depth, CASE WHEN p IS NULL THEN top END AS root,
           CASE WHEN p IS NOT NULL THEN 'no such parent' WHEN s THEN 'skipped ancestor' END AS reason
    FROM ends
    """,
)
def q_cascade_tree(spark, d):
    """Children of skipped or missing ancestors, at any depth: a tree of
    customers and one chain of all suppliers."""
    key = F.col("c_custkey")
    tree = table(spark, d, "customer").select(
        key.alias("key"),
        F.when(key % 97 == 0, -1 - key).when(key >= 7, F.floor(key / 7)).cast("bigint").alias("parent"),
        ((F.col("c_mktsegment") == "BUILDING") & (key % 5 == 0)).alias("skip"),
    )
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    first = F.lit(suppliers.agg(F.min("key")).first()[0])
    chain = suppliers.select("key", F.when(F.col("key") > first, F.col("key") - 1).alias("parent"), (F.col("key") % 70 == 69).alias("skip"))
    out = None
    for kind, df in (("tree", tree), ("chain", chain)):
        part = cascade_tree(df, "key", "parent", "skip").select(F.lit(kind).alias("kind"), "key", "depth", "root", "reason")
        out = part if out is None else out.union(part)
    return out


# ---------------------------------------------------------------- listings, file sizes


@register(
    "partition_listing",
    """
    SELECT c_mktsegment || '=50%/' || (c_nationkey % 3) AS segment, CAST(c_nationkey AS VARCHAR) AS nation,
           CASE WHEN bool_or(c_custkey % 2 = 0 AND c_nationkey < 12) THEN 'overwrite' ELSE 'create' END AS action
    FROM customer GROUP BY ALL
    """,
)
def q_partition_listing(spark, d):
    """The partitions of a table, decoded from its paths, against a source's."""
    rows = table(spark, d, "customer").withColumn("segment", F.format_string("%s=50%%/%d", "c_mktsegment", F.col("c_nationkey") % 3))
    path = scratch_path(spark, "listed")
    partition_upsert(rows.where("c_custkey % 2 = 0 and c_nationkey < 12"), path, ["segment", "c_nationkey"])
    plan = partition_plan(rows, path, ["segment", "c_nationkey"])
    return plan.select(F.col("values")[0].alias("segment"), F.col("values")[1].alias("nation"), "action")


@register(
    "balanced_csv_files",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, true AS even, true AS in_order FROM lineitem",
)
def q_balanced_csv_files(spark, d):
    """``lineitem`` as eight files of equal bytes, in key order across files."""
    columns = "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, l_extendedprice DOUBLE"
    lines = table(spark, d, "lineitem").select(*[c.split()[0] for c in columns.split(", ")])
    path = write_balanced_csv(lines, scratch_path(spark, "balanced-csv"), ["l_orderkey", "l_linenumber"], 8)
    back = read_csv(spark, path, columns)
    place = F.struct("l_orderkey", "l_linenumber")
    named = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = named.groupBy("file").agg(F.max("bytes").alias("bytes"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    following = F.lead("lo").over(Window.orderBy("file"))  # a row per file
    told = files.withColumn("sorted", F.coalesce(F.col("hi") <= following, F.lit(True))).agg((F.max("bytes") <= F.lit(1.05) * F.avg("bytes")).alias("even"), F.bool_and("sorted").alias("in_order")).first()
    return back.select("*", F.lit(told["even"]).alias("even"), F.lit(told["in_order"]).alias("in_order"))
