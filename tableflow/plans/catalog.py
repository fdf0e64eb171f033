"""Catalog sync as one Spark job: databases -> tables -> partitions.

Per level the rules are the same as for definitions (last definition per
key wins, skip rules, system fields dropped, placeholders substituted,
create / overwrite / keep against the target), and the levels cascade: a
table is planned only if its database was planned (not skipped), a
partition only if its table was.  Partitions are keyed by their full value
list (same values, same order) and an existing partition is always
overwritten, as a create that hits "already exists" is turned into an
update.

Placeholders in keys: a database keeps its name as it stands; a table is
looked up by its raw key and planned under the substituted one; a partition
is looked up and planned under substituted database, table and values.

Inputs are flat definition frames (one row per resource):

* databases: ``Name``, optional ``TargetDatabase`` (a resource link), ...
* tables: ``DatabaseName``, ``Name``, ``TableType``, optional
  ``TargetTable``, ...
* partitions: ``DatabaseName``, ``TableName``, ``Values`` (array), ...

Targets hold the keys that already exist (first columns named as above).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions.nested import substitute_nested
from tableflow.operators.filters import filter_by_names, parse_name_list, skip_reason
from tableflow.operators.joins import cascade_filter
from tableflow.operators.project import drop_fields
from tableflow.operators.quality import keep_last
from tableflow.operators.reconcile import sync_plan

# System fields the target catalog assigns itself, per level.
# (``DatabaseName`` / ``TableName`` are keys of the flat rows here, so they
# are kept as key columns rather than dropped from a nested input.)
DATABASE_SYSTEM_FIELDS = ("CatalogId", "CatalogIdentifier", "DatabaseId", "CreateTime")
TABLE_SYSTEM_FIELDS = (
    "CatalogId", "CatalogIdentifier", "DatabaseId", "CreateTime", "UpdateTime", "CreatedBy",
    "IsRegisteredWithLakeFormation", "IsMultiDialectView", "VersionId",
)
PARTITION_SYSTEM_FIELDS = ("CatalogId", "CreationTime")

DB_KEY = ["Name"]
TABLE_KEY = ["DatabaseName", "Name"]
PARTITION_KEY = ["DatabaseName", "TableName", "Values"]

Names = str | Sequence[str] | DataFrame | None


def _present(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def _unknown(level: str, names: Names, defs: DataFrame) -> DataFrame:
    """(level, name) of requested names without a definition."""
    if not isinstance(names, DataFrame):
        names = defs.sparkSession.createDataFrame([(n,) for n in parse_name_list(names) or []], "name string")
    wanted = names.select(F.lit(level).alias("level"), F.col(names.columns[0]).alias("name"))
    return wanted.join(defs.select(F.col("Name").alias("name")), "name", "left_anti").select("level", "name")


@dataclass(frozen=True)
class CatalogSync:
    mapping: Sequence[tuple[str, str]] = ()
    overwrite_databases: bool = True
    overwrite_tables: bool = True
    order_by: str | None = None

    def _level(
        self,
        defs: DataFrame,
        target: DataFrame,
        keys: list[str],
        rules: list[tuple[str, Column]],
        system_fields: Sequence[str],
        allow_overwrite: bool,
        lookup: str = "raw",
        payload: str = "raw",
    ) -> DataFrame:
        """The plan of one level.  ``lookup`` and ``payload`` say whether the
        keys that the target is asked for, and those of the planned row, are
        taken as they stand or with placeholders substituted.  ``__raw_<key>``
        columns keep the keys of the definition for the next level."""
        if self.order_by:
            defs = keep_last(defs, keys, self.order_by).drop(self.order_by)
        tagged = defs.withColumn("skip_reason", skip_reason(rules))
        cleaned = drop_fields(tagged, list(system_fields))
        raw = {k: f"__raw_{k}" for k in keys}
        cleaned = cleaned.withColumns({r: F.col(k) for k, r in raw.items()})
        values = [c for c in cleaned.columns if c not in {*keys, *raw.values(), "skip_reason"}]
        looked_up = keys if lookup == "substituted" else []
        cleaned = substitute_nested(cleaned, list(self.mapping), columns=[*values, *looked_up])
        existing = target.select(*[F.col(target.columns[i]).alias(k) for i, k in enumerate(keys)])
        planned = sync_plan(cleaned, existing, keys, allow_overwrite=allow_overwrite)
        if payload != lookup:
            planned = substitute_nested(planned, list(self.mapping), columns=keys)
        return planned.withColumn(
            "action", F.when(F.col("skip_reason").isNull(), F.col("action"))
        )

    def plan(
        self,
        databases: DataFrame,
        tables: DataFrame,
        partitions: DataFrame,
        target_databases: DataFrame,
        target_tables: DataFrame,
        target_partitions: DataFrame,
        database_names: Names = None,
        table_names: Names = None,
    ) -> dict[str, DataFrame]:
        """Plans per level: ``{"databases", "tables", "partitions"}``, each
        the cleaned definitions with ``skip_reason`` and ``action``.

        With names (a comma list, a list, or a one-column frame) only those
        databases or tables are planned, and ``"not_found"`` has a row
        (level, name) for each requested name that no definition has."""
        missing = [
            _unknown(level, names, defs)
            for level, names, defs in (("database", database_names, databases), ("table", table_names, tables))
            if names is not None
        ]
        databases = filter_by_names(databases, "Name", database_names)
        tables = filter_by_names(tables, "Name", table_names)
        dbs = self._level(
            databases, target_databases, DB_KEY,
            [("resource_link", _present(databases, "TargetDatabase"))],
            DATABASE_SYSTEM_FIELDS, self.overwrite_databases,
        )
        live_dbs = dbs.filter(F.col("skip_reason").isNull())
        tabs = self._level(
            cascade_filter(live_dbs, tables, {"DatabaseName": "__raw_Name"}),
            target_tables, TABLE_KEY,
            [
                ("governed", F.col("TableType") == "GOVERNED"),
                ("resource_link", _present(tables, "TargetTable")),
            ],
            TABLE_SYSTEM_FIELDS, self.overwrite_tables, payload="substituted",
        )
        live_tabs = tabs.filter(F.col("skip_reason").isNull())
        parts = self._level(
            cascade_filter(live_tabs, partitions, {"DatabaseName": "__raw_DatabaseName", "TableName": "__raw_Name"}),
            target_partitions, PARTITION_KEY, [], PARTITION_SYSTEM_FIELDS, True,
            lookup="substituted", payload="substituted",
        )
        plans = {"databases": dbs, "tables": tabs, "partitions": parts}
        plans = {k: p.select(*[c for c in p.columns if not c.startswith("__raw_")]) for k, p in plans.items()}
        if missing:
            plans["not_found"] = missing[0] if len(missing) == 1 else missing[0].unionByName(missing[1])
        return plans
