"""JDBC table source.

A whole-table read through one connection is one task; for a large table
give a numeric/date split column and bounds so ``num_partitions`` tasks read
disjoint ranges in parallel (rows outside the bounds still land in the first
and last ranges, none are lost).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    custom_schema: str | None = None,
) -> dict[str, str]:
    """Reader options for a JDBC table; validates the split settings."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    opts.update({k: str(v) for k, v in (properties or {}).items()})
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError(
                "partition_column, lower_bound, upper_bound and num_partitions go together"
            )
        if int(num_partitions) < 1:
            raise ValueError("num_partitions must be >= 1")
        opts.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    if custom_schema:
        opts["customSchema"] = custom_schema
    return opts


def bounds_query(table: str, column: str) -> str:
    """A one-row subquery with the split column's range, run by the
    database."""
    return f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) tableflow_bounds"


def jdbc_bounds(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    properties: Mapping[str, str] | None = None,
) -> tuple[object, object]:
    """``(min, max)`` of the split column, computed by the database (one
    row comes back, whatever the table size)."""
    row = (
        spark.read.format("jdbc")
        .options(**jdbc_options(url, bounds_query(table, column), properties))
        .load()
        .first()
    )
    return row["lo"], row["hi"]


def _whole(bound: object, rounded: Callable[[object], int]) -> object:
    """Numeric bounds must be whole numbers; dates and times stay."""
    return rounded(bound) if isinstance(bound, (Decimal, float)) else bound


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """Read a JDBC table (see ``jdbc_options`` for the keyword arguments).
    Filters and projections on the result are pushed into the SQL sent to
    the database.  Given ``partition_column`` and ``num_partitions`` but no
    bounds, the bounds are fetched first (``jdbc_bounds``)."""
    column = kwargs.get("partition_column")
    if column is not None and kwargs.get("num_partitions") is None:
        raise ValueError("partition_column needs num_partitions")
    if column is not None and kwargs.get("lower_bound") is None and kwargs.get("upper_bound") is None:
        lo, hi = jdbc_bounds(spark, url, table, column, kwargs.get("properties"))
        if lo is None:  # empty table: one plain read
            kwargs = {k: v for k, v in kwargs.items() if k not in ("partition_column", "num_partitions")}
        else:
            kwargs.update(lower_bound=_whole(lo, math.floor), upper_bound=_whole(hi, math.ceil))
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
