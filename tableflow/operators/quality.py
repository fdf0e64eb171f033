"""Counts, previews, last-definition-wins dedupe and expectation reports.

Reports are one-row or one-row-per-check DataFrames computed in a single
aggregation pass, so checking a large table costs one scan and no shuffle of
the data itself (only per-partition partial counts move).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.operators.filters import prefix_filter
from tableflow.operators.names import column, quote


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def row_count(df: DataFrame, alias: str = "row_count") -> DataFrame:
    """One row, one column: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def non_empty(df: DataFrame, alias: str = "non_empty") -> DataFrame:
    """One row: whether ``df`` has a row.  The answer comes from ``isEmpty``,
    which tries one partition, then a few more, and stops at the first row;
    it runs when this function is called."""
    return df.sparkSession.range(1).select(F.lit(not df.isEmpty()).alias(alias))


def is_empty(df: DataFrame) -> bool:
    """Driver-side guard; runs a job that stops at the first row."""
    return df.isEmpty()


def keep_last(
    df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str]
) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` value(s).

    Spark rows have no order, so "the later definition wins" needs an order
    column, unique within a key (ties pick any of the tied rows).  Written
    as ``row_number() = 1`` over the key: Spark plans it with a partial
    ``WindowGroupLimit`` before the shuffle, so each map task sends at most
    one row per key and a key holding a third of all rows never lands whole
    on one reducer (checked by a plan test).
    """
    key_cols = _as_list(keys)
    order_cols = _as_list(order_by)
    rank = "__tableflow_rank"
    w = Window.partitionBy(*[F.col(quote(c)) for c in key_cols]).orderBy(
        *[F.col(quote(c)).desc() for c in order_cols]
    )
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def preview(df: DataFrame, n: int = 20, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` the result is stable
    (a per-partition top-n merged on one task: only ``n`` rows per task move)."""
    if order_by is None:
        return df.limit(n)
    return df.orderBy(*[column(df, c) for c in _as_list(order_by)]).limit(n)


def expect_row_count(df: DataFrame, expected: int, check: str = "row_count") -> DataFrame:
    """One report row ``(check_name, expected, actual, passed)``."""
    actual = F.count(F.lit(1))
    return df.agg(
        F.lit(check).alias("check_name"),
        F.lit(int(expected)).cast("bigint").alias("expected"),
        actual.alias("actual"),
        (actual == F.lit(int(expected))).alias("passed"),
    )


def expect_predicates(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """One report row per check ``(check_name, n_rows, n_failed, passed)``.

    A row fails a check when the predicate is false *or null*.  All checks
    are counted in one aggregation pass, then unpivoted.
    """
    if not checks:
        raise ValueError("no checks given")
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[
            F.count_if(~F.coalesce(pred, F.lit(False))).alias(f"__f{i}")
            for i, (_, pred) in enumerate(checks)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                F.col("__n").alias("n_rows"),
                F.col(f"__f{i}").alias("n_failed"),
            )
            for i, (name, _) in enumerate(checks)
        ]
    )
    return (
        counts.select(F.inline(rows))
        .withColumn("passed", F.col("n_failed") == 0)
    )


def run_gate(
    df: DataFrame, tag_column: str, prefix: str, checks: Sequence[tuple[str, Column]]
) -> DataFrame:
    """Checks over the rows whose tag starts with ``prefix`` (null or empty
    tags are not selected): the gate of an integration run."""
    return expect_predicates(prefix_filter(df, tag_column, prefix), checks)
