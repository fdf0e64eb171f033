"""Row filters: name lists, ordered skip rules, composite keys, prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.operators.names import column as column_of
from tableflow.operators.names import quote


def parse_name_list(spec: str | Sequence[str] | None) -> list[str] | None:
    """A comma-separated name list; ``None`` or ``""`` means "no list".
    Parts are not trimmed, so ``"a, b"`` names ``"a"`` and ``" b"``."""
    if spec is None:
        return None
    if isinstance(spec, str):
        return spec.split(",") if spec else None
    return list(spec) or None


def filter_by_names(
    df: DataFrame, column: str, names: str | Sequence[str] | DataFrame | None
) -> DataFrame:
    """Keep rows whose ``column`` is in ``names``; no list keeps every row.

    A literal list (a command-line value, so small) becomes an ``IN`` set
    pushed to the scan; a DataFrame of names becomes a left-semi join, which
    Catalyst broadcasts or shuffles from its measured size.
    """
    if isinstance(names, DataFrame):
        (name_col,) = names.columns
        wanted = names.select(F.col(quote(name_col)).alias("__tableflow_name"))
        return df.join(wanted, F.col(quote(column)) == F.col("__tableflow_name"), "left_semi")
    parsed = parse_name_list(names)
    if parsed is None:
        return df
    return df.filter(column_of(df, column).isin(parsed))


def skip_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """First rule whose predicate is true gives the reason; a null predicate
    counts as false; no rule true gives null."""
    if not rules:
        return F.lit(None).cast("string")
    (reason, pred), *rest = rules
    expr = F.when(pred, F.lit(reason))
    for reason, pred in rest:
        expr = expr.when(pred, F.lit(reason))
    return expr


def skip_rules(
    df: DataFrame, rules: Sequence[tuple[str, Column]], column: str = "skip_reason"
) -> DataFrame:
    """Tag each row with the reason of the first matching skip rule."""
    return df.withColumn(column, skip_reason(rules))


def keep_unskipped(df: DataFrame, column: str = "skip_reason") -> DataFrame:
    """Rows no skip rule matched, without the reason column."""
    return df.filter(column_of(df, column).isNull()).drop(column)


def composite_key_filter(
    df: DataFrame, keys: Mapping[str, object] | DataFrame
) -> DataFrame:
    """Keep rows equal to one composite key (a mapping column -> value), or
    to any key of a DataFrame whose columns name the key columns (semi join,
    null keys never match)."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(*[F.col(quote(c)).alias(f"__tableflow_key_{i}") for i, c in enumerate(keys.columns)])
        same = [F.col(quote(c)) == F.col(f"__tableflow_key_{i}") for i, c in enumerate(keys.columns)]
        return df.join(wanted, same, "left_semi")
    cond = F.lit(True)
    for name, value in keys.items():
        cond = cond & (column_of(df, name) == F.lit(value))
    return df.filter(cond)


def starts_with(column: str | Column, prefix: str) -> Column:
    """Null-safe prefix test: null or empty values never match."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.startswith(prefix) & (c != F.lit("")), F.lit(False))


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Keep rows whose ``column`` starts with ``prefix``; null or empty never
    match.  Written without ``coalesce`` (a filter already drops null) so the
    predicate reaches the Parquet scan as ``StringStartsWith``."""
    c = column_of(df, column)
    return df.filter(c.startswith(prefix) & (c != F.lit("")))
