"""Equal ranges of a column as SQL predicates, for split reads.

``jdbc(column, lowerBound, upperBound)`` cuts a range of numbers into equal
lengths, so a skewed key puts most rows into a few partitions, and it knows no
strings.  Here the cut points are quantiles of the column, and the ranges are
predicates for ``read_jdbc(predicates=...)`` or any filter: each row meets
exactly one of them.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.names import quote

#: Values of a string column that are sorted on the driver, and their length.
SAMPLE, PREFIX = 20_000, 64


def sql_literal(value: object) -> str:
    """A value as standard SQL text."""
    if isinstance(value, bool) or value is None:
        raise TypeError(f"no bound: {value!r}")
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(value) if isinstance(value, float) else str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def range_predicates(name: str, points: Sequence[object]) -> list[str]:
    """Predicates of the ranges that ascending cut points part, each point the
    end of its range, and of the nulls (which go with the first range).
    ``name`` is the column as SQL text."""
    bounds = [sql_literal(p) for p in points]
    if not bounds:
        return [f"{name} IS NULL OR {name} IS NOT NULL"]
    out = [f"{name} IS NULL OR {name} <= {bounds[0]}"]
    out += [f"{name} > {a} AND {name} <= {b}" for a, b in zip(bounds, bounds[1:])]
    return [*out, f"{name} > {bounds[-1]}"]


def cut_points(df: DataFrame, column: str, ranges: int) -> list[object]:
    """Ascending cut points of ``column`` for about ``ranges`` ranges of equal
    row counts.  Numbers, dates and timestamps come from one mergeable quantile
    sketch over all rows; strings (compared bytewise, as databases do in their
    C collation) from a random sample of ``SAMPLE`` values, cut to ``PREFIX``
    characters.  A value with more rows than a range should have is a range's
    end, so no range holds it and many others."""
    if ranges < 1:
        raise ValueError("ranges must be at least 1")
    kind = df.select(quote(column)).schema.fields[0].dataType
    value = F.col(quote(column))
    shares = [k / ranges for k in range(1, ranges)]
    if not shares:
        return []
    if isinstance(kind, T.StringType):
        some = df.where(value.isNotNull()).select(F.substring(value, 1, PREFIX).alias("v")).orderBy(F.rand(17)).limit(SAMPLE)
        found = sorted((r.v for r in some.collect()), key=lambda s: s.encode())
        points = [found[min(len(found) - 1, int(s * len(found)))] for s in shares] if found else []
        return sorted(set(points), key=lambda s: s.encode())
    accuracy = max(10_000, 100 * ranges)
    found = df.select(F.percentile_approx(value, shares, accuracy).alias("q")).first()["q"] or []
    points = sorted(set(found))
    return points


def split_predicates(df: DataFrame, column: str, ranges: int, sql_name: str | None = None) -> list[str]:
    """Disjoint predicates that together hold of every row of ``df``."""
    return range_predicates(sql_name or quote(column), cut_points(df, column, ranges))


def split_report(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """One row per predicate ``(part, predicate, n_rows)`` and how often rows
    meet none or several: ``(n_none, n_several)``, in one pass."""
    met = [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates]
    times = met[0]
    for m in met[1:]:
        times = times + m
    counts = df.select(*[m.alias(f"m{i}") for i, m in enumerate(met)], times.alias("times")).agg(
        *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).cast("bigint").alias(f"n{i}") for i in range(len(met))],
        F.count_if(F.col("times") == 0).alias("n_none"),
        F.count_if(F.col("times") > 1).alias("n_several"),
    )
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(p).alias("predicate"), F.col(f"n{i}").alias("n_rows")) for i, p in enumerate(predicates)])
    return counts.select(F.inline(parts), "n_none", "n_several")
