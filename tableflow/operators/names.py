"""Column-name quoting for SQL expression strings.

Wide projections are sent to the JVM as one ``selectExpr`` call (the JVM
parses all expressions at once) instead of several Python -> JVM calls per
column; names are back-quoted so any character is safe.
"""


from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, whatever characters it has; a path into a
    struct where there is none."""
    return F.col(quote(name) if name in df.columns else name)


def qualified(alias: str, name: str) -> str:
    return f"{quote(alias)}.{quote(name)}"


def split_guard(side: str, keys: list[str]) -> str:
    """A constant of the key that joins may add to their condition.

    AQE splits a hot key only where both join inputs come straight from the
    join's own shuffles.  An input that is already partitioned by the key (a
    deduplicating aggregate, a window) gets no such shuffle; with one more
    column in the condition it does, and the other side can be split."""
    return f"pmod(xxhash64({', '.join(qualified(side, k) for k in keys)}), 1)"
