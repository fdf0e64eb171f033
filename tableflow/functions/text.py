"""String expressions: ordered placeholder substitution, prefixes, path
infixes and comma lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.operators.names import column as column_of
from tableflow.operators.names import quote

Mapping_ = Mapping[str, str] | Sequence[tuple[str, str]] | Column

#: Longer mappings are folded over an array.
NESTED_PAIRS = 32


def mapping_pairs(mapping: Mapping_) -> list[tuple[str, str]]:
    """The mapping as an ordered list of (placeholder, value) pairs; an
    empty placeholder is refused (it has no meaningful literal match)."""
    pairs = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    for key, value in pairs:
        if not isinstance(key, str) or key == "":
            raise ValueError(f"placeholder must be a non-empty string, got {key!r}")
        if not isinstance(value, str):
            raise ValueError(f"value of {key!r} must be a string, got {value!r}")
    return pairs


def substitute(column: str | Column, mapping: Mapping_) -> Column:
    """Replace every occurrence of each placeholder, pair by pair in mapping
    order, so a later pair sees the result of the earlier ones.  Literal
    matching (not regex); null stays null.

    ``mapping`` is a mapping, a list of pairs, or a column: an ordered
    ``array<struct<placeholder, value>>`` as ``collect_mapping`` makes it.
    Short lists become nested ``replace`` calls, which compile to code; long
    ones and columns are folded over an array, so depth does not grow."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(mapping, Column):
        return F.when(mapping.isNull(), c).otherwise(_fold(c, mapping))
    pairs = mapping_pairs(mapping)
    if len(pairs) > NESTED_PAIRS:
        return _fold(c, F.array(*[F.struct(F.lit(k).alias("placeholder"), F.lit(v).alias("value")) for k, v in pairs]))
    for key, value in pairs:
        c = F.replace(c, F.lit(key), F.lit(value))
    return c


def _fold(c: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, c, lambda text, p: F.replace(text, p["placeholder"], p["value"]))


def collect_mapping(
    rows: DataFrame, by: Sequence[str], ordinal: str = "ordinal", alias: str = "mapping"
) -> DataFrame:
    """Placeholder rows (as ``config.flatten_placeholders`` gives them) as
    one ordered array per ``by`` key, for ``substitute`` and
    ``substitute_nested``.  A mapping is one document's, so it is small."""
    entry = F.struct(F.col(ordinal).alias("ordinal"), "placeholder", "value")
    ordered = F.array_sort(F.collect_list(entry))
    pairs = F.transform(ordered, lambda e: F.struct(e["placeholder"].alias("placeholder"), e["value"].alias("value")))
    return rows.groupBy(*by).agg(pairs.alias(alias))


def prefix_names(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """``prefix + name``; an empty prefix leaves the column unchanged."""
    if not prefix:
        return df
    return df.withColumn(column, F.concat(F.lit(prefix), column_of(df, column)))


def infix_path(column: str | Column, prefix: str, marker: str = "/scripts/") -> Column:
    """Insert ``prefix`` right behind every occurrence of ``marker``."""
    c = F.col(column) if isinstance(column, str) else column
    if not prefix:
        return c
    return F.replace(c, F.lit(marker), F.lit(marker + prefix))


def split_list(
    df: DataFrame,
    column: str,
    alias: str = "name",
    separator: str = ",",
    position: str | None = "pos",
) -> DataFrame:
    """One row per element of a separated list (no trimming, empty parts
    kept, a null list gives no rows).  With ``position`` the 0-based element
    index is kept too.  The other columns come first,
    in order, then position and element."""
    parts = F.split(column_of(df, column), F.lit("\\Q" + separator + "\\E"), -1)
    others = [c for c in df.columns if c != column]
    if position:
        gen = F.posexplode(parts).alias(position, alias)
    else:
        gen = F.explode(parts).alias(alias)
    return df.select(*[F.col(quote(c)) for c in others], gen)
