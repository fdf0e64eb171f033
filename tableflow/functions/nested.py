"""Placeholder substitution through nested values (structs, arrays, maps).

The expression is built once on the driver from the column's schema:
strings get the ordered ``replace`` fold, structs are rebuilt field by
field, arrays use ``transform`` and maps ``transform_values``.  Map keys and
field names are never touched, and non-string leaves pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.text import Mapping_, mapping_pairs, substitute


def _has_string(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_string(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_string(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_string(dtype.valueType)
    return False


def _has_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.VariantType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_variant(dtype.valueType)
    return False


def substitute_value(c: Column, dtype: T.DataType, pairs: Mapping_) -> Column:
    """``c`` (of type ``dtype``) with every string value inside substituted."""
    if not _has_string(dtype):
        return c
    if isinstance(dtype, T.StringType):
        return substitute(c, pairs)
    if isinstance(dtype, T.StructType):
        fields = [
            substitute_value(c.getField(f.name), f.dataType, pairs).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        return F.transform(c, lambda x: substitute_value(x, element, pairs))
    if isinstance(dtype, T.MapType):
        value = dtype.valueType
        return F.transform_values(c, lambda _k, v: substitute_value(v, value, pairs))
    return c


def substitute_nested(
    df: DataFrame, mapping: Mapping_, columns: Sequence[str] | None = None
) -> DataFrame:
    """Substitute placeholders in the string values of ``columns`` (default:
    all) at any depth; one projection.  ``mapping`` as for ``substitute``.

    A VARIANT has no declared shape to rebuild, so a chosen column that holds
    one is refused: cast it to a declared type first, or leave it out."""
    pairs = mapping if isinstance(mapping, Column) else mapping_pairs(mapping)
    chosen = set(df.columns if columns is None else columns)
    if shapeless := [f.name for f in df.schema.fields if f.name in chosen and _has_variant(f.dataType)]:
        raise TypeError(f"cannot substitute inside VARIANT columns {shapeless}")
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in chosen:
            c = substitute_value(c, field.dataType, pairs).alias(field.name)
        out.append(c)
    return df.select(out)
