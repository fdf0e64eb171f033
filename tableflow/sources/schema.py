"""Declared schemas: a list of (name, type) applied to a frame or a reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.names import quote

SchemaLike = str | T.StructType | Sequence[tuple[str, str]]


def to_struct(schema: SchemaLike) -> T.StructType:
    """DDL string, ``StructType`` or ``[(name, type), ...]`` as a StructType."""
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        return T._parse_datatype_string(schema)
    ddl = ", ".join(f"`{name}` {dtype}" for name, dtype in schema)
    return T._parse_datatype_string(ddl)


def apply_schema(df: DataFrame, schema: SchemaLike, missing: str = "error") -> DataFrame:
    """Project ``df`` onto a declared column list: that order, those names,
    those types (casts follow the session's ANSI setting, so a bad value
    fails the job rather than turning into null).  Columns the frame lacks
    raise, or become typed nulls with ``missing="null"``.  Undeclared columns
    are dropped.  One projection; Catalyst prunes the scan to the declared
    columns."""
    struct = to_struct(schema)
    present = set(df.columns)
    if any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in struct.fields):
        return _apply_with_columns(df, struct, present, missing)
    exprs = []
    for field in struct.fields:
        name, dtype = quote(field.name), field.dataType.simpleString()
        if field.name in present:
            exprs.append(f"CAST({name} AS {dtype}) AS {name}")
        elif missing == "null":
            exprs.append(f"CAST(NULL AS {dtype}) AS {name}")
        else:
            raise ValueError(f"declared column {field.name!r} not in frame: {df.columns}")
    return df.selectExpr(*exprs)


def _apply_with_columns(df: DataFrame, struct: T.StructType, present: set, missing: str) -> DataFrame:
    """The same through Column objects (nested types keep any field name)."""
    cols = []
    for field in struct.fields:
        if field.name in present:
            cols.append(F.col(quote(field.name)).cast(field.dataType).alias(field.name))
        elif missing == "null":
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"declared column {field.name!r} not in frame: {df.columns}")
    return df.select(cols)
