"""Projections: drop, rename, and reshape (nested) fields.

All of these are single ``select``/``withColumn`` projections; Catalyst folds
them into the neighbouring operators, so they cost nothing at run time and
never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.names import column as column_of
from tableflow.operators.names import quote


def drop_fields(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop fields; names that are not present are ignored.

    A name is a top-level column, or a dotted path into a struct column
    (``"info.created"``) when no top-level column has that exact name.
    """
    wanted = list(names)
    top = [n for n in wanted if n in df.columns]
    out = df.drop(*top)
    types = {f.name: f.dataType for f in out.schema.fields}
    for path in wanted:
        if path in top or "." not in path:
            continue
        head, rest = path.split(".", 1)
        if isinstance(types.get(head), T.StructType) and _has_path(types[head], rest):
            out = out.withColumn(head, F.col(quote(head)).dropFields(rest))
            types = {f.name: f.dataType for f in out.schema.fields}
    return out


def _has_path(struct: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    for field in struct.fields:
        if field.name == head:
            return not rest or (isinstance(field.dataType, T.StructType) and _has_path(field.dataType, rest))
    return False


def _pairs(mapping: Mapping[str, str] | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)


def rename_fields(
    df: DataFrame, mapping: Mapping[str, str] | Sequence[tuple[str, str]]
) -> DataFrame:
    """Rename columns as a chain of single renames, applied in order.

    ``[("a", "b"), ("b", "c")]`` ends with ``a`` named ``c``, exactly as two
    chained rename calls would.  A missing source name is a no-op; renaming
    onto a name that already exists is refused.  Top-level renames are
    resolved on the schema and emitted as one projection.  A dotted path
    (``"info.first" -> "info.given"``, same parent) renames a field inside a
    struct, keeping field order; exact top-level names take precedence.
    """
    names = list(df.columns)
    nested: list[tuple[str, str]] = []
    for old, new in _pairs(mapping):
        if old in names:
            if old == new:
                continue
            if new in names:
                raise ValueError(f"rename {old!r} -> {new!r}: column {new!r} already exists")
            names = [new if n == old else n for n in names]
        elif "." in old:
            nested.append((old, new))
    out = df.selectExpr(*[f"{quote(o)} AS {quote(n)}" for o, n in zip(df.columns, names)])
    for old, new in nested:
        out = _rename_nested(out, old, new)
    return out


def _renamed_struct(c: Column, dtype: T.StructType, path: list[str], new_leaf: str) -> Column:
    head, rest = path[0], path[1:]
    fields = []
    for f in dtype.fields:
        value = c.getField(f.name)
        name = f.name
        if f.name == head:
            if rest:
                value = _renamed_struct(value, f.dataType, rest, new_leaf)
            else:
                name = new_leaf
        fields.append(value.alias(name))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields))


def _rename_nested(df: DataFrame, old: str, new: str) -> DataFrame:
    old_parts, new_parts = old.split("."), new.split(".")
    if old_parts[:-1] != new_parts[:-1]:
        raise ValueError(f"rename {old!r} -> {new!r}: a nested rename keeps the parent path")
    top = old_parts[0]
    types = {f.name: f.dataType for f in df.schema.fields}
    dtype: T.DataType | None = types.get(top)
    for part in old_parts[1:]:  # missing path: no-op
        if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
            return df
        parent, dtype = dtype, dtype[part].dataType
    if new_parts[-1] in parent.fieldNames() and new_parts[-1] != old_parts[-1]:
        raise ValueError(f"rename {old!r} -> {new!r}: field already exists")
    expr = _renamed_struct(F.col(quote(top)), types[top], old_parts[1:], new_parts[-1])
    return df.withColumn(top, expr)


def _field_type(df: DataFrame, column: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == column:
            return field.dataType
    raise ValueError(f"column {column!r} not found")


def drop_nested_fields(df: DataFrame, column: str, fields: Iterable[str]) -> DataFrame:
    """Drop fields inside a struct column, or inside every element of an
    array (or value of a map) of structs.  Absent fields are ignored; a null
    struct stays null."""
    dtype = _field_type(df, column)

    def drop_in(struct_type: T.StructType, c: Column) -> Column:
        present = [f for f in fields if f in struct_type.fieldNames()]
        return c.dropFields(*map(quote, present)) if present else c

    if isinstance(dtype, T.StructType):
        expr = drop_in(dtype, column_of(df, column))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        element = dtype.elementType
        expr = F.transform(column_of(df, column), lambda x: drop_in(element, x))
    elif isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StructType):
        value = dtype.valueType
        expr = F.transform_values(column_of(df, column), lambda _k, v: drop_in(value, v))
    else:
        raise ValueError(f"column {column!r} holds no struct: {dtype.simpleString()}")
    return df.withColumn(column, expr)


def default_map_field(
    df: DataFrame,
    field: str,
    struct_column: str | None = None,
    map_type: str = "map<string,string>",
) -> DataFrame:
    """Give an absent map field an empty map.

    The field is "absent" when the schema lacks it or the value is null; a
    present value is kept as is.  With ``struct_column`` the field lives
    inside that struct (the struct itself is left null when null).
    """
    empty = F.create_map().cast(map_type)
    if struct_column is None:
        if field in df.columns:
            return df.withColumn(field, F.coalesce(column_of(df, field), empty))
        return df.withColumn(field, empty)
    stype = _field_type(df, struct_column)
    if not isinstance(stype, T.StructType):
        raise ValueError(f"column {struct_column!r} is not a struct")
    target = column_of(df, struct_column)
    if field in stype.fieldNames():
        value = F.coalesce(target.getField(field), empty)
    else:
        value = empty
    return df.withColumn(struct_column, target.withField(quote(field), value))


def lift_nested_field(
    df: DataFrame, struct_column: str, field: str, new_name: str | None = None
) -> DataFrame:
    """Copy ``struct_column.field`` to a top-level column, then drop it from
    the struct.  An existing top-level column with that name is replaced."""
    target = new_name or field
    box = column_of(df, struct_column)
    return df.withColumn(target, box.getField(field)).withColumn(struct_column, box.dropFields(quote(field)))
