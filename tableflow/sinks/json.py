"""JSON sink: values JSON cannot hold are written as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.sinks.formats import TEXT_TIME_OPTIONS


def time_as_text(c, dtype: T.DataType):
    """Date / timestamp as text the way Python's ``str`` prints it:
    ``YYYY-MM-DD`` and ``YYYY-MM-DD HH:MM:SS[.ffffff]`` (the fraction only
    when it is not zero); a zoned timestamp also gets its offset in the
    session time zone (``+00:00``), as an aware ``datetime`` does."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    offset = "xxx" if isinstance(dtype, T.TimestampType) else ""
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss" + offset)
    frac = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS" + offset)
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(frac)


_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _has_time(dtype: T.DataType) -> bool:
    if isinstance(dtype, _TIME_TYPES):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_time(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_time(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_time(dtype.valueType)
    return False


def _as_text(c, dtype: T.DataType):
    """``c`` with every date / timestamp inside (at any depth) as text."""
    if not _has_time(dtype):
        return c
    if isinstance(dtype, _TIME_TYPES):
        return time_as_text(c, dtype)
    if isinstance(dtype, T.StructType):
        fields = [_as_text(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        return F.transform(c, lambda x: _as_text(x, element))
    value = dtype.valueType
    return F.transform_values(c, lambda _k, v: _as_text(v, value))


def jsonable(df: DataFrame) -> DataFrame:
    """Dates and timestamps, top-level or nested, as strings; everything
    else as is (one projection; columns without times are untouched)."""
    if not any(_has_time(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        [_as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def write_json(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    num_files: int | None = None,
    compression: str = "none",
    rows_per_file: int = 0,
) -> str:
    """Write JSON Lines (splittable) after ``jsonable``; null fields are
    written as ``null``, so every column survives.  Compressed files are read
    by one task each: ``rows_per_file`` bounds them without a shuffle."""
    out = jsonable(df)
    if num_files is not None:
        out = out.repartition(num_files)
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", compression).option("ignoreNullFields", False).options(**TEXT_TIME_OPTIONS).json(path)
    return path


def write_resource_documents(frames: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> str:
    """Serialise resource frames (``{"jobs": df, "tables": df, ...}``) as
    resource documents: one document per row, ``{"<kind>": [row]}``, JSON
    Lines under ``path/<kind>/``.

    A single document holding every row would have to be assembled by one
    task; per-row documents are written in parallel and read back, kind by
    kind, with ``sources.json.read_json_documents(..., multi_line=False)``
    (documents of other kinds give no rows).  Dates and timestamps are
    written as text (``jsonable``).
    """
    for kind, df in frames.items():
        row = F.struct(*[F.col(f"`{c}`") for c in jsonable(df).columns])
        docs = jsonable(df).select(F.to_json(F.struct(F.array(row).alias(kind)), {"ignoreNullFields": "false"}).alias("value"))
        docs.write.mode(mode).text(f"{path.rstrip('/')}/{kind}")
    return path
