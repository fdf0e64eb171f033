"""JSON sources: record files (JSON Lines or one document per file) and
resource documents whose arrays are exploded to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.sources.schema import SchemaLike, to_struct


def _reader(spark: SparkSession, recursive: bool, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("recursiveFileLookup", recursive)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
    )


def read_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: SchemaLike | None = None,
    recursive: bool = True,
    multi_line: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read JSON from files or folders, descending into subfolders.

    Without ``schema`` Spark infers one, which is an extra pass over the
    whole input; at scale pass the schema.  A malformed record raises; with
    ``corrupt_column`` it becomes a row that holds its text in that column
    instead.  Inference turns integers into ``bigint``, timestamps
    into strings and sorts columns by name: follow with ``apply_schema``.
    ``multi_line`` files cannot be split, so keep it off for JSON Lines.
    """
    reader = _reader(spark, recursive, multi_line)
    if corrupt_column is not None:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column)
    if schema is not None:
        struct = to_struct(schema)
        if corrupt_column is not None and corrupt_column not in struct.names:
            struct = T.StructType([*struct.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.schema(struct)
    return reader.json([paths] if isinstance(paths, str) else list(paths))


def read_json_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    kind: str,
    element_schema: SchemaLike,
    multi_line: bool = True,
    recursive: bool = True,
) -> DataFrame:
    """Rows of the array ``kind`` (e.g. ``jobs``) of resource documents.

    The document schema is declared as ``STRUCT<kind: ARRAY<element>>`` so a
    document without that array gives no rows instead of an unresolved
    column, and only that array is parsed.  Pretty-printed documents need
    ``multi_line`` (one task per file); JSON Lines documents can be split.
    A malformed or truncated document raises.
    """
    element = to_struct(element_schema)
    doc = T.StructType([T.StructField(kind, T.ArrayType(element))])
    raw = _reader(spark, recursive, multi_line).schema(doc).json([paths] if isinstance(paths, str) else list(paths))
    return raw.select(F.explode(kind).alias("__item")).select("__item.*")
