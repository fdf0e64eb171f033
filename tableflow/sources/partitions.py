"""Partitions of an existing table from its file listing.

The values of a table's partitions stand in its paths.  The listing is read as a
table of paths (Spark lists large folders in parallel) and decoded; no row of
the table is read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.operators.names import column as column_of
from tableflow.operators.reconcile import sync_plan

# Fixed value: what Spark writes for a null (and for an empty text) in a path.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# The characters that Spark writes as %XX in a path.
ESCAPED = [chr(c) for c in range(1, 32)] + ['"', "#", "%", "'", "*", "/", ":", "=", "?", "\\", "\x7f", "{", "[", "]", "^"]


def _in_path(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in text)


def _value(path: Column, name: str) -> Column:
    """The decoded value of a partition column in a path."""
    raw = F.regexp_extract(path, f"/{re.escape(_in_path(name))}=([^/]*)/", 1)
    decoded = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))  # a plus sign is no blank here
    return F.when(raw != NULL_PARTITION, decoded)


def listed_partitions(spark: SparkSession, path: str, partition_by: Sequence[str]) -> DataFrame:
    """One row per partition of the table at ``path`` that has a file: its
    value list ``values`` (texts, in the order of ``partition_by``; null for
    the null partition), its number of files and their bytes."""
    if not partition_by:
        raise ValueError("partition_by is required")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "[!._]*")
        .load(path)
        .select("path", "length")
    )
    values = F.array(*[_value(F.col("path"), name) for name in partition_by])
    return files.groupBy(values.alias("values")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def partition_values(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The distinct value lists of a source's rows, as a listing has them: as
    text, an empty one as null."""
    texts = [F.nullif(column_of(df, c).cast("string"), F.lit("")) for c in partition_by]
    return df.select(F.array(*texts).alias("values")).distinct()


def partition_plan(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """What ``partition_upsert(df, path, ...)`` would do: ``values`` of each
    partition that ``df`` has rows for, and ``create`` or ``overwrite``.  Only
    the partition columns of ``df`` are read, and of the table only its listing."""
    listed = listed_partitions(df.sparkSession, path, partition_by).select("values")
    return sync_plan(partition_values(df, partition_by), listed, "values")
