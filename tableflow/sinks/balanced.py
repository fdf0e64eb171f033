"""Text files of equal bytes in key order.

``repartitionByRange`` makes ranges of equal row counts from a sample, so files
differ as rows do.  Here each row's bytes in the file are summed in key order,
and the running sum says which file a row belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.operators.names import column as column_of
from tableflow.operators.names import quote
from tableflow.session import scratch_path
from tableflow.sinks.csv import CSV_ESCAPE, CSV_QUOTE, write_csv
from tableflow.sinks.formats import TEXT_TIME_OPTIONS

_BITS = 33  # monotonically_increasing_id: partition above, row in it below


def csv_bytes(df: DataFrame) -> Column:
    """The bytes that a row takes in a CSV file of ``write_csv``."""
    row = F.struct(*[F.col(quote(c)) for c in df.columns])
    return F.octet_length(F.to_csv(row, {"quote": CSV_QUOTE, "escape": CSV_ESCAPE, **TEXT_TIME_OPTIONS})) + 1


def write_balanced_csv(df: DataFrame, path: str, order_by: str | Sequence[str], num_files: int, mode: str = "errorifexists") -> str:
    """Write ``df`` as ``num_files`` CSV files whose rows, file after file, are
    in the order of ``order_by``, and whose sizes differ by about a row.

    The rows are sorted and written once to the scratch folder, so that counts
    and rows come from the same partitions; a task then sums a sorted partition,
    and each file is one task's.  Fewer rows than files leave files out."""
    if num_files < 1:
        raise ValueError("num_files must be at least 1")
    spark = df.sparkSession
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    names = [f"c{i}" for i in range(len(df.columns))]
    own = [column_of(df, k).alias(f"k{i}") for i, k in enumerate(keys)]
    plain = df.select(*[F.col(quote(c)).alias(n) for c, n in zip(df.columns, names)], *own, csv_bytes(df).alias("size"))
    folder = scratch_path(spark, "balanced")
    plain.orderBy(*[f"k{i}" for i in range(len(keys))]).withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("part", F.shiftright("at", _BITS))

    sums = rows.groupBy("part").agg(F.sum("size").alias("bytes"))  # a row per partition
    before = F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    total = sums.agg(F.sum("bytes")).first()[0] or 1
    inner = F.sum("size").over(Window.partitionBy("part").orderBy("at")) - F.col("size")
    # A row's middle decides, so that no file has a row too many on either side.
    middle = F.col("before") + F.col("inner") + F.col("size") / 2
    file = F.least(F.floor(middle * num_files / F.lit(total)), F.lit(num_files - 1)).cast("int")
    dealt = rows.withColumn("inner", inner).join(offsets, "part").withColumn("file", file).repartitionById(num_files, "file").sortWithinPartitions("at")
    return write_csv(dealt.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)]), path, mode=mode)
