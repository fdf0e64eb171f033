"""Partition upsert: create new partitions, replace those that exist, leave
all others untouched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableflow.operators.names import quote


def partition_upsert(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
) -> str:
    """Dynamic partition overwrite: only the partitions ``df`` has rows for
    are rewritten; the table's other partitions stay as they are.

    Rows are rebalanced by the partition columns before the write (AQE
    splits a hot partition value over several tasks) so each partition gets
    few files and no task owns a whole hot partition.  ``df`` must not be
    read from ``path`` itself.
    """
    if not partition_by:
        raise ValueError("partition_by is required")
    (
        df.hint("rebalance", *map(quote, partition_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .format(fmt)
        .save(path)
    )
    return path
