"""CSV sinks: plain, guarded (write only when non-empty), single file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.names import quote as quote_name
from tableflow.sinks.formats import TEXT_TIME_OPTIONS
from tableflow.sources.schema import SchemaLike, to_struct

# CSV quoting used by the export step (quote char `"`; a quote
# inside a value is escaped with a backslash).
CSV_QUOTE = '"'
CSV_ESCAPE = "\\"


# Rows of an Arrow batch while packed rows move (a row may be a whole blob of
# some _BLOB_BYTES of rows, before they are compressed).
_ARROW_ROWS, _BLOB_BYTES = 64, 1 << 20
# Types that a packed batch gives back as they were.
_PACKABLE = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _packed(df: DataFrame, num_files: int) -> DataFrame:
    """``df`` in ``num_files`` partitions.  The rows travel as compressed
    batches of columns, which take about half of what shuffled rows take."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may repeat
    numbers = {f.name: f.dataType for f in own.schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType)}
    encoding = {c: "DELTA_BINARY_PACKED" if isinstance(t, T.IntegralType) else "BYTE_STREAM_SPLIT" for c, t in numbers.items()}
    others = [c for c in own.columns if c not in numbers]

    def blob(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_batches(held), sink, compression="zstd", use_dictionary=others, column_encoding=encoding)
        return pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _BLOB_BYTES:
                yield blob(held)
                held, size = [], 0
        if held:
            yield blob(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("rows"):
                yield from pq.read_table(pa.BufferReader(blob.as_buffer())).to_batches()

    moved = own.mapInArrow(pack, "rows binary").repartition(num_files)
    return moved.mapInArrow(unpack, own.schema).toDF(*df.columns)


def _shape(df: DataFrame, num_files: int | None, strategy: str) -> DataFrame:
    if num_files is None:
        return df
    if strategy == "repartition":
        # Shuffle into n partitions: the upstream stage keeps its parallelism.
        return df.repartition(num_files)
    if strategy == "coalesce":
        # No shuffle, but the whole upstream stage runs in n tasks.
        return df.coalesce(num_files)
    if strategy == "packed":
        # As repartition, with fewer bytes to read for the tasks that write.
        plain = all(isinstance(f.dataType, _PACKABLE) for f in df.schema)
        return _packed(df, num_files) if plain and df.columns else df.repartition(num_files)
    raise ValueError(f"unknown strategy {strategy!r}")


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    num_files: int | None = None,
    strategy: str = "repartition",
    compression: str = "none",
    partition_by: Sequence[str] = (),
    header: bool = False,
    quote: str = CSV_QUOTE,
    escape: str = CSV_ESCAPE,
    trim: bool = False,
) -> str:
    """Write ``df`` as CSV.  ``num_files=None`` keeps one file per partition
    (parallel); ``num_files=n`` shapes the output with ``strategy``.  With
    ``partition_by`` each value gets its own folder; rows are first
    rebalanced by those columns (AQE splits a hot value over several tasks)
    so each folder gets few files without one task owning a hot value.
    Text is written as it is; ``trim`` drops white space around values."""
    out = _shape(df, num_files, strategy)
    if partition_by and num_files is None:
        out = out.hint("rebalance", *map(quote_name, partition_by))
    writer = (
        out.write.mode(mode)
        .option("compression", compression)
        .option("header", header)
        .option("quote", quote)
        .option("escape", escape)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .options(**TEXT_TIME_OPTIONS)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if strategy != "packed":
        writer.csv(path)
        return path
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(limit)
    conf.set(limit, _ARROW_ROWS)
    try:
        writer.csv(path)
    finally:
        conf.set(limit, usual)
    return path


def read_csv(
    spark: SparkSession,
    path: str,
    schema: SchemaLike,
    header: bool = False,
    multi_line: bool = False,
    quote: str = CSV_QUOTE,
    escape: str = CSV_ESCAPE,
    recursive: bool = False,
) -> DataFrame:
    """Read CSV written by ``write_csv`` with a declared schema.  Turn on
    ``multi_line`` only when values hold line breaks (such files are read by
    one task each).  Both null and ``""`` read back as null."""
    reader = (
        spark.read.schema(to_struct(schema))
        .option("header", header)
        .option("quote", quote)
        .option("escape", escape)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .options(**TEXT_TIME_OPTIONS)
    )
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.csv(path)


def guarded_csv_export(
    df: DataFrame,
    path: str,
    num_files: int | None = None,
    strategy: str = "repartition",
    header: bool = False,
) -> tuple[DataFrame, bool]:
    """Overwrite ``path`` with ``df`` as CSV only if ``df`` has a row; an
    empty frame leaves the earlier output in place.  Returns the frame
    unchanged and whether it was written.

    The guard is ``isEmpty`` (stops at the first row), not a full count.
    The frame is evaluated twice (guard, write); persist it upstream when it
    is expensive (``plans.export.fan_out`` can).
    """
    if df.isEmpty():
        return df, False
    write_csv(df, path, mode="overwrite", num_files=num_files, strategy=strategy, header=header)
    return df, True


def single_file_csv(df: DataFrame, path: str, strategy: str = "packed", **kwargs) -> str:
    """One CSV file.  ``packed`` (default) and ``repartition`` keep the upstream
    stage parallel and funnel only the final write through one task, which reads
    the rows as compressed batches or one by one; ``coalesce`` avoids the
    shuffle but runs the whole upstream stage in one task."""
    return write_csv(df, path, num_files=1, strategy=strategy, **kwargs)


def output_file_stats(spark: SparkSession, path: str, schema: SchemaLike) -> DataFrame:
    """One row ``(n_files, n_rows)`` for a CSV folder.  Files are counted in
    the listing that Spark makes of the folder anyway, so one without rows
    counts too; rows are counted by a scan."""
    data = read_csv(spark, path, schema)
    n_files = F.lit(len(data.inputFiles())).cast("bigint")
    return data.agg(F.count(F.lit(1)).alias("n_rows")).select(n_files.alias("n_files"), "n_rows")
