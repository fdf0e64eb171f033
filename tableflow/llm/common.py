"""What the operators share on the DataFrame side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.session import scratch_path

#: Internal key of a row; no input column may have this name.
ROW = "__llm_row"

#: [\x20\x09-\x0D], the bytes between words, as a Java pattern.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, batch: int | None = None, row_group: int | None = None, large: bool = False) -> DataFrame:
    """Write to a new folder of the shared scratch space and read it back:
    cuts the lineage, survives lost executors and gives the optimizer the
    real size of what follows.  The shuffle files behind it are of no further
    use; a collection of the driver's garbage lets Spark's cleaner find them.
    `batch` bounds the rows of an Arrow batch meanwhile, for wide rows, and
    `row_group` the bytes that a writer or a reader of them holds.  The files of a
    `large` shuffle are removed when the write ends: garbage may be collected
    before Spark has let go of the write, and they would lie there until the next."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(limit)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(cleanup, "false")
    try:
        if batch is not None and not 0 < int(usual) <= batch:
            spark.conf.set(limit, batch)
        if large:
            spark.conf.set(cleanup, "true")
        writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
        writer.parquet(path)
    finally:
        spark.conf.set(limit, usual)
        spark.conf.set(cleanup, kept)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """`doc_id` (bigint), the named columns and a bigint key `ROW` per row,
    in the order of doc_id.

    Where doc_id is unique and never null it is the key.  Otherwise the rows
    are sorted by (doc_id, null first; text), written and numbered, so that
    every row, repeated rows too, has a key of its own.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *columns)
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return ids.withColumn(ROW, F.col("doc_id"))
    ordered = materialize(ids.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn(ROW, F.monotonically_increasing_id()), "row-keys")
    return ordered


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def word_list(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, null for none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def tokenizer_file() -> str:
    """The tokenizer that packing takes its ids from."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
