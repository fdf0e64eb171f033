"""Run by tests/test_faults.py in its own process: a session that retries
failed tasks, with one task's first attempt failing on purpose."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tableflow.plans.export import fan_out  # noqa: E402
from tableflow.session import build_session, scratch_path  # noqa: E402
from tableflow.sinks.csv import read_csv, write_csv  # noqa: E402
from tableflow.sinks.partitioned import partition_upsert  # noqa: E402

N = 20_000


@F.udf(T.LongType())
def fail_first_attempt(x):
    # test-only fault injection: partition 1 fails on its first attempt
    ctx = TaskContext.get()
    if ctx.partitionId() == 1 and ctx.attemptNumber() == 0 and x % 5000 == 7:
        raise RuntimeError("injected task failure")
    return x


def main() -> None:
    spark = build_session("local[4,4]", shuffle_partitions=4)
    df = (
        spark.range(N).repartition(4)
        .select(fail_first_attempt("id").alias("id"), (F.col("id") % 3).cast("string").alias("p"))
    )
    path = write_csv(df, scratch_path(spark, "fault_csv"))
    back = read_csv(spark, path, "id BIGINT, p STRING")
    assert back.count() == N and back.select("id").distinct().count() == N, "csv"

    ppath = scratch_path(spark, "fault_part")
    partition_upsert(df, ppath, ["p"])
    partition_upsert(df.filter(F.col("p") == "1").withColumn("id", -F.col("id")), ppath, ["p"])
    t = spark.read.schema("id BIGINT, p STRING").parquet(ppath)
    assert t.count() == N, "partition upsert count"
    assert t.filter("p = '1' AND id > 0").count() == 0, "partition replaced"

    res = fan_out(df, {"n": lambda d: d.count(), "s": lambda d: d.agg(F.sum("id")).first()[0]})
    assert res == {"n": N, "s": N * (N - 1) // 2}, res
    print("FAULTS-OK")
    spark.stop()


if __name__ == "__main__":
    main()
