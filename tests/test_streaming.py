"""The row transforms apply unchanged to a streaming frame, and a sink runs
per micro-batch from ``foreachBatch`` (an ``availableNow`` trigger drains
the input and stops)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tableflow.functions.text import substitute
from tableflow.operators.filters import skip_rules
from tableflow.sinks.csv import guarded_csv_export, read_csv

ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)


def test_transforms_and_sink_on_a_stream(spark, scratch):
    source = scratch("source")
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(ORDERS).parquet(source)
    shaped = skip_rules(stream, [("pending", F.col("o_orderstatus") == "P")]).withColumn(
        "o_orderpriority", substitute("o_orderpriority", [("-", "_")])
    )
    out = scratch("out")
    counter = []

    def each(batch, batch_id):
        counter.append(batch_id)
        guarded_csv_export(batch, f"{out}/batch={batch_id}")

    query = (
        shaped.writeStream.foreachBatch(each)
        .option("checkpointLocation", scratch("checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    back = read_csv(spark, out, ORDERS + ", skip_reason STRING, batch INT")
    total = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert back.count() == total
    assert back.filter(F.col("o_orderpriority").contains("-")).count() == 0
    assert back.filter("o_orderstatus = 'P'").filter(F.col("skip_reason").isNull()).count() == 0
