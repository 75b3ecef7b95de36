"""Event-time intervals as a stream: tumbling windows with a watermark, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scratch import folder

DELAY = "2 days"
WIDTH = "1 day"


def windowed(events: DataFrame, *, streaming: bool = False) -> DataFrame:
    """start, event_type, n, total: events of each day and type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", DELAY) if streaming else rows
    per = rows.groupBy(F.window("ts", WIDTH).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("bigint")).alias("total"))
    return per.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Everything that is at the path now, through a streaming query that updates a table; state and table are in the shared folder.

    A window's last update counts. Windows older than the watermark leave the state; a batch that is
    written twice changes nothing.
    """
    schema = spark.read.parquet(path).schema
    base = f"{folder(spark)}/{name}"
    out = f"{base}/updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).format("parquet").load(path)
    q = windowed(stream, streaming=True).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    updates = spark.read.schema("start string, event_type string, n long, total long, batch long").parquet(out)
    last = updates.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.total")
