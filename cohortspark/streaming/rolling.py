"""Half-hour sums of a stream of events: the streaming counterpart of the slotted table (beyond the study's scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slot_sums(events: DataFrame, key: str, ts: str, value: str, late: str = "1 hour") -> DataFrame:
    """(key, slot, v): a sum per key and half hour; events later than the watermark allows are left out."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(key, F.window("_ts", "30 minutes").alias("w")).agg(F.sum(value).alias("v")).select(key, F.col("w.start").alias("slot"), "v")


def run_once(spark: SparkSession, path: str, schema: str, key: str, ts: str, value: str, out: str, checkpoint: str) -> DataFrame:
    """Takes all files now in the folder through the stream and returns the sums, those of windows still open too.

    In update mode each batch writes the windows that it changed, under its number; a window's sum is that of its last
    batch. (In append mode the windows within the watermark's reach of the end would never be written.)"""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is tried again writes the same

    stream = spark.readStream.schema(schema).parquet(path)
    q = slot_sums(stream, key, ts, value).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(key, "slot").agg(F.max_by("v", "batch").alias("v"))
