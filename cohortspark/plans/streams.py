"""Structured Streaming (beyond the study's scope)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..registry import Tables, query
from ..streaming.rolling import run_once


@query("wn5_stream_slots", "SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts)::VARCHAR AS slot, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def stream_slots(t: Tables) -> DataFrame:
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    t.events.select("user_id", "ts", "value").repartition(4).write.parquet(f"{base}/in")
    sums = run_once(t.spark, f"{base}/in", "user_id long, ts timestamp_ntz, value double", "user_id", "ts", "value", f"{base}/out", f"{base}/state")
    return sums.select("user_id", F.col("slot").cast("string").alias("slot"), F.round("v", 4).alias("v"))
