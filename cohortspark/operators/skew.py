"""Joins to a small fact per key where a few keys may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT = 256


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """(key) of the keys that hold more than twice a shuffle partition's even share of the rows; None if there is none.

    There are fewer of them than half the partitions, so their table may be broadcast whatever the input."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    limit = max(LEAST_HOT, 2 * rows.count() // parts)
    hot = [r[0] for r in counts.where((F.col("_n") > limit) & F.col(key).isNotNull()).select(key).collect()]
    return rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema) if hot else None


def split_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to facts, which has one row per key; the rows of hot keys stay where they are and meet their facts by
    broadcast, all others are shuffled by key. rows is read several times: give a written table. how: inner or left."""
    hot = hot_keys(rows, key)
    if hot is None:
        return rows.join(facts, key, how)
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    told = rows.join(mark, key, "left")
    return told.where("_hot").drop("_hot").join(few, key, how).unionByName(told.where("_hot is null").drop("_hot").join(facts, key, how))
