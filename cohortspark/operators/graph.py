"""Connected components of an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, one process (a local master) takes
    a temporary folder; a cluster, whose executors would not see it, raises RuntimeError."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cohortspark-")
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/cohortspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `durable` has written and that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df dealt by ranges of the keys, written out with its partition's number _p. Written, as a second evaluation may
    draw other bounds and AQE may merge partitions, and then numbers and rows of two uses would not agree."""
    return durable(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in the edges; root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a minimum and a join, written out each
    round; neighbours are never gathered into one row. A round's table is deleted when the next is written."""
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    alone = start.where("u = v").select(F.col("u").alias("node"))
    edges, state = durable(start.where("u <> v")), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
    return found.union(alone.join(found, "node", "left_anti").select("node", "node"))
