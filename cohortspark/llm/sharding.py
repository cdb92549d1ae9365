"""Jump consistent hashing (Lamping and Veach, 2014): rows to shards without a ring table."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import fits_broadcast, own_names

# Fixed values of the published function: the multiplier of its generator, and 2 to the 64th.
MULTIPLIER, WORD = "2862933555777941757", "18446744073709551616"


def hash_key(df: DataFrame, key: str) -> Column:
    """The unsigned 64-bit key: integers as they are (two's complement), other types by xxhash64; null counts as 0."""
    c = F.col(key) if isinstance(df.schema[key].dataType, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    d = F.coalesce(c.cast("long"), F.lit(0)).cast("decimal(20,0)")
    return F.when(d < 0, d + F.lit(WORD).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the bucket of key among `shards`, and among one more.

    One fold follows the jumps of the larger count; every jump goes up by one at least, so shards + 1 steps always
    suffice, and steps after the last jump keep the state."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(WORD).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(20,0)")).cast("double") + 1.0
        moved = F.struct(
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / high)).cast("long").alias("j"),
            k.alias("k"),
        )
        return F.when(s["j"] > shards, s).otherwise(moved)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"), key.alias("k"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return F.transform(F.array(end), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


@own_names
def assign_shards(df: DataFrame, key: str, shards: int, order: list[Column] | None = None, block_rows: int = 10_000) -> DataFrame:
    """Adds shard, grown_shard (with one shard more) and slot, the row's place in its shard, gapless from 0.

    Rows of a shard are ordered by the MD5 of key and `order`, then by these. Slots are numbered in two levels: each
    shard is cut into blocks by the first digits of that MD5, as many as leave about `block_rows` rows in each, a table
    of block counts gives each block its first slot, and rows are numbered in their block. So no task holds a whole
    shard, nor all rows of a repeated key that differ in `order`. A null key counts as 0, rows with equal keys share a
    shard and rows equal in all of `order` take its slots in any order. An empty table gives an empty table. Columns
    shard, grown_shard and slot of the input are replaced, all others are carried along, whatever their names."""
    df = df.drop(*[c for c in ("shard", "grown_shard", "slot") if c != key])
    digits = max(1, ceil(log(max(1, df.count() / shards / block_rows), 16)))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(key), *(order or []))]
    hashed = F.md5(F.concat_ws(":", *parts).cast("binary"))
    keyed = df.withColumn("_jump", jump(hash_key(df, key), shards)).withColumns({"shard": F.col("_jump.shard"), "grown_shard": F.col("_jump.grown"), "_hash": hashed}).drop("_jump")
    keyed = keyed.withColumn("_block", F.substring("_hash", 1, digits))
    counts = keyed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # At most shards * 16 ** digits rows: one for some block_rows / 16 rows or more.
    if fits_broadcast(shards * 16**digits, 64):
        firsts = F.broadcast(firsts)
    inside = Window.partitionBy("shard", "_block").orderBy("_hash", F.col(key), *(order or []))
    return keyed.join(firsts, ["shard", "_block"]).withColumn("slot", F.col("_first") + F.row_number().over(inside) - 1).drop("_block", "_first", "_hash")
