"""Features of a unit relative to its matched set, in long form (set_id, unit_id, feature, x)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATISTICS = ("mean", "std", "max", "min", "sum", "last", "maxabs")


def deviations(df: DataFrame, value: str = "x", by: Sequence[str] = ("set_id", "feature")) -> DataFrame:
    """Adds signed and absolute deviation from the set's mean. Labels and roles are no input."""
    d = F.col(value) - F.avg(value).over(Window.partitionBy(*by))
    return df.withColumn("signed", d).withColumn("absdev", F.abs("signed"))


def summaries(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The seven statistics of a series, one row per series."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.sum(v).alias("sum"), F.max_by(value, order).alias("last"), F.max(F.abs(v)).alias("maxabs"))


def derangement(keys: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """(key, other): a seeded order of the distinct keys, each with the next, the last with the first.

    Order is by MD5, cut into 16 ** digits blocks; neighbours inside a block come from a window, the last of a block
    takes the first of the next block that has one. So no task sorts all keys."""
    marked = keys.select(F.col(key).alias("k")).distinct().withColumn("h", F.md5(F.col("k").cast("string").cast("binary"))).withColumn("block", F.substring("h", 1, digits))
    inner = marked.withColumn("other", F.lead("k").over(Window.partitionBy("block").orderBy("h", "k")))
    firsts = marked.groupBy("block").agg(F.min(F.struct("h", "k")).alias("f"))
    whole = Window.orderBy("block")  # at most 16 ** digits rows
    after = firsts.withColumn("next", F.coalesce(F.lead("f.k").over(whole), F.first("f.k").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    linked = inner.join(F.broadcast(after.select("block", "next")), "block")
    return linked.select(F.col("k").alias(key), F.coalesce("other", "next").alias("other"))


def as_vector(df: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """Long to arrays in order of position, for the hand-over to learners."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("v"))
    return rows.withColumn("v", F.transform("v", lambda s: s[value]))


BLOCKS = ("static", "static_dev", "static_abs", "series", "series_dev", "series_abs", "series_stats")
# What each ablation holds, in order. Blocks are static values and flat series as they are, their deviations from
# the set's mean, signed and absolute, and STATISTICS of each channel's signed deviations.
ABLATIONS = {
    "A0": ("static", "series"),
    "A1": ("static", "series", "static_dev", "series_dev"),
    "A2": ("static", "series", "static_abs", "series_abs"),
    "A3": ("static", "series", "static_dev", "static_abs", "series_dev", "series_abs"),
    "A4": ("static", "static_dev", "static_abs", "series"),
    "A5": ("static", "series", "series_dev", "series_abs", "series_stats"),
    "A6": ("static", "static_dev", "static_abs", "series", "series_dev", "series_abs", "series_stats"),
}


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def channel_statistics(flat: Column, channels: int) -> Column:
    """STATISTICS of each channel of a flat series (time by time), each statistic for all channels in turn."""
    each = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / channels).cast("int") - 1), lambda t: F.get(flat, t * channels + c)))

    def spread(x: Column) -> Column:
        return F.sqrt(F.aggregate(F.transform(F.array(total(x) / F.size(x)), lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)), F.lit(0.0), lambda a, v: a + v))

    of = {"mean": lambda x: total(x) / F.size(x), "std": spread, "max": F.array_max, "min": F.array_min, "sum": total, "last": lambda x: F.element_at(x, -1), "maxabs": lambda x: F.array_max(F.transform(x, F.abs))}
    return F.flatten(F.transform(F.array(each), lambda e: F.concat(*(F.transform(e, of[k]) for k in STATISTICS))))


def _gathered(df: DataFrame, set_id: str, unit: str, static: str, series: str) -> DataFrame:
    """A row per set: m, its members (unit, s, r), and the means ms and mr of their values."""
    own = F.struct(F.col(unit).alias("unit"), F.col(static).cast("array<double>").alias("s"), F.col(series).cast("array<double>").alias("r"))

    def mean(part: str) -> Column:
        summed = F.aggregate(F.slice("m", 2, F.size("m")), F.element_at("m", 1)[part], lambda a, x: F.zip_with(a, x[part], lambda u, v: u + v))
        return F.transform(summed, lambda v: v / F.size("m"))

    return df.groupBy(set_id).agg(F.sort_array(F.collect_list(own)).alias("m")).select(set_id, "m", mean("s").alias("ms"), mean("r").alias("mr"))


def _about(rows: DataFrame, set_id: str, unit: str, channels: int) -> DataFrame:
    """BLOCKS of rows with m (unit, s, r) about the means ms and mr."""
    away = lambda x, m: F.zip_with(x, m, lambda u, v: u - v)
    rows = rows.select(set_id, F.col("m.unit").alias(unit), F.col("m.s").alias("static"), F.col("m.r").alias("series"), away("m.s", "ms").alias("static_dev"), away("m.r", "mr").alias("series_dev"))
    size = lambda c: F.transform(c, F.abs)
    return rows.select(set_id, unit, "static", "static_dev", size("static_dev").alias("static_abs"), "series", "series_dev", size("series_dev").alias("series_abs"), channel_statistics(F.col("series_dev"), channels).alias("series_stats"))


def set_blocks(df: DataFrame, set_id: str, unit: str, static: str, series: str, channels: int) -> DataFrame:
    """(set_id, unit, BLOCKS) of each member of a set. static and series are arrays of one length in all rows, series flat,
    time by time. Members of a set, three by contract, meet in one row for their means; labels are no input."""
    return _about(_gathered(df, set_id, unit, static, series).select(set_id, F.explode("m").alias("m"), "ms", "mr"), set_id, unit, channels)


def alien_blocks(df: DataFrame, set_id: str, unit: str, static: str, series: str, channels: int) -> DataFrame:
    """The same about the means of another set, the next in a seeded order: a placebo whose context says nothing."""
    sets = _gathered(df, set_id, unit, static, series)
    means = sets.select(F.col(set_id).alias("other"), "ms", "mr")
    rows = sets.select(set_id, F.explode("m").alias("m")).join(derangement(df, set_id), set_id).join(means, "other")
    return _about(rows, set_id, unit, channels)


def global_blocks(df: DataFrame, set_id: str, unit: str, static: str, series: str, channels: int) -> DataFrame:
    """The same about the means over all rows of df, a number for each value: the other placebo."""
    mean = lambda c: [r.m for r in df.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    own = F.struct(F.col(unit).alias("unit"), F.col(static).cast("array<double>").alias("s"), F.col(series).cast("array<double>").alias("r"))
    ms, mr = (F.array(*map(F.lit, mean(c))).cast("array<double>") for c in (static, series))
    return _about(df.select(set_id, own.alias("m"), ms.alias("ms"), mr.alias("mr")), set_id, unit, channels)


def variant(name: str) -> Column:
    """Feature vector of an ablation from the columns of set_blocks."""
    return F.concat(*map(F.col, ABLATIONS[name]))
