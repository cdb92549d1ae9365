"""Half-hour series: slots, gap-free grids, rolling and decayed sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = "INTERVAL 30 MINUTES"


def slot_of(ts: str) -> Column:
    """Start of the half hour, as a timestamp without time zone."""
    return F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_800_000_000) * 1800).cast("timestamp_ntz")


def slotted(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key, slot_of(ts).alias("slot")).agg(F.sum(value).alias("v"))


def span(df: DataFrame, ts: str) -> tuple[str, str]:
    """First and last slot of the table."""
    first, last = df.select(slot_of(ts).cast("string").alias("slot")).agg(F.min("slot"), F.max("slot")).first()
    return first, last


def last_span(df: DataFrame, ts: str, n: int) -> tuple[str, str]:
    """First and last of the table's last n slots."""
    first, last = F.min("slot"), F.max("slot")
    found = df.select(slot_of(ts).alias("slot")).agg(F.greatest(first, last - F.expr(f"INTERVAL {30 * (n - 1)} MINUTES")).cast("string"), last.cast("string"))
    return tuple(found.first())


def grid(keys: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Every slot from first to last for each distinct key."""
    slots = F.explode(F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr(STEP)))
    return keys.select(key).distinct().select(key, slots.alias("slot"))


def densify(slots: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """The grid with values, 0 where there is none."""
    return grid(slots, key, first, last).join(slots, [key, "slot"], "left").select(key, "slot", F.coalesce("v", F.lit(0.0)).alias("v"))


def missing_slots(slots: DataFrame, key: str, first: str, last: str) -> DataFrame:
    return grid(slots, key, first, last).join(slots, [key, "slot"], "left_anti")


def rolling_sums(df: DataFrame, key: str, slot: str, value: str, hours: Sequence[int]) -> DataFrame:
    """Adds hN, the sum over the last N hours, the row's slot included; the series has no gaps. One window sort.

    A sum is put together from shorter ones that end at the row and before it, so each takes a few additions whatever its
    length, and nothing is subtracted, so no rounding error of a long running sum remains."""
    own, known, out = Window.partitionBy(key).orderBy(slot), {1: value}, df
    helpers = []

    def added(length: int, name: str) -> None:
        nonlocal out
        parts, left = [], length
        while left:
            part = max(n for n in known if n <= left)
            before = length - left
            parts.append(F.coalesce(F.lag(known[part], before).over(own), F.lit(0.0)) if before else F.col(known[part]))
            left -= part
        out, known[length] = out.withColumn(name, reduce(Column.__add__, parts)), name

    for h in sorted(set(hours)):
        while 2 * h // max(known) > 3:  # doubled, so that few parts do
            helpers.append(f"_sum{2 * max(known)}")
            added(2 * max(known), helpers[-1])
        if 2 * h in known:
            out = out.withColumn(f"h{h}", F.col(known[2 * h]))
        else:
            added(2 * h, f"h{h}")
    return out.drop(*helpers)


def decayed_sum(df: DataFrame, key: str, slot: str, value: str, decay: float, length: int) -> DataFrame:
    """Adds decayed: the sum of decay ** age * value over the last `length` slots of a series without gaps.

    The series is cut into blocks of `length` slots. Weighted sums within a block give its part of each sum, and the
    end of the block before, found `length` rows back, the other part. So the work is linear in the rows whatever the
    length, and weights stay within decay ** -length."""
    if not 0 < decay <= 1 or decay**length < 1e-150:
        raise ValueError("decay ** length is out of range")
    own = Window.partitionBy(key).orderBy(slot)
    out = df.withColumn("_i", F.row_number().over(own) - 1).withColumns({"_b": F.floor(F.col("_i") / length), "_j": F.col("_i") % length})
    block = Window.partitionBy(key, "_b")
    out = out.withColumn("_w", F.col(value) * F.pow(F.lit(decay), -F.col("_j")))
    out = out.withColumns({"_p": F.sum("_w").over(block.orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_w").over(block)})
    tail = (F.lag("_t", length).over(own) - F.lag("_p", length).over(own)) * F.pow(F.lit(decay), F.col("_j") + length)
    return out.withColumn("decayed", F.col("_p") * F.pow(F.lit(decay), F.col("_j")) + F.coalesce(tail, F.lit(0.0))).drop("_i", "_b", "_j", "_w", "_p", "_t")


def last_slots(df: DataFrame, key: str, slot: str, anchor: str, n: int) -> DataFrame:
    """The n slots up to the anchor, with index_in_window (n - 1 is the last) and minutes before it."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(slot)))
    out = df.where(F.col(slot) <= F.lit(anchor).cast("timestamp_ntz")).withColumn("_b", back).where(F.col("_b") <= n)
    return out.withColumns({"index_in_window": F.lit(n) - F.col("_b"), "minutes": -30 * (F.col("_b") - 1)}).drop("_b")
