"""Clustered paired bootstrap: whole sets are drawn, the same draws for both arms.

How often a set stands in a replicate is a Poisson count of mean 1, drawn for each set by itself, and statistics are
weighted by the counts. That is the bootstrap's limit for many sets, without one list of n draws a replicate: no set
needs a number, nothing but sums leaves a task, and B sums are all that is shuffled, whatever the number of sets."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import durable
from .statistics import quantiles

DIGITS = 4  # hexadecimal digits of a draw; an MD5 holds eight draws
DRAWS = 32 // DIGITS
# Least draw, of 16 ** DIGITS, for counts of 1, 2, ... by the Poisson distribution function.
STEPS = tuple(s for k in range(10) if (s := round(16**DIGITS * sum(exp(-1) / factorial(i) for i in range(k + 1)))) < 16**DIGITS)


def draw_digest(key: Column, block: Column, seed: int) -> Column:
    """Digits for the draws of a set in DRAWS replicates in turn. The same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), key.cast("string")).cast("binary"))


def counted(draw: Column) -> Column:
    """Poisson count of a draw of DIGITS lower-case hexadecimal digits, which compare as the numbers do."""
    times = F.lit(0)
    for s in STEPS:
        times = times + (draw >= f"{s:0{DIGITS}x}").cast("int")
    return times


def draw_counts(sets: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """sets with b and times: how often each set stands in each replicate, where it does. B / e rows are left of a set;
    sum them before they are shuffled."""
    spread = sets.repartition(sets.sparkSession.sparkContext.defaultParallelism, key)  # few sets make many rows
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1)))
    marked = spread.withColumn("_block", blocks).withColumn("_digits", draw_digest(F.col(key), F.col("_block"), seed))
    draws = F.posexplode(F.array(*[F.substring("_digits", 1 + DIGITS * i, DIGITS) for i in range(DRAWS)])).alias("_i", "_draw")
    out = marked.select(*sets.columns, "_block", draws).where(F.col("_draw") >= f"{STEPS[0]:0{DIGITS}x}")
    out = out.select(*sets.columns, (F.col("_block") * DRAWS + F.col("_i")).alias("b"), counted(F.col("_draw")).cast("long").alias("times"))
    return out.where(F.col("b") < replicates)


def replicate_means(sets: DataFrame, key: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(b, n, one column for each value): number drawn and weighted means in each replicate."""
    drawn = draw_counts(sets.select(key, *values), key, replicates, seed)
    means = [(F.sum(F.col("times") * F.col(v)) / F.sum("times")).alias(v) for v in values]
    return drawn.groupBy("b").agg(F.sum("times").alias("n"), *means)


def paired_bootstrap(sets: DataFrame, key: str, one: str, two: str, replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """One row: observed delta of the means of two over one, mean and median over replicates, 95 % interval, the share
    above 0, a two-sided p with one added, and whether the interval is above 0."""
    values = sets.select(key, (F.col(two) - F.col(one)).alias("delta"))
    reps = replicate_means(values, key, ["delta"], replicates, seed)
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))  # a row per replicate
    low, high = F.count_if(F.col("delta") <= 0), F.count_if(F.col("delta") >= 0)
    p = F.least(F.lit(1.0), 2 * (F.least(low, high) + 1) / (F.count("*") + 1))
    out = reps.agg(F.avg("delta").alias("mean_delta"), q.alias("q"), F.avg((F.col("delta") > 0).cast("int")).alias("p_above_0"), p.alias("two_sided_p"), F.count("*").alias("replicates"))
    out = values.agg(F.avg("delta").alias("observed")).join(F.broadcast(out))  # one row each
    return out.select("observed", "mean_delta", F.col("q")[1].alias("median_delta"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"), "p_above_0", "two_sided_p", (F.col("q")[0] > 0).alias("supported"), "replicates")


def replicate_medians(sets: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(b, n, median): the weighted median of `value` in each replicate, the mean of the two middle ones of an even number.

    A replicate's median lies near the sample's, so a bracket of some standard errors around that is taken: what is drawn
    below it is counted, and only values inside are counted one by one, a number of values that grows with the root of the
    sets. Where a replicate's median falls outside, the bracket is doubled. Null values are never drawn."""
    rows = durable(sets.select(key, F.col(value).cast("double").alias("v")).where("v is not null"))
    reach = 5.0 / max(1, rows.count()) ** 0.5
    while True:
        ends = [max(0.0, 0.5 - reach), min(1.0, 0.5 + reach)]
        low, high = quantiles(rows, {"v": F.col("v")}, ends)["v"]
        drawn = draw_counts(rows, key, replicates, seed).withColumn("at", F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0))
        counts = durable(drawn.groupBy("b", F.when(F.col("at") == 0, F.col("v")).alias("v"), "at").agg(F.sum("times").alias("k")))
        whole = counts.groupBy("b").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("at") < 0, F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("at") == 0, F.col("k")).otherwise(0)).alias("inside"))
        first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        if whole.where((first < F.col("below")) | (second >= F.col("below") + F.col("inside"))).isEmpty():
            break
        reach *= 2
    run = counts.where("at = 0").withColumn("upto", F.sum("k").over(Window.partitionBy("b").orderBy("v"))).join(whole, "b")
    at = lambda place: F.min(F.when(F.col("below") + F.col("upto") > place, F.col("v")))
    return run.groupBy("b", "n").agg(((at(first) + at(second)) / 2).alias("median"))
