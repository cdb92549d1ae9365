"""Ranking and classification metrics, exact, from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import ranged


def running(counts: DataFrame, order: str, cols: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds before_x, the sum of x over rows earlier in order, and all_x. Rows are dealt by ranges of the order, and
    sums of ranges give each its start, so that one task never holds all."""
    key = F.col(order).desc() if descending else F.col(order)
    dealt = ranged(counts, *by, key)
    sums = dealt.groupBy("_p", *by).agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    span = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = sums.select("_p", *by, *[F.coalesce(F.sum(f"_s_{c}").over(span), F.lit(0.0)).alias(f"_o_{c}") for c in cols], *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in cols])
    own = Window.partitionBy("_p", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(own), F.lit(0.0)) for c in cols}).join(F.broadcast(starts), ["_p", *by])
    return out.withColumns({f"before_{c}": F.col(f"_o_{c}") + F.col(f"_b_{c}") for c in cols}).drop("_p", *[f"{x}{c}" for x in ("_b_", "_o_") for c in cols])


def per_score(df: DataFrame, score: str, label: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))


def auroc(df: DataFrame, score: str, label: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, auroc): weighted, ties count half; null if a class is missing."""
    r = running(per_score(df, score, label, weight, by), "s", ["pos", "neg"], by)
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return r.groupBy(*by).agg((won / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0.0))).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, auprc): steps of recall times precision over distinct thresholds, highest first."""
    r = running(per_score(df, score, label, weight, by), "s", ["pos", "neg"], by, descending=True)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return r.groupBy(*by).agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.nullif(F.max("all_pos"), F.lit(0.0))).alias("auprc"))


def set_outcomes(df: DataFrame, score: str, set_id: str = "set_id", label: str = "y") -> DataFrame:
    """(set_id, strict, edge, margin): ties lose."""
    pos = F.max(F.when(F.col(label) == 1, F.col(score)))
    others = F.collect_list(F.when(F.col(label) == 0, F.col(score)))  # two controls
    g = df.groupBy(set_id).agg(pos.alias("p"), F.max(F.when(F.col(label) == 0, F.col(score))).alias("m"), others.alias("o"))
    wins = F.size(F.filter("o", lambda x: F.col("p") > x))
    return g.select(set_id, (F.col("p") > F.col("m")).cast("int").alias("strict"), (wins / F.size("o")).alias("edge"), (F.col("p") - F.col("m")).alias("margin"))


def confusion(df: DataFrame, prob: str, label: str, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn, sensitivity, specificity, youden, f1, balanced and brier."""
    hit, y = F.col(prob) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"), F.avg((F.col(prob) - F.col(label)) ** 2).alias("brier"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    c = c.withColumns({"sensitivity": ratio("tp", "fn"), "specificity": ratio("tn", "fp"), "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))})
    return c.withColumns({"youden": F.col("sensitivity") + F.col("specificity") - 1, "balanced": (F.col("sensitivity") + F.col("specificity")) / 2})


def weighted_median(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the value where half of the weight is reached, the mean of two where it is met exactly."""
    c = df.groupBy(F.col(value).alias("s")).agg(F.sum(weight).alias("w"))
    r = running(c, "s", ["w"]).withColumn("upto", F.col("before_w") + F.col("w"))
    half = F.col("all_w") / 2
    low = F.min(F.when(F.col("upto") >= half, F.col("s")))
    high = F.min(F.when(F.col("upto") > half, F.col("s")))
    return r.agg(((low + high) / 2).alias("weighted_median"))
