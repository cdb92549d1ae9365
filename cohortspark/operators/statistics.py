"""Statistics of one or two samples, as grouped sums and windows over counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import ranged
from .metrics import running


def unbiased_skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], accuracy: int = 1000) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of whole columns, whatever their size; nulls and NaN are left out.

    A sketch brackets each quantile; one pass counts what lies below each bracket, and only the few values inside are
    counted up exactly, in ranges (running). percentile() alone would hold all distinct values in one task. The driver
    gets two numbers for each column and quantile."""
    names, step = list(columns), 3.0 / accuracy
    x = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(columns.values())])
    around = lambda margin: [e for p in probs for e in (max(0.0, p - step - margin), min(1.0, p + step + margin))]
    sketch = lambda c, margin: F.percentile_approx(c, around(margin), accuracy).alias(c)
    first = x.agg(*[F.count(c).alias(f"n_{c}") for c in x.columns], *[sketch(c, 0.0) for c in x.columns]).first()
    count, seen = {c: first[f"n_{c}"] for c in x.columns}, first.asDict()
    # Brackets reach two rows farther than the sketch's error, as a quantile lies between two rows: with few rows they are
    # drawn anew, with many the step beyond the error holds that many.
    if few := [c for c, n in count.items() if 0 < n < 1000 * max(1, accuracy // 1000)]:
        seen |= x.agg(*[sketch(c, 2 / count[c]) for c in few]).first().asDict()
    targets, below, inside = [], [], []
    for i, c in enumerate(x.columns):
        for j, p in enumerate(probs):
            if count[c]:
                lo, hi = seen[c][2 * j], seen[c][2 * j + 1]
                low = int(p * (count[c] - 1))
                targets.append((i, j, low, min(low + 1, count[c] - 1)))
                below.append(F.count_if(F.col(c) < lo))
                inside.append(F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("x"))))
    if not targets:
        return {n: [None] * len(probs) for n in names}
    less = x.agg(F.array(*below)).first()[0]
    counts = x.select(F.explode(F.array(*inside)).alias("v")).where("v is not null").groupBy("v.i", "v.j", "v.x").agg(F.count("*").cast("double").alias("k"))
    wanted = df.sparkSession.createDataFrame([(*t, float(b)) for t, b in zip(targets, less, strict=True)], "i int, j int, low long, high long, less double")
    run = running(counts, "x", ["k"], ["i", "j"]).join(F.broadcast(wanted), ["i", "j"])  # a row for each column and quantile
    at = lambda k: F.min(F.when(F.col("less") + F.col("before_k") + F.col("k") > F.col(k), F.col("x")))
    found = {(r["i"], r["j"]): (r["a"], r["b"]) for r in run.groupBy("i", "j").agg(at("low").alias("a"), at("high").alias("b")).collect()}
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        n = count[f"x{i}"]
        part = lambda p, n=n: p * (n - 1) - int(p * (n - 1))
        out[name] = [found[i, j][0] + (found[i, j][1] - found[i, j][0]) * part(p) if n else None for j, p in enumerate(probs)]
    return out


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, n, q): exact quantiles (linear interpolation) of each group, null where it has no value; nulls and NaN are left out.

    Values are counted by group and run up in ranges, so a group that holds most of the rows is split."""
    # One text for the group, null in none of its parts, as joins pass over nulls.
    x = df.select(F.to_json(F.struct(*by)).alias("_g"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("x"))
    run = running(x.where("x is not null").groupBy("_g", "x").agg(F.count("*").cast("double").alias("k")), "x", ["k"], ["_g"])
    at = lambda place: F.min(F.when(F.col("before_k") + F.col("k") > place, F.col("x")))
    spots = [F.lit(float(p)) * (F.col("all_k") - 1) for p in probs]
    ends = [e for i, s in enumerate(spots) for e in (at(F.floor(s)).alias(f"a{i}"), at(F.least(F.floor(s) + 1, F.col("all_k") - 1)).alias(f"b{i}"))]
    found = run.groupBy("_g").agg(F.max("all_k").cast("long").alias("n"), *ends)
    part = lambda p: F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1))
    q = found.select("_g", "n", F.array(*(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * part(p) for i, p in enumerate(probs))).alias("q"))
    groups = df.select(*by).distinct().withColumn("_g", F.to_json(F.struct(*by)))
    return groups.join(q, "_g", "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "q")


def exact_quantiles(df: DataFrame, col: str, probs: Mapping[str, float], accuracy: int = 1000) -> DataFrame:
    """One row of quantiles of a column."""
    found = quantiles(df, {col: F.col(col)}, list(probs.values()), accuracy)[col]
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in probs))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2 (no continuity correction) and cramers_v of two categories."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    margin = lambda k: c.groupBy(k).agg(F.sum("n").alias(f"n_{k}"))
    total = c.agg(F.sum("n").alias("all"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"))
    # Cells without rows add their expectation: sum(n^2 / e) - total covers them.
    e = c.join(margin(a), a).join(margin(b), b).join(F.broadcast(total))
    chi = (F.sum(F.col("n") * F.col("n") / (F.col(f"n_{a}") * F.col(f"n_{b}") / F.col("all"))) - F.first("all")).alias("chi2")
    out = e.agg(chi, F.first("all").alias("n"), F.least(F.first("r"), F.first("k")).alias("d"))
    return out.select("n", "chi2", F.sqrt(F.col("chi2") / F.col("n") / F.nullif(F.col("d") - 1, F.lit(0))).alias("cramers_v"))


def smd(df: DataFrame, cols: Sequence[str], arm: str) -> DataFrame:
    """(feature, smd): standardised mean difference of arm 1 against 0, pooled sample variances."""
    stats = [x for c in cols for i in (0, 1) for x in (F.avg(F.when(F.col(arm) == i, F.col(c))).alias(f"m{i}_{c}"), F.var_samp(F.when(F.col(arm) == i, F.col(c))).alias(f"v{i}_{c}"))]
    one = df.agg(*stats)
    value = lambda c: (F.col(f"m1_{c}") - F.col(f"m0_{c}")) / F.nullif(F.sqrt((F.col(f"v1_{c}") + F.col(f"v0_{c}")) / 2), F.lit(0.0))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("smd")) for c in cols])).alias("s")).select("s.*")


def cumulative_shares(df: DataFrame, value: str, arm: str) -> DataFrame:
    """(x, f, g): the two arms' distribution functions at each distinct value.

    Values are counted before they are ordered, so the window runs over distinct values, in ranges: sums of ranges
    give each its start."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count_if(F.col(arm) == 1).alias("a"), F.count_if(F.col(arm) == 0).alias("b"))
    dealt = ranged(counts, "x")
    sums = dealt.groupBy("_p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sums.select("_p", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("ob"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    own = Window.partitionBy("_p").orderBy("x")
    run = dealt.withColumns({"ra": F.sum("a").over(own), "rb": F.sum("b").over(own)}).join(F.broadcast(starts), "_p").join(F.broadcast(total))
    return run.select("x", ((F.col("ra") + F.col("oa")) / F.col("na")).alias("f"), ((F.col("rb") + F.col("ob")) / F.col("nb")).alias("g"))


def ks(shares: DataFrame) -> DataFrame:
    return shares.agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("ks"))


def wasserstein(shares: DataFrame) -> DataFrame:
    """Integral of |F - G|: each distinct value's difference times the gap to the next value."""
    dealt = ranged(shares, "x")
    firsts = dealt.groupBy("_p").agg(F.min("x").alias("first"))
    nexts = firsts.select("_p", F.lead("first").over(Window.orderBy("_p")).alias("after"))  # a row per partition
    gap = F.coalesce(F.lead("x").over(Window.partitionBy("_p").orderBy("x")), F.col("after")) - F.col("x")
    return dealt.join(F.broadcast(nexts), "_p").withColumn("_gap", gap).agg(F.sum(F.abs(F.col("f") - F.col("g")) * F.coalesce("_gap", F.lit(0.0))).alias("w1"))


def psi(df: DataFrame, value: str, arm: str, bins: int = 10, clip: float = 1e-6) -> DataFrame:
    """Population stability index against arm 1's quantile bins (repeated edges dropped, ends open), shares clipped and
    brought back to sum 1."""
    found = quantiles(df.where(F.col(arm) == 1), {value: F.col(value)}, [i / bins for i in range(bins + 1)])[value]
    inner = sorted({e for e in found if e is not None})[1:-1]
    at = sum(((F.col(value) > e).cast("int") for e in inner), F.lit(0))
    binned = df.where(F.col(value).isNotNull()).select(arm, at.alias("bin"), F.lit(len(inner) + 1).alias("k"))
    counts = binned.groupBy("bin", "k").agg(F.count_if(F.col(arm) == 1).alias("a"), F.count_if(F.col(arm) == 0).alias("b"))
    all_bins = counts.select("k").distinct().select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin")).join(counts, "bin", "left")
    whole = Window.partitionBy()  # as many rows as bins
    share = lambda c: F.greatest(F.lit(clip), F.coalesce(c, F.lit(0)) / F.sum(c).over(whole))
    s = all_bins.select(share(F.col("a")).alias("p"), share(F.col("b")).alias("q"))
    n = s.select((F.col("p") / F.sum("p").over(whole)).alias("p"), (F.col("q") / F.sum("q").over(whole)).alias("q"))
    return n.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties averaged, from counts of distinct values in ranges."""
    counts = df.groupBy(value).agg(F.count("*").alias("_k"))
    dealt = ranged(counts, value)
    starts = dealt.groupBy("_p").agg(F.sum("_k").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    run = dealt.withColumn("_r", F.sum("_k").over(Window.partitionBy("_p").orderBy(value))).join(F.broadcast(starts), "_p")
    return df.join(run.select(value, (F.col("_o") + F.col("_r") - (F.col("_k") - 1) / 2).alias(out)), value)
