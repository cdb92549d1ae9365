"""Inference and distribution shift (IN)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded_as_sql
from ..operators import statistics as S
from ..operators.bootstrap import DIGITS, DRAWS, STEPS, draw_counts, paired_bootstrap, replicate_medians
from ..operators.context import deviations
from ..registry import Tables, query
from .cohort import FEATURES, MEMBERS_SQL, SETSCORE_SQL, UNITS_SQL, scores, set_scores, units
from .representation import LONG_SQL, long_features

R = F.round
WIN = "({a}_p > greatest({a}_1, {a}_2))::INTEGER"
B = 10_000
DRAWS_SQL = f"""w AS (SELECT set_id, {WIN.format(a='raw')} AS one, {WIN.format(a='ctx')} AS two FROM setscore),
dg AS (SELECT set_id, k, md5('7:' || k || ':' || set_id) AS h FROM w, (SELECT unnest(range({B // DRAWS})) AS k)),
dr AS (SELECT set_id, k * {DRAWS} + i AS b, substr(h, 1 + {DIGITS} * i, {DIGITS}) AS u FROM dg, (SELECT unnest(range({DRAWS}))::INTEGER AS i)),
cnt AS (SELECT set_id, b, {' + '.join(f"(u >= '{x:0{DIGITS}x}')::BIGINT" for x in STEPS)} AS times FROM dr),
rep AS (SELECT b, sum(times * (two - one)) / sum(times)::DOUBLE AS delta FROM cnt JOIN w USING (set_id) WHERE times > 0 GROUP BY 1)"""


def outcomes(t: Tables) -> DataFrame:
    win = lambda a: (F.col(f"{a}_p") > F.greatest(f"{a}_1", f"{a}_2")).cast("int")
    return set_scores(t).select("set_id", win("raw").alias("one"), win("ctx").alias("two"))


@query("in1_paired_bootstrap", f"WITH {SETSCORE_SQL}, {DRAWS_SQL} SELECT (SELECT round(avg(two - one), 6) FROM w) AS observed, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(least(1.0::DOUBLE, 2 * (least(count(*) FILTER (delta <= 0), count(*) FILTER (delta >= 0)) + 1) / (count(*) + 1)::DOUBLE), 6) AS two_sided_p, quantile_cont(delta, 0.025) > 0 AS supported FROM rep")
def bootstrap(t: Tables) -> DataFrame:
    o = paired_bootstrap(outcomes(t), "set_id", "one", "two", B)
    return o.select(*[R(c, 6).alias(c) for c in ("observed", "mean_delta", "median_delta", "low", "high", "two_sided_p")], "supported")


@query("in2_cluster_draws", f"WITH {SETSCORE_SQL}, {DRAWS_SQL} SELECT b, sum(times)::BIGINT AS draws, count(*) AS sets, round(sum(times * one) / sum(times)::DOUBLE, 6) AS one, round(sum(times * two) / sum(times)::DOUBLE, 6) AS two FROM cnt JOIN w USING (set_id) WHERE times > 0 GROUP BY 1")
def cluster_draws(t: Tables) -> DataFrame:
    mean = lambda c: R(F.sum(F.col("times") * F.col(c)) / F.sum("times"), 6).alias(c)
    return draw_counts(outcomes(t), "set_id", B, 7).groupBy(F.col("b").cast("long").alias("b")).agg(F.sum("times").alias("draws"), F.count("*").alias("sets"), mean("one"), mean("two"))


@query("in2_replicate_medians", f"WITH {SETSCORE_SQL}, {DRAWS_SQL}, m AS (SELECT set_id, ctx_p - greatest(ctx_1, ctx_2) AS margin FROM setscore) SELECT b::BIGINT AS b, count(*) AS n, round(median(margin), 6) AS median FROM (SELECT b, margin, unnest(range(times)) FROM cnt JOIN m USING (set_id) WHERE times > 0) GROUP BY 1")
def medians(t: Tables) -> DataFrame:
    """The median margin of the sets in each of 10,000 replicates."""
    margins = set_scores(t).select("set_id", (F.col("ctx_p") - F.greatest("ctx_1", "ctx_2")).alias("margin"))
    return replicate_medians(margins, "set_id", "margin", B, 7).select(F.col("b").cast("long").alias("b"), F.col("n").cast("long").alias("n"), rounded_as_sql(F.col("median")).alias("median"))


@query("in3_expansion_audit", f"WITH {SETSCORE_SQL}, {DRAWS_SQL}, e AS (SELECT b, avg(two) AS c FROM (SELECT b, two, unnest(range(times)) FROM cnt JOIN w USING (set_id)) GROUP BY 1), a AS (SELECT b, sum(times * two) / sum(times)::DOUBLE AS a FROM cnt JOIN w USING (set_id) GROUP BY 1) SELECT count(*) FILTER (abs(a - c) > 1e-12) AS mismatches, count(*) AS replicates, round(avg(c), 6) AS mean FROM e JOIN a USING (b)")
def expansion_audit(t: Tables) -> DataFrame:
    """Weighted means against means over rows written out as often as drawn."""
    j = draw_counts(outcomes(t).select("set_id", "two"), "set_id", B, 7)
    weighted = j.groupBy("b").agg((F.sum(F.col("times") * F.col("two")) / F.sum("times")).alias("a"))
    written = j.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).groupBy("b").agg(F.avg("two").alias("c"))
    return weighted.join(written, "b").agg(F.count_if(F.abs(F.col("a") - F.col("c")) > 1e-12).alias("mismatches"), F.count("*").alias("replicates"), R(F.avg("c"), 6).alias("mean"))


SMD_SQL = "(avg({c}) FILTER (y = 1) - avg({c}) FILTER (y = 0)) / sqrt((var_samp({c}) FILTER (y = 1) + var_samp({c}) FILTER (y = 0)) / 2)"


@query("in4_smd_before_after", f"WITH {MEMBERS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round((SELECT {SMD_SQL.format(c=c)} FROM units), 6) AS before, round((SELECT {SMD_SQL.format(c=c)} FROM scores), 6) AS after" for c in FEATURES))
def smd_before_after(t: Tables) -> DataFrame:
    before = S.smd(units(t), FEATURES, "y").select("feature", R("smd", 6).alias("before"))
    return before.join(S.smd(scores(t), FEATURES, "y").select("feature", R("smd", 6).alias("after")), "feature")


@query("in5_fold_balance", f"WITH {UNITS_SQL}, l AS (UNPIVOT (SELECT unit_id % 5 AS fold, {', '.join(FEATURES)} FROM units) ON {', '.join(FEATURES)} INTO NAME feature VALUE x) SELECT fold, feature, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(skewness(x), 4) AS skew, round(quantile_cont(x, 0.5), 4) AS med, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS n_distinct FROM l GROUP BY ALL")
def fold_balance(t: Tables) -> DataFrame:
    long = units(t).select((F.col("unit_id") % 5).alias("fold"), *FEATURES).unpivot(["fold"], list(FEATURES), "feature", "x")
    return long.groupBy("fold", "feature").agg(R(F.avg("x"), 4).alias("mean"), R(F.stddev_samp("x"), 4).alias("sd"), R(S.unbiased_skewness("x"), 4).alias("skew"), R(F.median("x"), 4).alias("med"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("n_distinct"))


SHARE_SQL = "s AS (SELECT priority AS k, count(*) FILTER (y = 1) / sum(count(*) FILTER (y = 1)) OVER ()::DOUBLE AS p, count(*) FILTER (y = 0) / sum(count(*) FILTER (y = 0)) OVER ()::DOUBLE AS q FROM units GROUP BY 1)"


def shares(t: Tables) -> DataFrame:
    n = units(t).groupBy(F.col("priority").alias("k")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    return n.join(F.broadcast(n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))).select("k", (F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))


@query("in6_total_variation", f"WITH {UNITS_SQL}, {SHARE_SQL} SELECT round(sum(abs(p - q)) / 2, 6) AS tv, round(max(abs(p - q)), 6) AS max_diff FROM s")
def total_variation(t: Tables) -> DataFrame:
    d = F.abs(F.col("p") - F.col("q"))
    return shares(t).agg(R(F.sum(d) / 2, 6).alias("tv"), R(F.max(d), 6).alias("max_diff"))


PERIOD_SQL = "e AS (SELECT o_totalprice AS x, (o_orderdate < TIMESTAMP '1995-07-01')::INTEGER AS arm FROM orders)"


def period(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_totalprice").alias("x"), F.expr("o_orderdate < timestamp_ntz'1995-07-01'").cast("int").alias("arm"))


@query(
    "in7_psi",
    f"""WITH {PERIOD_SQL}, ed AS (SELECT list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM e WHERE arm = 1),
b AS (SELECT arm, len(list_filter(e[2:len(e) - 1], lambda v: v < x)) AS bin FROM e, ed), c AS (SELECT bin, count(*) FILTER (arm = 1) AS a, count(*) FILTER (arm = 0) AS b FROM b GROUP BY 1),
s AS (SELECT greatest(1e-6, a / sum(a) OVER ()) AS p, greatest(1e-6, b / sum(b) OVER ()) AS q FROM c), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM s)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM n""",
)
def psi(t: Tables) -> DataFrame:
    return S.psi(period(t), "x", "arm").select(R("psi", 6).alias("psi"))


CDF_SQL = "c AS (SELECT x, sum(arm) AS a, sum(1 - arm) AS b FROM e GROUP BY 1), d AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER ()::DOUBLE AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER ()::DOUBLE AS g, lead(x) OVER (ORDER BY x) - x AS gap FROM c)"


@query("in8_wasserstein", f"WITH {PERIOD_SQL}, {CDF_SQL} SELECT round(sum(abs(f - g) * coalesce(gap, 0)), 4) AS w1 FROM d")
def wasserstein(t: Tables) -> DataFrame:
    return S.wasserstein(S.cumulative_shares(period(t), "x", "arm")).select(R("w1", 4).alias("w1"))


@query("in9_ks", f"WITH {PERIOD_SQL}, {CDF_SQL} SELECT round(max(abs(f - g)), 6) AS ks FROM d")
def ks(t: Tables) -> DataFrame:
    return S.ks(S.cumulative_shares(period(t), "x", "arm")).select(R("ks", 6).alias("ks"))


@query("in10_agreement", "WITH v AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM v) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(avg((sign(a - 25) = sign(b - 1400))::INTEGER), 6) AS sign_agreement, round(avg(abs(a - b)), 4) AS mae, round(sqrt(avg((a - b) ** 2)), 4) AS rmse FROM r")
def agreement(t: Tables) -> DataFrame:
    v = t.part.select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    r = S.average_ranks(S.average_ranks(v, "a", "ra"), "b", "rb")
    a, b = F.col("a"), F.col("b")
    same = (F.signum(a - 25) == F.signum(b - 1400)).cast("int")
    return r.agg(R(F.corr("a", "b"), 6).alias("pearson"), R(F.corr("ra", "rb"), 6).alias("spearman"), R(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 6).alias("cosine"), R(F.avg(same), 6).alias("sign_agreement"), R(F.avg(F.abs(a - b)), 4).alias("mae"), R(F.sqrt(F.avg((a - b) ** 2)), 4).alias("rmse"))


@query("in11_category_shift", f"WITH {UNITS_SQL}, {SHARE_SQL} SELECT k, round(p, 6) AS p, round(q, 6) AS q, round(p - q, 6) AS diff FROM s")
def category_shift(t: Tables) -> DataFrame:
    return shares(t).select("k", R("p", 6).alias("p"), R("q", 6).alias("q"), R(F.col("p") - F.col("q"), 6).alias("diff"))


@query("in12_context_geometry", f"WITH {LONG_SQL} SELECT feature::INTEGER AS feature, round(avg(abs(signed)), 5) AS mean_dev, round(max(abs(signed)), 5) AS max_dev FROM dev GROUP BY 1")
def context_geometry(t: Tables) -> DataFrame:
    return deviations(long_features(t)).groupBy("feature").agg(R(F.avg("absdev"), 5).alias("mean_dev"), R(F.max("absdev"), 5).alias("max_dev"))


@query("in13_signal_contrast", f"WITH {MEMBERS_SQL}, c AS (SELECT set_id, max(price) FILTER (slot = 0) - avg(price) FILTER (slot > 0) AS d, max(region) FILTER (slot = 0) AS region FROM scores GROUP BY 1) SELECT region, round(median(d), 4) AS med, count(*) FILTER (d > 0) AS up FROM c GROUP BY 1")
def signal_contrast(t: Tables) -> DataFrame:
    at = lambda c, cond, f: f(F.when(cond, F.col(c)))
    case, ctl = F.col("slot") == 0, F.col("slot") > 0
    c = scores(t).groupBy("set_id").agg((at("price", case, F.max) - at("price", ctl, F.avg)).alias("d"), at("region", case, F.max).alias("region"))
    return c.groupBy("region").agg(R(F.median("d"), 4).alias("med"), F.count_if(F.col("d") > 0).alias("up"))


@query("in15_shift_decomposition", "WITH e AS (SELECT o_totalprice AS x, (o_orderdate < TIMESTAMP '1995-07-01')::INTEGER AS arm FROM orders), c AS (SELECT x, sum(arm) AS a, sum(1 - arm) AS b FROM e GROUP BY 1), d AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER ()::DOUBLE AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER ()::DOUBLE AS g, lead(x) OVER (ORDER BY x) - x AS gap FROM c), e2 AS (SELECT CASE WHEN arm = 1 THEN x ELSE x + 1000 END AS x, arm FROM e), c2 AS (SELECT x, sum(arm) AS a, sum(1 - arm) AS b FROM e2 GROUP BY 1), d2 AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER ()::DOUBLE AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER ()::DOUBLE AS g, lead(x) OVER (ORDER BY x) - x AS gap FROM c2) SELECT round((SELECT sum(abs(f - g) * coalesce(gap, 0)) FROM d2), 4) AS original, round((SELECT sum(abs(f - g) * coalesce(gap, 0)) FROM d), 4) AS residual")
def shift_decomposition(t: Tables) -> DataFrame:
    p = period(t)
    moved = p.select(F.when(F.col("arm") == 1, F.col("x")).otherwise(F.col("x") + 1000).alias("x"), "arm")
    w = lambda df, n: S.wasserstein(S.cumulative_shares(df, "x", "arm")).select(R("w1", 4).alias(n))
    return w(moved, "original").join(F.broadcast(w(p, "residual")))


@query("in16_arm_gates", f"WITH {SETSCORE_SQL}, {DRAWS_SQL}, f AS (SELECT set_id // 20 % 5 AS fold, avg(one) AS a, avg(two) AS b FROM w GROUP BY 1) SELECT (SELECT count(*) FROM f WHERE b > a) >= 4 AND (SELECT quantile_cont(delta, 0.025) FROM rep) > 0 AS passes, (SELECT count(*) FROM f WHERE b > a) AS wins")
def arm_gates(t: Tables) -> DataFrame:
    o = outcomes(t)
    f = o.groupBy((F.floor(F.col("set_id") / 20) % 5).alias("fold")).agg(F.avg("one").alias("a"), F.avg("two").alias("b"))
    wins = f.agg(F.count_if(F.col("b") > F.col("a")).alias("wins"))
    return wins.join(F.broadcast(paired_bootstrap(o, "set_id", "one", "two", B))).select(((F.col("wins") >= 4) & F.col("supported")).alias("passes"), "wins")
