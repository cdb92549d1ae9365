"""Aggregations (AG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import contingency, unbiased_skewness
from ..registry import Tables, query
from .cohort import CALIPERS, EDGES_SQL, FEATURES, MEMBERS_SQL, SETS_SQL, UNITS_SQL, edges, scores, sets, units

R = F.round


@query("ag1_degree_zero_fill", f"WITH {EDGES_SQL} SELECT u.unit_id, count(c_unit_id) AS degree FROM units u LEFT JOIN edges ON p_unit_id = unit_id WHERE y = 1 GROUP BY 1")
def degree_zero_fill(t: Tables) -> DataFrame:
    n = edges(t).groupBy(F.col("p_unit_id").alias("unit_id")).agg(F.count("*").alias("n"))
    return units(t).where("y = 1").select("unit_id").join(n, "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("degree"))


@query("ag2_multi_aggregate", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS med, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(sum(c_acctbal), 4) AS total, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def multi_aggregate(t: Tables) -> DataFrame:
    c = "c_acctbal"
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), R(F.avg(c), 6).alias("mean"), R(F.median(c), 6).alias("med"), F.min(c).alias("lo"), F.max(c).alias("hi"), R(F.sum(c), 4).alias("total"), F.count_distinct("c_nationkey").alias("nations"))


@query("ag3_quantiles", "SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) AS {n}" for n, p in (("p10", 0.1), ("q25", 0.25), ("med", 0.5), ("q75", 0.75), ("p90", 0.9), ("p95", 0.95))) + ", round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr FROM orders GROUP BY 1")
def quantiles(t: Tables) -> DataFrame:
    from ..operators.statistics import grouped_quantiles

    names = ["p10", "q25", "med", "q75", "p90", "p95"]
    q = grouped_quantiles(t.orders, ["o_orderstatus"], "o_totalprice", (0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    return q.select("o_orderstatus", *[R(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)], R(F.col("q")[3] - F.col("q")[1], 6).alias("iqr"))


@query("ag3_exact_quantiles_at_scale", "SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem")
def quantiles_at_scale(t: Tables) -> DataFrame:
    from ..operators.statistics import exact_quantiles

    return exact_quantiles(t.lineitem, "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select(*[R(q, 6).alias(q) for q in ("q25", "q50", "q75")])


@query("ag4_conditional_shares", f"WITH {MEMBERS_SQL} SELECT region, count(*) FILTER (raw > 0) AS n_up, round(avg((raw > 0)::INTEGER), 6) AS share_up, round(avg((ctx > raw)::INTEGER), 6) AS share_gain FROM scores GROUP BY 1")
def conditional_shares(t: Tables) -> DataFrame:
    up, gain = F.col("raw") > 0, F.col("ctx") > F.col("raw")
    return scores(t).groupBy("region").agg(F.count_if(up).alias("n_up"), R(F.avg(up.cast("int")), 6).alias("share_up"), R(F.avg(gain.cast("int")), 6).alias("share_gain"))


@query("ag5_distinct_list", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def distinct_list(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"))


@query("ag6_value_counts", "SELECT coalesce(k, '<NA>') AS v, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS k FROM orders) GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    v = F.coalesce(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")), F.lit("<NA>"))
    n = t.orders.groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("v", "n", R(F.col("n") / F.col("all"), 6).alias("share"))


CONTINGENCY_SQL = """c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
e AS (SELECT c.*, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER ()::DOUBLE AS e, sum(n) OVER () AS total FROM c)"""


@query("ag7_cramers_v", f"WITH {CONTINGENCY_SQL} SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, round(sqrt(sum((n - e) ** 2 / e) / max(total) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM e")
def cramers_v(t: Tables) -> DataFrame:
    return contingency(t.orders, "o_orderstatus", "o_orderpriority").select(R("chi2", 6).alias("chi2"), R("cramers_v", 6).alias("v"))


@query("ag8_category_matrix", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def category_matrix(t: Tables) -> DataFrame:
    p = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return p.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("ag9_pivot_time", "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (day(ts) = {d}), 0), 4) AS d{d}" for d in (1, 2, 3)) + " FROM events WHERE day(ts) IN (1, 2, 3) GROUP BY 1")
def pivot_time(t: Tables) -> DataFrame:
    p = t.events.withColumn("d", F.dayofmonth("ts")).where("d in (1, 2, 3)").groupBy("user_id").pivot("d", [1, 2, 3])
    return p.agg(F.sum("value")).select("user_id", *[R(F.coalesce(F.col(str(d)), F.lit(0.0)), 4).alias(f"d{d}") for d in (1, 2, 3)])


FUNNEL = [("block", "true")] + [(c, f"abs(p_{c} - c_{c}) <= {CALIPERS[c]}") for c in FEATURES]
FUNNEL_SQL = ", ".join(f"count(*) FILTER ({' AND '.join(x for _, x in FUNNEL[: i + 1])}) AS left_{n}, count(DISTINCT p_unit_id) FILTER ({' AND '.join(x for _, x in FUNNEL[: i + 1])}) AS cases_{n}" for i, (n, _) in enumerate(FUNNEL))


@query("ag10_funnel", f"WITH {UNITS_SQL}, b AS (SELECT p.unit_id AS p_unit_id, {', '.join(f'p.{c} AS p_{c}, c.{c} AS c_{c}' for c in FEATURES)} FROM units p JOIN units c ON p.segment = c.segment AND p.status = c.status AND p.nation = c.nation AND p.y = 1 AND c.y = 0) SELECT {FUNNEL_SQL} FROM b")
def funnel(t: Tables) -> DataFrame:
    """Counts after each stage in one pass; per case first, so that cases are counted without a distinct."""
    from ..operators.edges import caliper_join

    u = units(t).select("unit_id", "segment", "status", "nation", "y", *FEATURES)
    pairs = caliper_join(u.where("y = 1"), u.where("y = 0"), ("segment", "status", "nation"), {})
    passed = {n: F.expr(" and ".join(x for _, x in FUNNEL[: i + 1])) for i, (n, _) in enumerate(FUNNEL)}
    per_case = pairs.groupBy("p_unit_id").agg(*[F.count_if(c).alias(n) for n, c in passed.items()])
    return per_case.agg(*[x for n in passed for x in (F.sum(n).alias(f"left_{n}"), F.count_if(F.col(n) > 0).alias(f"cases_{n}"))])


@query("ag11_skewness", "SELECT o_orderstatus, round(skewness(o_totalprice), 6) AS skew FROM orders GROUP BY 1")
def skewness(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(R(unbiased_skewness("o_totalprice"), 6).alias("skew"))


@query("ag12_top_group", "WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) * abs(avg(c_acctbal) - 4500) AS w FROM customer GROUP BY ALL) SELECT c_mktsegment, arg_max(c_nationkey, w) AS nation FROM g GROUP BY 1")
def top_group(t: Tables) -> DataFrame:
    g = t.customer.groupBy("c_mktsegment", "c_nationkey").agg((F.count("*") * F.abs(F.avg("c_acctbal") - 4500)).alias("w"))
    return g.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", "w").alias("nation"))


@query("ag13_structure_audit", f"WITH {SETS_SQL}, a AS (SELECT set_id, count(*) AS n, count(DISTINCT unit_id) AS d, sum((slot = 0)::INTEGER) AS p, max(slot) AS m FROM sets GROUP BY 1) SELECT count(*) AS n_sets, count(*) FILTER (n <> 3 OR d <> 3 OR p <> 1 OR m <> 2) AS bad, (SELECT count(*) FROM (SELECT unit_id FROM sets WHERE slot > 0 GROUP BY 1 HAVING count(*) > 1)) AS reused FROM a")
def structure_audit(t: Tables) -> DataFrame:
    s = sets(t)
    a = s.groupBy("set_id").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("d"), F.count_if(F.col("slot") == 0).alias("p"), F.max("slot").alias("m"))
    reused = s.where("slot > 0").groupBy("unit_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("reused"))
    return a.agg(F.count("*").alias("n_sets"), F.count_if(F.expr("n <> 3 or d <> 3 or p <> 1 or m <> 2")).alias("bad")).join(F.broadcast(reused))


@query("ag14_fold_leakage", f"WITH {SETS_SQL} SELECT count(*) FILTER (f > 1) AS units_crossing, count(*) AS n_units FROM (SELECT unit_id, count(DISTINCT set_id // 20 % 5) AS f FROM sets GROUP BY 1)")
def fold_leakage(t: Tables) -> DataFrame:
    f = sets(t).groupBy("unit_id").agg(F.count_distinct(F.floor(F.col("set_id") / 20) % 5).alias("f"))
    return f.agg(F.count_if(F.col("f") > 1).alias("units_crossing"), F.count("*").alias("n_units"))


@query("ag15_seed_summary", f"WITH {MEMBERS_SQL}, m AS (SELECT set_id % 7 AS seed, region, avg(raw) AS v FROM scores GROUP BY ALL) SELECT region, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS seeds FROM m GROUP BY 1")
def seed_summary(t: Tables) -> DataFrame:
    m = scores(t).groupBy((F.col("set_id") % 7).alias("seed"), "region").agg(F.avg("raw").alias("v"))
    return m.groupBy("region").agg(R(F.avg("v"), 6).alias("mean"), R(F.stddev_samp("v"), 6).alias("sd"), F.count("*").alias("seeds"))


@query("ag16_distinct_units", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def distinct_units(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))


@query("ag17_replay_difference", "SELECT count(*) AS n, round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs, count(*) FILTER (a <> b) AS n_diff FROM (SELECT o_totalprice AS a, round(o_totalprice) AS b FROM orders)")
def replay_difference(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.col("o_totalprice").alias("a"))
    b = t.orders.select("o_orderkey", F.round("o_totalprice").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return a.join(b, "o_orderkey").agg(F.count("*").alias("n"), R(F.max(d), 6).alias("max_abs"), R(F.avg(d), 6).alias("mean_abs"), F.count_if(d > 0).alias("n_diff"))
