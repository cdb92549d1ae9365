"""Windows, ranks, sorts and set operations (WN, ST, SO)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import temporal as T
from ..operators.statistics import average_ranks
from ..registry import Tables, query
from .cohort import SETS_SQL, SETSCORE_SQL, UNITS_SQL, ranked, set_scores, sets, units

R = F.round
# Rain stands in: value of events per user and half-hour slot, on a grid without gaps from the first slot to the last.
GRID_SQL = """
grid AS (SELECT u.user_id, s.slot FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, min(ts)), time_bucket(INTERVAL 30 MINUTE, max(ts)), INTERVAL 30 MINUTE)) AS slot FROM events) s),
rain AS (SELECT g.user_id, g.slot, coalesce(v, 0.0) AS v FROM grid g LEFT JOIN (SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, sum(value) AS v FROM events GROUP BY ALL) e ON e.user_id = g.user_id AND e.slot = g.slot)"""


def rain(t: Tables, last: int | None = None) -> DataFrame:
    """Every user's grid, or its `last` slots."""
    ends = T.last_span(t.events, "ts", last) if last else T.span(t.events, "ts")
    return T.densify(T.slotted(t.events, "user_id", "ts", "value"), "user_id", *ends)


@query("wn2_top_k", f"WITH {SETS_SQL} SELECT k, count(*) AS n_edges, count(DISTINCT p_unit_id) AS n_cases, count(DISTINCT c_unit_id) AS n_controls FROM ranked, (SELECT unnest([1, 2, 5, 25]) AS k) WHERE r <= k GROUP BY 1")
def top_k(t: Tables) -> DataFrame:
    k = F.explode(F.array(*map(F.lit, (1, 2, 5, 25))))
    return ranked(t).where("r <= 25").select("*", k.alias("k")).where("r <= k").groupBy("k").agg(F.count("*").alias("n_edges"), F.count_distinct("p_unit_id").alias("n_cases"), F.count_distinct("c_unit_id").alias("n_controls"))


@query("wn3_first_rank", "SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) AS r FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def first_rank(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))  # a row per nation
    return n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "c_nationkey")).cast("long"))


@query("wn4_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r FROM part")
def average_rank(t: Tables) -> DataFrame:
    return average_ranks(t.part.select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


HOURS = (1, 3, 6, 12, 24, 48, 72, 120)


@query("wn5_rolling_sums", f"WITH {GRID_SQL} SELECT user_id, slot::VARCHAR AS slot, " + ", ".join(f"round(sum(v) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW), 4) AS h{h}" for h in HOURS) + " FROM rain")
def rolling_sums(t: Tables) -> DataFrame:
    return T.rolling_sums(rain(t), "user_id", "slot", "v", HOURS).select("user_id", F.col("slot").cast("string").alias("slot"), *[R(f"h{h}", 4).alias(f"h{h}") for h in HOURS])


@query("wn6_decayed_index", f"WITH {GRID_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS i FROM rain) SELECT a.user_id, a.slot::VARCHAR AS slot, round(sum(pow(0.9, a.i - b.i) * b.v), 4) AS api FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 239 AND a.i GROUP BY ALL")
def decayed_index(t: Tables) -> DataFrame:
    return T.decayed_sum(rain(t), "user_id", "slot", "v", 0.9, 240).select("user_id", F.col("slot").cast("string").alias("slot"), R("decayed", 4).alias("api"))


@query("wn7_missing_slots", f"WITH {GRID_SQL} SELECT g.user_id, count(*) AS missing FROM grid g LEFT JOIN (SELECT DISTINCT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot FROM events) e ON g.user_id = e.user_id AND g.slot = e.slot WHERE e.slot IS NULL GROUP BY 1")
def missing_slots(t: Tables) -> DataFrame:
    slots = T.slotted(t.events, "user_id", "ts", "value")
    return T.missing_slots(slots, "user_id", *T.span(t.events, "ts")).groupBy("user_id").agg(F.count("*").alias("missing"))


@query("wn8_interval_end", "SELECT event_id, (time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE)::VARCHAR AS slot_end FROM events")
def interval_end(t: Tables) -> DataFrame:
    return t.events.select("event_id", (T.slot_of("ts") + F.expr("INTERVAL 30 MINUTES")).cast("string").alias("slot_end"))


@query("wn9_window_slice", f"WITH {GRID_SQL} SELECT user_id, slot::VARCHAR AS slot, (70 - row_number() OVER (PARTITION BY user_id ORDER BY slot DESC))::INTEGER AS i, (-30 * (row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) - 1))::INTEGER AS minutes FROM rain WHERE slot <= TIMESTAMP '2024-01-28 12:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) <= 70")
def window_slice(t: Tables) -> DataFrame:
    return T.last_slots(rain(t), "user_id", "slot", "2024-01-28 12:00:00", 70).select("user_id", F.col("slot").cast("string").alias("slot"), F.col("index_in_window").alias("i"), "minutes")


@query("wn10_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first(t: Tables) -> DataFrame:
    """The first by order, as an aggregate: it is combined before the shuffle, where a window would move all rows."""
    return t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("o_custkey", "f.o_orderkey")


@query("wn11_cumulative_cutoff", f"WITH {UNITS_SQL}, g AS (SELECT nation, count(*) AS n, avg(bal) AS x FROM units GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY x DESC, nation) AS upto, sum(n) OVER () AS total FROM g) SELECT nation, upto::BIGINT AS upto FROM c ORDER BY abs(upto - 0.2 * total), nation LIMIT 1")
def cumulative_cutoff(t: Tables) -> DataFrame:
    g = units(t).groupBy("nation").agg(F.count("*").alias("n"), F.avg("bal").alias("x"))  # a row per nation
    c = g.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("x"), "nation"))).join(F.broadcast(g.agg(F.sum("n").alias("total"))))
    return c.agg(F.min(F.struct(F.abs(F.col("upto") - F.lit(0.2) * F.col("total")).alias("d"), "nation", "upto")).alias("b")).select("b.nation", "b.upto")


@query("wn12_step_regularity", "SELECT user_id, count(*) FILTER (ts > prev + INTERVAL 1 DAY) AS gaps, max(date_diff('second', prev, ts)) AS longest FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1")
def step_regularity(t: Tables) -> DataFrame:
    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    step = t.events.withColumn("prev", prev)
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.col("prev")).cast("timestamp"))
    return step.groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("prev") + F.expr("INTERVAL 1 DAY")).alias("gaps"), F.max(seconds).alias("longest"))


PROFILE_SQL = "p AS (SELECT event_type AS field, hour(ts) AS h, avg(value) FILTER (day(ts) <= 15) AS a, avg(value) FILTER (day(ts) > 15) AS b FROM events GROUP BY ALL)"


@query("wn13_profile_shift", f"WITH {PROFILE_SQL} SELECT field, round(avg(abs(a - b)), 5) AS mae, round(sqrt(avg((a - b) ** 2)), 5) AS rmse, round(max(abs(a - b)), 5) AS max_abs, round(corr(a, b), 5) AS r FROM p GROUP BY 1")
def profile_shift(t: Tables) -> DataFrame:
    early = F.dayofmonth("ts") <= 15
    p = t.events.groupBy(F.col("event_type").alias("field"), F.hour("ts").alias("h")).agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"))
    d = F.col("a") - F.col("b")
    return p.groupBy("field").agg(R(F.avg(F.abs(d)), 5).alias("mae"), R(F.sqrt(F.avg(d * d)), 5).alias("rmse"), R(F.max(F.abs(d)), 5).alias("max_abs"), R(F.corr("a", "b"), 5).alias("r"))


@query("st1_sorted", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sorted_rows(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("st2_top_records", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_records(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


CONFIG_SQL = f"{SETSCORE_SQL}, cfg AS (SELECT set_id % 9 AS config, round(avg((ctx_p > greatest(ctx_1, ctx_2))::INTEGER), 6) AS strict, round(avg(((ctx_p > ctx_1)::INTEGER + (ctx_p > ctx_2)::INTEGER) / 2.0), 6) AS edge FROM setscore GROUP BY 1)"


@query("st3_best_config", f"WITH {CONFIG_SQL} SELECT config, strict, edge FROM cfg ORDER BY (strict + edge) / 2 DESC, strict DESC, edge DESC, config LIMIT 1")
def best_config(t: Tables) -> DataFrame:
    one, two = (F.col("ctx_p") > F.col("ctx_1")).cast("int"), (F.col("ctx_p") > F.col("ctx_2")).cast("int")
    cfg = set_scores(t).groupBy((F.col("set_id") % 9).alias("config")).agg(R(F.avg(one * two), 6).alias("strict"), R(F.avg((one + two) / 2.0), 6).alias("edge"))
    best = F.max(F.struct(((F.col("strict") + F.col("edge")) / 2).alias("s"), "strict", "edge", (-F.col("config")).alias("c")))
    return cfg.agg(best.alias("b")).select((-F.col("b.c")).alias("config"), "b.strict", "b.edge")


@query("so1_union_all", "SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.lit("c").alias("src")).unionByName(t.supplier.select(F.lit("s").alias("src"), F.col("s_suppkey").alias("k")))


@query("so2_union_distinct", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("n")).union(t.supplier.select("s_nationkey")).distinct()


@query("so3_difference", "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def difference(t: Tables) -> DataFrame:
    k = F.col("o_custkey").alias("k")
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select(k)).intersect(t.orders.where("o_totalprice > 200000").select(k))


@query("so4_partition_check", f"WITH {UNITS_SQL} SELECT count(*) FILTER (n > 1)::BIGINT AS overlap, (SELECT count(*) FROM orders) - count(*) AS missing FROM (SELECT unit_id, count(*) AS n FROM units GROUP BY 1)")
def partition_check(t: Tables) -> DataFrame:
    u = units(t)
    parts = u.where("y = 1").select("unit_id").unionByName(u.where("y = 0").select("unit_id")).groupBy("unit_id").agg(F.count("*").alias("n"))
    both = t.orders.select(F.col("o_orderkey").alias("unit_id")).join(parts, "unit_id", "left")
    return both.agg(F.count_if(F.col("n") > 1).alias("overlap"), F.count_if(F.col("n").isNull()).alias("missing"))


@query("so5_unpivot_edges", f"WITH {SETSCORE_SQL} SELECT set_id, 1 AS control_rank, round(ctx_p - ctx_1, 6) AS gap FROM setscore UNION ALL SELECT set_id, 2, round(ctx_p - ctx_2, 6) FROM setscore")
def unpivot_edges(t: Tables) -> DataFrame:
    gaps = F.array(*[F.struct(F.lit(i).alias("control_rank"), R(F.col("ctx_p") - F.col(f"ctx_{i}"), 6).alias("gap")) for i in (1, 2)])
    return set_scores(t).select("set_id", F.explode(gaps).alias("g")).select("set_id", "g.*")


@query("so6_wide_sets", f"WITH {SETS_SQL} SELECT set_id, max(unit_id) FILTER (slot = 1) AS control_1, max(unit_id) FILTER (slot = 2) AS control_2, least(max(unit_id) FILTER (slot = 1), max(unit_id) FILTER (slot = 2)) AS control_low FROM sets GROUP BY 1")
def wide_sets(t: Tables) -> DataFrame:
    one, two = (F.max(F.when(F.col("slot") == i, F.col("unit_id"))) for i in (1, 2))
    return sets(t).groupBy("set_id").agg(one.alias("control_1"), two.alias("control_2"), F.least(one, two).alias("control_low"))
