"""The study on the driver's tables: units, edges, matched sets and scores, in Spark and as SQL to build on.

A unit is an order with its customer; every 20th order is a case. Blocks are market segment and order status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rounded
from ..operators.edges import caliper_join, distance, nearest_within, weighted
from ..operators.graph import ranged
from ..operators.scaling import robust_apply, robust_params
from ..registry import Tables, query

FEATURES = ("price", "bal", "day")
CALIPERS = {"price": 20000.0, "bal": 1500.0, "day": 200.0}
WEIGHTS = {"price": 0.5, "bal": 0.3, "day": 0.2}

UNITS_SQL = """
units AS (
  SELECT o_orderkey AS unit_id, o_totalprice AS price, c_acctbal AS bal, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day,
    c_mktsegment AS segment, o_orderstatus AS status, c_nationkey AS nation, n_regionkey AS region, o_orderpriority AS priority, o_custkey AS customer,
    (o_orderkey % 20 = 0)::INTEGER AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
Z_SQL = (
    UNITS_SQL
    + """,
par AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}" for c in FEATURES)
    + """ FROM units),
z AS (SELECT units.*, """
    + ", ".join(f"({c} - med_{c}) / iqr_{c} AS z_{c}" for c in FEATURES)
    + " FROM units, par)"
)
EDGES_SQL = (
    Z_SQL
    + f""",
edges AS (
  SELECT p.unit_id AS p_unit_id, c.unit_id AS c_unit_id, abs(p.z_price - c.z_price) AS d_price, abs(p.z_bal - c.z_bal) AS d_bal, abs(p.z_day - c.z_day) AS d_day,
    p.segment AS segment, p.status AS status, round(0.5::DOUBLE * abs(p.z_price - c.z_price) + 0.3::DOUBLE * abs(p.z_bal - c.z_bal) + 0.2::DOUBLE * abs(p.z_day - c.z_day), 9) AS dist
  FROM z p JOIN z c ON p.segment = c.segment AND p.status = c.status AND p.y = 1 AND c.y = 0
    AND {" AND ".join(f"abs(p.{k} - c.{k}) <= {v}" for k, v in CALIPERS.items())})"""
)
SETS_SQL = (
    EDGES_SQL
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_unit_id ORDER BY dist, c_unit_id) AS r FROM edges),
pairs AS (SELECT *, count(*) OVER (PARTITION BY p_unit_id) AS n FROM ranked WHERE r <= 2),
sets AS (
  SELECT p_unit_id AS set_id, r::INTEGER AS slot, c_unit_id AS unit_id FROM pairs WHERE n = 2
  UNION ALL SELECT DISTINCT p_unit_id, 0, p_unit_id FROM pairs WHERE n = 2)"""
)
MEMBERS_SQL = (
    SETS_SQL
    + """,
members AS (
  SELECT s.set_id, s.slot, z.*, z_price - avg(z_price) OVER w AS r_price, z_bal - avg(z_bal) OVER w AS r_bal, z_day - avg(z_day) OVER w AS r_day
  FROM sets s JOIN z ON s.unit_id = z.unit_id WINDOW w AS (PARTITION BY s.set_id)),
scores AS (
  SELECT set_id, slot, unit_id, (slot = 0)::INTEGER AS y, segment, status, nation, region, price, bal, day,
    round(0.6::DOUBLE * z_price + 0.3::DOUBLE * z_bal - 0.1::DOUBLE * z_day, 6) AS raw, round(0.6::DOUBLE * r_price - 0.3::DOUBLE * r_bal + 0.5::DOUBLE * abs(r_day), 6) AS ctx
  FROM members)"""
)
SETSCORE_SQL = (
    MEMBERS_SQL
    + """,
setscore AS (
  SELECT set_id, """
    + ", ".join(f"max(CASE WHEN slot = 0 THEN {a} END) AS {a}_p, max(CASE WHEN slot = 1 THEN {a} END) AS {a}_1, max(CASE WHEN slot = 2 THEN {a} END) AS {a}_2" for a in ("raw", "ctx"))
    + " FROM scores GROUP BY set_id)"
)


def units(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))  # one row per nation
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("bal"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_nationkey").alias("nation"),
        F.col("n_regionkey").alias("region"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("customer"),
        (F.col("o_orderkey") % 20 == 0).cast("int").alias("y"),
    )


def scaled(t: Tables) -> DataFrame:
    return t.once("scaled", lambda: robust_apply(t.once("units", lambda: units(t)), parameters(t), FEATURES))


def parameters(t: Tables) -> DataFrame:
    return t.once("parameters", lambda: robust_params(t.once("units", lambda: units(t)), FEATURES))


def two_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Cases and candidates with their scaled features."""
    z = scaled(t).select("unit_id", *FEATURES, *[f"z_{c}" for c in FEATURES], "segment", "status", "y")
    return z.where("y = 1").drop("y"), z.where("y = 0").drop("y")


def edges(t: Tables) -> DataFrame:
    cases, pool = two_sides(t)
    e = caliper_join(cases, pool, ("segment", "status"), CALIPERS, bands=FEATURES)
    e = e.withColumns({f"d_{c}": F.abs(F.col(f"p_z_{c}") - F.col(f"c_z_{c}")) for c in FEATURES})
    dist = F.round(weighted({c: (F.col(f"d_{c}"), w) for c, w in WEIGHTS.items()}), 9)
    return e.withColumn("dist", dist).select("p_unit_id", "c_unit_id", *[f"d_{c}" for c in FEATURES], F.col("p_segment").alias("segment"), F.col("p_status").alias("status"), "dist")


def by_rule(t: Tables, pairs: DataFrame) -> DataFrame:
    """Those of pairs (p_unit_id, c_unit_id) that are edges, with dist, each looked at by the rule of edges."""
    cases, pool = (side.select(*[F.col(c).alias(f"{k}_{c}") for c in side.columns]) for side, k in zip(two_sides(t), "pc", strict=True))
    e = pairs.join(cases, "p_unit_id").join(pool, "c_unit_id").where("p_segment = c_segment and p_status = c_status")
    for c, width in CALIPERS.items():
        e = e.where(F.abs(F.col(f"p_{c}") - F.col(f"c_{c}")) <= width)
    return e.select("p_unit_id", "c_unit_id", distance(WEIGHTS).alias("dist"))


def ranked(t: Tables) -> DataFrame:
    by = Window.partitionBy("p_unit_id").orderBy("dist", "c_unit_id")
    return edges(t).withColumn("r", F.row_number().over(by))


def nearest_edges(t: Tables, cases: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(p_unit_id, r, c_unit_id, dist) of each case's k nearest candidates of the pool."""
    row = parameters(t).first()
    iqr = {c: row[f"iqr_{c}"] for c in FEATURES}
    if all(iqr.values()):
        return nearest_within(cases, pool, "unit_id", ("segment", "status"), CALIPERS, WEIGHTS, iqr, k)
    e = caliper_join(cases, pool, ("segment", "status"), CALIPERS, bands=FEATURES).withColumn("dist", distance(WEIGHTS))  # no scale: no distance
    by = Window.partitionBy("p_unit_id").orderBy("dist", "c_unit_id")
    return e.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("p_unit_id", "r", "c_unit_id", "dist")


def nearest(t: Tables, k: int = 2) -> DataFrame:
    """(p_unit_id, r, c_unit_id) of each case's k nearest candidates."""
    return t.once(f"nearest{k}", lambda: nearest_edges(t, *two_sides(t), k).select("p_unit_id", "r", "c_unit_id"))


def sets(t: Tables) -> DataFrame:
    """(set_id, slot, unit_id): each case with its two nearest candidates, which may serve several cases."""
    pairs = nearest(t).withColumn("n", F.count("*").over(Window.partitionBy("p_unit_id"))).where("n = 2")
    slots = F.array(F.struct(F.col("r").alias("slot"), F.col("c_unit_id").alias("unit_id")), F.struct(F.lit(0).alias("slot"), F.col("p_unit_id").alias("unit_id")))
    both = pairs.select("r", F.col("p_unit_id").alias("set_id"), F.explode(slots).alias("s")).where("s.slot > 0 or r = 1")
    return both.select("set_id", F.col("s.slot").alias("slot"), F.col("s.unit_id").alias("unit_id"))


def members(t: Tables) -> DataFrame:
    """Set members with their scaled features and the deviations r_x from the set's mean; no role is looked at."""
    own = Window.partitionBy("set_id")
    m = sets(t).join(scaled(t), "unit_id")
    return m.withColumns({f"r_{c}": F.col(f"z_{c}") - F.avg(f"z_{c}").over(own) for c in FEATURES})


def scores(t: Tables) -> DataFrame:
    raw = F.round(F.lit(0.6) * F.col("z_price") + F.lit(0.3) * F.col("z_bal") - F.lit(0.1) * F.col("z_day"), 6)
    ctx = F.round(F.lit(0.6) * F.col("r_price") - F.lit(0.3) * F.col("r_bal") + F.lit(0.5) * F.abs("r_day"), 6)
    keep = ("segment", "status", "nation", "region", "price", "bal", "day")
    return members(t).select("set_id", "slot", "unit_id", (F.col("slot") == 0).cast("int").alias("y"), *keep, raw.alias("raw"), ctx.alias("ctx"))


def set_scores(t: Tables) -> DataFrame:
    """One row per set: raw_p, raw_1, raw_2 and the same for ctx."""
    slot = {0: "p", 1: "1", 2: "2"}
    return scores(t).groupBy("set_id").agg(*[F.max(F.when(F.col("slot") == i, F.col(a))).alias(f"{a}_{s}") for a in ("raw", "ctx") for i, s in slot.items()])


@query(
    "flagship_matched_sets",
    f"""WITH {SETSCORE_SQL}
SELECT count(*) AS n_sets, round(avg((raw_p > greatest(raw_1, raw_2))::INTEGER), 6) AS raw_strict, round(avg(((raw_p > raw_1)::INTEGER + (raw_p > raw_2)::INTEGER) / 2.0), 6) AS raw_edge,
  round(avg((ctx_p > greatest(ctx_1, ctx_2))::INTEGER), 6) AS ctx_strict, round(avg(((ctx_p > ctx_1)::INTEGER + (ctx_p > ctx_2)::INTEGER) / 2.0), 6) AS ctx_edge FROM setscore""",
)
def flagship(t: Tables) -> DataFrame:
    def parts(a: str) -> list:
        one, two = (F.col(f"{a}_p") > F.col(f"{a}_1")).cast("int"), (F.col(f"{a}_p") > F.col(f"{a}_2")).cast("int")
        return [rounded(F.avg(one * two)).alias(f"{a}_strict"), rounded(F.avg((one + two) / 2.0)).alias(f"{a}_edge")]

    return set_scores(t).agg(F.count("*").alias("n_sets"), *parts("raw"), *parts("ctx"))


@query("mg1_robust_transform", f"WITH {Z_SQL} SELECT unit_id, round(z_price, 6) AS z_price, round(z_bal, 6) AS z_bal, round(z_day, 6) AS z_day FROM z")
def robust_transform(t: Tables) -> DataFrame:
    return scaled(t).select("unit_id", *[rounded(F.col(f"z_{c}")).alias(f"z_{c}") for c in FEATURES])


@query("j7_caliper_edges", f"WITH {EDGES_SQL} SELECT p_unit_id, c_unit_id, round(dist, 6) AS dist FROM edges")
def caliper_edges(t: Tables) -> DataFrame:
    return edges(t).select("p_unit_id", "c_unit_id", rounded(F.col("dist")).alias("dist"))


@query("wn1_rank_in_case", f"WITH {SETS_SQL} SELECT p_unit_id, c_unit_id, r::INTEGER AS r FROM ranked WHERE r <= 5")
def rank_in_case(t: Tables) -> DataFrame:
    return nearest(t, 5).select("p_unit_id", "c_unit_id", "r")


@query("mg21_control_ranks", f"WITH {SETS_SQL} SELECT printf('MATCH_%06d', dense_rank() OVER (ORDER BY set_id)) AS match_id, set_id, slot, unit_id FROM sets")
def control_ranks(t: Tables) -> DataFrame:
    s = sets(t)
    # Numbers need one global order of the sets; the table of ids alone is sorted, in ranges, and joined back.
    ids = s.select("set_id").distinct()
    dealt = ranged(ids, "set_id")
    own = F.row_number().over(Window.partitionBy("_p").orderBy("set_id"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    first = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_first"))
    numbered = dealt.withColumn("_i", own).join(F.broadcast(first), "_p").select("set_id", (F.col("_first") + F.col("_i")).alias("n"))
    return s.join(numbered, "set_id").select(F.format_string("MATCH_%06d", F.col("n")).alias("match_id"), "set_id", "slot", "unit_id")
