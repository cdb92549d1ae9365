"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edges import checked_join, grid_neighbours, within_radius
from ..registry import Tables, query
from .cohort import EDGES_SQL, MEMBERS_SQL, SETS_SQL, UNITS_SQL, edges, scaled, scores, sets, units


@query("j1_checked_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_inner(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return checked_join(o, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("j2_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def left(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(o, "c_custkey", "left")


VERSIONS_SQL = "a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS k, p_size + (p_partkey % 7 = 0)::INTEGER AS v FROM part WHERE p_partkey % 11 <> 0)"


@query("j3_compare_versions", f"WITH {VERSIONS_SQL} SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def compare_versions(t: Tables) -> DataFrame:
    a = t.part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("old"), F.lit(True).alias("in_a"))
    b = t.part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("new"), F.lit(True).alias("in_b"))
    side = F.when(F.col("in_a").isNull(), "right_only").when(F.col("in_b").isNull(), "left_only").otherwise("both")
    return a.join(b, "k", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("k", "old", "new", side.alias("side"))


@query("j4_ordered_lookup", "SELECT position, c_custkey, c_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS position, n_nationkey + 1 AS k FROM nation) JOIN customer ON k = c_custkey")
def ordered_lookup(t: Tables) -> DataFrame:
    ids = t.nation.agg(F.sort_array(F.collect_list(F.col("n_nationkey") + 1), False).alias("ids"))
    wanted = ids.select(F.posexplode("ids").alias("position", "k"))
    found = wanted.join(t.customer.select("c_custkey", "c_name"), F.col("k") == F.col("c_custkey"), "left")
    missing = F.assert_true(F.col("c_custkey").isNotNull(), F.concat(F.lit("no row for "), F.col("k").cast("string")))
    return found.where(missing.isNull()).select(F.col("position").cast("long").alias("position"), "c_custkey", "c_name")


@query("j5_map_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1) ON c_custkey = o_custkey")
def map_default(t: Tables) -> DataFrame:
    n = t.orders.where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j6_unused_candidates", f"WITH {SETS_SQL} SELECT p_unit_id, c_unit_id FROM edges WHERE c_unit_id NOT IN (SELECT unit_id FROM sets)")
def unused_candidates(t: Tables) -> DataFrame:
    used = sets(t).select(F.col("unit_id").alias("c_unit_id"))
    return edges(t).select("p_unit_id", "c_unit_id").join(used, "c_unit_id", "left_anti")


@query("j8_hierarchical_block", f"WITH {EDGES_SQL}, k AS (SELECT *, CASE WHEN segment IN ('AUTOMOBILE', 'MACHINERY') THEN 'HEAVY' ELSE segment END AS b FROM z) SELECT p.unit_id AS p_unit_id, c.unit_id AS c_unit_id FROM k p JOIN k c ON p.b = c.b AND p.nation = c.nation AND p.y = 1 AND c.y = 0 AND abs(p.price - c.price) <= 5000")
def hierarchical_block(t: Tables) -> DataFrame:
    from ..operators.edges import caliper_join

    b = F.when(F.col("segment").isin("AUTOMOBILE", "MACHINERY"), "HEAVY").otherwise(F.col("segment"))
    u = units(t).select("unit_id", "price", "nation", "y", b.alias("b"))
    return caliper_join(u.where("y = 1"), u.where("y = 0"), ("b", "nation"), {"price": 5000.0}, bands=("price",)).select("p_unit_id", "c_unit_id")


POINTS_SQL = "points AS (SELECT c_custkey AS k, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer)"


def points(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))


@query("j9_radius_join", f"WITH {POINTS_SQL} SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM points a JOIN points b ON a.k < b.k AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 300")
def radius_join(t: Tables) -> DataFrame:
    return within_radius(points(t), "k", "x", "y", 300.0).select("a", "b", F.round("dist", 6).alias("dist"))


@query("j10_nearest", f"WITH {POINTS_SQL} SELECT s.k AS site, arg_min(p.k, struct_pack(d := round(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), 6), k := p.k)) AS nearest, round(min(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)), 6) AS dist FROM points s JOIN points p ON s.k % 50 = 0 AND p.k % 50 <> 0 GROUP BY 1")
def nearest(t: Tables) -> DataFrame:
    """By rings of grid cells: cells within 1, then 2, 4, ... steps, until a site's best is nearer than the ring's edge."""
    from ..operators.spatial import nearest_join

    p = points(t)
    return nearest_join(p.where("k % 50 = 0").withColumnRenamed("k", "site"), p.where("k % 50 <> 0").withColumnRenamed("k", "nearest"), "site", "nearest", 500.0, 6).select("site", "nearest", F.round("dist", 6).alias("dist"))


@query("j11_grid_adjacency", "WITH g AS (SELECT p_partkey AS k, p_partkey * 31 % 97 AS r, p_partkey * 17 % 89 AS c FROM part) SELECT DISTINCT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k < b.k AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)")
def grid_adjacency(t: Tables) -> DataFrame:
    g = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 31 % 97).alias("r"), (F.col("p_partkey") * 17 % 89).alias("c"))
    return grid_neighbours(g, "k", "r", "c")


@query("j12_point_in_polygon", f"WITH {POINTS_SQL}, tri AS (SELECT n_nationkey AS p, n_nationkey * 400.0 AS x0, n_nationkey * 300.0 AS y0 FROM nation) SELECT k, p FROM points, tri WHERE x > x0 AND y > y0 AND (x - x0) + (y - y0) < 1500")
def point_in_polygon(t: Tables) -> DataFrame:
    from ..operators.spatial import points_in_polygons

    n = F.col("n_nationkey")
    x0, y0 = n * 400.0, n * 300.0
    ring = F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in ((0.0, 0.0), (1500.0, 0.0), (0.0, 1500.0))])
    return points_in_polygons(points(t), t.nation.select(n.alias("p"), ring.alias("ring")), 1000.0).select("k", "p")


@query("j13_rectangle_overlap", "WITH r AS (SELECT p_partkey AS k, p_retailprice AS x0, p_retailprice + 5 AS x1, (p_size * 10)::DOUBLE AS y0, (p_size * 10 + 8)::DOUBLE AS y1 FROM part) SELECT a.k AS a, b.k AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM r a JOIN r b ON a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def rectangle_overlap(t: Tables) -> DataFrame:
    from ..operators.spatial import rectangle_overlaps

    x, y = F.col("p_retailprice"), (F.col("p_size") * 10).cast("double")
    r = t.part.select(F.col("p_partkey").alias("k"), x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), (y + 8).alias("y1"))
    return rectangle_overlaps(r, "k", (2.0, 10.0)).select("a", "b", F.round("area", 6).alias("area"))


# Squares on their corners: in the turned axes x + y and x - y they are upright, which gives the SQL their overlaps.
@query("j13_polygon_overlap", "WITH r AS (SELECT p_partkey AS k, p_retailprice + p_size * 10 AS u, p_retailprice - p_size * 10 AS v, 4 + p_partkey % 3 AS h FROM part), o AS (SELECT a.k AS a, b.k AS b, a.h, least(a.u + a.h, b.u + b.h) - greatest(a.u - a.h, b.u - b.h) AS du, least(a.v + a.h, b.v + b.h) - greatest(a.v - a.h, b.v - b.h) AS dv FROM r a JOIN r b ON a.k < b.k AND a.u - b.u BETWEEN -14 AND 14 AND a.v - b.v BETWEEN -14 AND 14) SELECT a, b, round(du * dv / 2, 6) AS area, round(du * dv / (4.0::DOUBLE * h * h), 10) AS share FROM o WHERE du > 1e-9 AND dv > 1e-9")
def polygon_overlap(t: Tables) -> DataFrame:
    """Shares of quadrilaterals in one another, corners in either turn."""
    from ..operators.spatial import polygon_overlaps

    x, y, h = F.col("p_retailprice"), F.col("p_size") * 10, 4 + F.col("p_partkey") % 3
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(point(x + h, y), point(x, y + h), point(x - h, y), point(x, y - h))
    ring = F.when(F.col("p_partkey") % 2 == 0, ring).otherwise(F.reverse(ring))
    found = polygon_overlaps(t.part.select(F.col("p_partkey").alias("k"), ring.alias("ring")), "k", (2.0, 10.0))
    return found.select("a", "b", F.round("area", 6).alias("area"), F.round("share", 10).alias("share"))


@query("j14_align_predictions", f"WITH {MEMBERS_SQL} SELECT count(*) AS n, count(*) FILTER (set_id % 3 = 0) AS missing, 0::BIGINT AS label_conflicts FROM scores")
def align_predictions(t: Tables) -> DataFrame:
    s = scores(t)
    a = s.select("set_id", "slot", F.col("y").alias("ya"), F.col("raw").alias("a"))
    b = s.where("set_id % 3 <> 0").select("set_id", "slot", F.col("y").alias("yb"), F.col("ctx").alias("b"))
    both = a.join(b, ["set_id", "slot"], "full")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"), F.count_if(F.col("ya") != F.col("yb")).alias("label_conflicts"))


@query("j15_attach_geometry", f"WITH {UNITS_SQL} SELECT unit_id, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM units JOIN customer ON customer = c_custkey")
def attach_geometry(t: Tables) -> DataFrame:
    u = units(t).select("unit_id", F.col("customer").alias("k"))
    return checked_join(u, points(t), ["k"], "left").select("unit_id", "x", "y")


@query("j16_context_gather", f"WITH {MEMBERS_SQL} SELECT set_id, slot, unit_id, round(z_price, 6) AS z_price FROM members")
def context_gather(t: Tables) -> DataFrame:
    return sets(t).join(scaled(t).select("unit_id", "z_price"), "unit_id").select("set_id", "slot", "unit_id", F.round("z_price", 6).alias("z_price"))


@query(
    "j17_alien_context",
    f"""WITH {MEMBERS_SQL}, m AS (SELECT set_id, avg(z_price) AS mean_price FROM members GROUP BY 1),
o AS (SELECT set_id, row_number() OVER (ORDER BY md5(set_id::VARCHAR), set_id) AS i, count(*) OVER () AS n FROM m),
d AS (SELECT a.set_id, b.set_id AS other FROM o a JOIN o b ON b.i = a.i % a.n + 1)
SELECT x.set_id, slot, round(z_price - mean_price, 6) AS alien FROM members x JOIN d ON x.set_id = d.set_id JOIN m ON m.set_id = d.other""",
)
def alien_context(t: Tables) -> DataFrame:
    from ..operators.context import derangement
    from .cohort import members

    m = members(t)
    means = m.groupBy("set_id").agg(F.avg("z_price").alias("mean_price"))
    other = derangement(means.select("set_id"), "set_id")
    alien = other.join(means.withColumnRenamed("set_id", "other"), "other").select("set_id", "mean_price")
    return m.join(alien, "set_id").select("set_id", "slot", F.round(F.col("z_price") - F.col("mean_price"), 6).alias("alien"))
