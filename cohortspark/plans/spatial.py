"""Pixel tables (RP14, RP15) and cell statistics."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.terrain import AROUND, wetness
from ..registry import Tables, query

R = F.round
# A height for each cell of a 60-column raster, from the parts table.
PIXEL_SQL = "px AS (SELECT p_partkey // 60 AS r, p_partkey % 60 AS c, p_retailprice AS z FROM part)"


def pixels(t: Tables) -> DataFrame:
    return t.part.select(F.floor(F.col("p_partkey") / 60).alias("r"), (F.col("p_partkey") % 60).alias("c"), F.col("p_retailprice").alias("z"))


@query(
    "rp14_terrain",
    f"""WITH {PIXEL_SQL}, n AS (SELECT a.r, a.c, a.z, {', '.join(f"max(CASE WHEN b.r = a.r + ({i}) AND b.c = a.c + ({j}) THEN b.z END) AS n{k}" for k, (i, j) in enumerate((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)))} FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9),
g AS (SELECT *, ((n2 + 2 * n5 + n8) - (n0 + 2 * n3 + n6)) / 80 AS dx, ((n6 + 2 * n7 + n8) - (n0 + 2 * n1 + n2)) / 80 AS dy FROM n)
SELECT r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, round(greatest(n0, n1, n2, n3, n4, n5, n6, n7, n8) - least(n0, n1, n2, n3, n4, n5, n6, n7, n8), 5) AS roughness FROM g""",
)
def terrain(t: Tables) -> DataFrame:
    """3 x 3 stencil: each pixel is sent to its nine neighbours, which gather nine values in one aggregate."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))]))
    sent = pixels(t).select("r", "c", "z", at.alias("o")).select((F.col("r") - F.col("o.i")).alias("r"), (F.col("c") - F.col("o.j")).alias("c"), F.col("o.k").alias("k"), "z")
    n = sent.groupBy("r", "c").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"n{k}") for k in range(9)], F.count("*").alias("m")).where("m = 9")
    dx = (F.col("n2") + 2 * F.col("n5") + F.col("n8") - (F.col("n0") + 2 * F.col("n3") + F.col("n6"))) / 80
    dy = (F.col("n6") + 2 * F.col("n7") + F.col("n8") - (F.col("n0") + 2 * F.col("n1") + F.col("n2"))) / 80
    all9 = [f"n{k}" for k in range(9)]
    return n.select("r", "c", R(F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))), 5).alias("slope"), R(F.greatest(*all9) - F.least(*all9), 5).alias("roughness"))


@query("rp15_zonal", f"WITH {PIXEL_SQL} SELECT r // 5 AS zr, c // 5 AS zc, round(avg(z), 5) AS mean, round(median(z), 5) AS med, round(stddev_pop(z), 5) AS sd, min(z) AS lo, max(z) AS hi, count(*) AS n, round(count(*) / 25.0::DOUBLE, 5) AS fraction FROM px GROUP BY ALL")
def zonal(t: Tables) -> DataFrame:
    g = pixels(t).groupBy(F.floor(F.col("r") / 5).alias("zr"), F.floor(F.col("c") / 5).alias("zc"))
    return g.agg(R(F.avg("z"), 5).alias("mean"), R(F.median("z"), 5).alias("med"), R(F.stddev_pop("z"), 5).alias("sd"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.count("*").alias("n"), R(F.count("*") / 25.0, 5).alias("fraction"))


@query("sp28_centroids", f"WITH {PIXEL_SQL} SELECT r // 5 AS zone, round(avg(c) + 0.5, 5) AS x, round(avg(r) + 0.5, 5) AS y, min(c) AS x0, max(c) + 1 AS x1 FROM px GROUP BY 1")
def centroids(t: Tables) -> DataFrame:
    g = pixels(t).groupBy(F.floor(F.col("r") / 5).alias("zone"))
    return g.agg(R(F.avg("c") + 0.5, 5).alias("x"), R(F.avg("r") + 0.5, 5).alias("y"), F.min("c").alias("x0"), (F.max("c") + 1).alias("x1"))


_STEPS = "(VALUES " + ", ".join(f"({k}, {i}, {j}, {10.0 * sqrt(i * i + j * j)!r}::DOUBLE)" for k, (i, j) in enumerate(AROUND)) + ") AS s(k, i, j, d)"


@query(
    "rp16_flow_wetness",
    f"""WITH RECURSIVE {PIXEL_SQL}, n AS (SELECT a.r, a.c, k, b.r AS br, b.c AS bc, round((a.z - b.z) / d, 9) AS drop FROM px a, {_STEPS} JOIN px b ON b.r = a.r + i AND b.c = a.c + j),
way AS (SELECT r, c, br, bc, drop FROM n WHERE drop > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY drop DESC, k) = 1),
walk AS (SELECT r, c, r AS ar, c AS ac FROM px UNION ALL SELECT w.r, w.c, y.br, y.bc FROM walk w JOIN way y ON y.r = w.ar AND y.c = w.ac),
cells AS (SELECT ar AS r, ac AS c, count(*) AS cells FROM walk GROUP BY ALL)
SELECT r, c, cells, round(ln(cells * 10 / greatest(coalesce(drop, 0), 0.001::DOUBLE)), 5) AS twi FROM cells LEFT JOIN way USING (r, c)""",
)
def flow_wetness(t: Tables) -> DataFrame:
    """Cells that drain through each pixel and its wetness index."""
    return wetness(pixels(t), 10.0).select("r", "c", "cells", R("twi", 5).alias("twi"))
