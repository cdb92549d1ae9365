"""Flow over a raster held as a table of pixels (r, c, z): D8 directions, accumulation by pointer doubling, wetness."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable

# The eight neighbours in the order that settles ties, as row and column steps.
AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def flow_directions(pixels: DataFrame, cell: float = 1.0) -> DataFrame:
    """(r, c, to_r, to_c, drop): each pixel's neighbour of the steepest descent (of equal ones to 9 digits the first in AROUND)
    and the tangent of its slope; nulls for a pixel without a lower neighbour. Pixels with a null height take no part.

    Each pixel is sent to the eight it borders on, which look for the largest drop in one aggregate."""
    px = pixels.where("z is not null").select("r", "c", "z")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(cell * sqrt(i * i + j * j)).alias("d")) for k, (i, j) in enumerate(AROUND)])
    sent = px.withColumn("o", F.explode(steps)).select((F.col("r") - F.col("o.i")).alias("r"), (F.col("c") - F.col("o.j")).alias("c"), F.col("z").alias("nz"), "o")
    drop = F.round((F.col("z") - F.col("nz")) / F.col("o.d"), 9)
    best = sent.join(px, ["r", "c"]).withColumn("drop", drop).where("drop > 0").groupBy("r", "c").agg(F.max(F.struct("drop", (-F.col("o.k")).alias("k"), "o.i", "o.j")).alias("b"))
    found = px.join(best, ["r", "c"], "left")
    return found.select("r", "c", (F.col("r") + F.col("b.i")).alias("to_r"), (F.col("c") + F.col("b.j")).alias("to_c"), F.col("b.drop").alias("drop"))


def accumulated(directions: DataFrame) -> DataFrame:
    """(r, c, cells): how many pixels drain through each, itself included.

    Directions lead down, so they make a forest. After k rounds a pixel knows the pixels less than 2^k steps above it and its
    own descendant 2^k steps below, to which it then hands on what it knows: as many rounds as the longest flow path has
    binary digits, each an aggregate and a join, written. Pixels whose path has ended are passed over."""
    state = durable(directions.select("r", "c", "to_r", "to_c", F.lit(1).cast("long").alias("cells")))
    while not state.where("to_r is not null").isEmpty():
        handed = state.where("to_r is not null").groupBy(F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("cells").alias("more"))
        below = state.where("to_r is not null").select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("next_r"), F.col("to_c").alias("next_c"))
        on = state.join(handed, ["r", "c"], "left").join(below, ["to_r", "to_c"], "left")
        state = durable(on.select("r", "c", F.col("next_r").alias("to_r"), F.col("next_c").alias("to_c"), (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")))
    return state.select("r", "c", "cells")


def wetness(pixels: DataFrame, cell: float, least_slope: float = 0.001) -> DataFrame:
    """(r, c, cells, twi): accumulation and the topographic wetness index ln(area per width / tan(slope)), slopes held to
    `least_slope`, which pits and flats have."""
    d = durable(flow_directions(pixels, cell))
    both = accumulated(d).join(d.select("r", "c", "drop"), ["r", "c"])
    return both.select("r", "c", "cells", F.log(F.col("cells") * cell / F.greatest(F.coalesce("drop", F.lit(0.0)), F.lit(least_slope))).alias("twi"))
