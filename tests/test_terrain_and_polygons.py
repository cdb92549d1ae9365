"""Flow over rasters, overlaps of convex polygons and medians of replicates against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import bootstrap, spatial, terrain


def test_flow_along_a_spiral(spark):
    """A path through all pixels in turn, as long as there are pixels, and a plain walk down."""
    rng = random.Random(1)
    heights = {(r, c): (r * 12 + (c if r % 2 == 0 else 11 - c)) for r in range(9) for c in range(12)}  # a snake
    for z in (heights, {k: rng.choice([1.0, 2.0, 2.5, 7.0]) for k in heights}, {(0, 0): 1.0}):
        z = {k: float(v) for k, v in z.items()}
        df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()] + [(50, 50, None)], "r long, c long, z double").repartition(3)
        to = {}
        for (r, c), v in z.items():
            options = [(round((v - z[r + i, c + j]) / math.hypot(i, j), 9), -k, (r + i, c + j)) for k, (i, j) in enumerate(terrain.AROUND) if (r + i, c + j) in z]
            best = max(options, default=(0.0,))
            to[r, c] = best[2] if best[0] > 0 else None
        got = {(x.r, x.c): (x.to_r, x.to_c) if x.to_r is not None else None for x in terrain.flow_directions(df).collect()}
        assert got == to
        cells = Counter()
        for k in z:
            while k is not None:
                cells[k] += 1
                k = to[k]
        out = terrain.wetness(df, 2.0).collect()
        assert {(x.r, x.c): x.cells for x in out} == dict(cells)
    assert terrain.wetness(df.limit(0), 1.0).collect() == []


def convex(rng, n, x, y, size):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * math.cos(a), y + size * math.sin(a)) for a in at]


def plain_inside(ring, x, y):
    return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_polygon_overlaps(spark):
    """Rectangles, turned squares and irregular rings against closed forms and a fine raster."""
    rng = random.Random(2)
    square = lambda x, y, h: [(x, y), (x + h, y), (x + h, y + h), (x, y + h)]
    turned = [(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]
    rings = {0: square(0.0, 0.0, 4.0), 1: square(3.0, 1.0, 4.0)[::-1], 2: turned, 3: square(4.0, 0.0, 1.0), 4: square(100.0, 100.0, 1.0), 5: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]}
    rings |= {10 + i: convex(rng, rng.randint(3, 7), rng.uniform(0, 6), rng.uniform(20, 26), 3) for i in range(8)}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in rings.items()] + [(99, None)], "k long, ring array<struct<x:double,y:double>>")
    for cell in (1.5, 50.0):
        got = {(r.a, r.b): r for r in spatial.polygon_overlaps(df, "k", cell).collect()}
        assert got[0, 1].area == pytest.approx(3.0) and got[0, 1].share == pytest.approx(3 / 16) and got[0, 2].area == pytest.approx(8.0) and got[1, 2].area == pytest.approx(1.0)
        assert (0, 3) not in got and not any(4 in k or 5 in k or 99 in k for k in got) and got[1, 3].area == pytest.approx(0.0, abs=1e-9) if (1, 3) in got else True
        for a in range(10, 18):
            for b in range(a + 1, 18):
                n, hit = 160, 0
                for i in range(n):
                    for j in range(n):
                        x, y = -4 + 14 * (i + 0.5) / n, 16 + 14 * (j + 0.5) / n
                        hit += plain_inside(rings[a], x, y) and plain_inside(rings[b], x, y)
                assert (got[a, b].area if (a, b) in got else 0.0) == pytest.approx(hit * (14 / n) ** 2, abs=0.25)


@pytest.mark.parametrize("values", [[0.0, 1.0], list(range(40)), [5.0] * 30 + [None], [1.0, 1.0, 2.0]])
def test_replicate_medians(spark, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "k long, v double")
    got = {r.b: (r.n, r.median) for r in bootstrap.replicate_medians(df, "k", "v", 200, 3).collect()}
    drawn = {}
    for r in bootstrap.draw_counts(df.where(F.col("v").isNotNull()), "k", 200, 3).collect():
        drawn.setdefault(r.b, []).extend([r.v] * r.times)
    middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    assert got == {b: (len(x), middle(sorted(x))) for b, x in drawn.items()}


def test_equal_polygons_are_clipped_once(spark):
    """Equal rings of more keys than a row holds: all pairs of keys, from few rows; ranges turned by 45 degrees keep corners that touch apart."""
    diamond = lambda x, y, h: [{"x": x + h, "y": y}, {"x": x, "y": y + h}, {"x": x - h, "y": y}, {"x": x, "y": y - h}]
    rows = [(k, diamond(0.0, 0.0, 4.0)[:: 1 if k % 2 else -1]) for k in range(150)] + [(200, diamond(2.0, 2.0, 2.0)), (201, diamond(7.0, 7.0, 4.0)), (-1, diamond(2.0, 2.0, 2.0))]
    df = spark.createDataFrame(rows, "k long, ring array<struct<x:double,y:double>>")
    got = {(r.a, r.b): r for r in spatial.polygon_overlaps(df, "k", (2.0, 10.0)).collect()}
    equal = {(a, b) for a in range(150) for b in range(a + 1, 150)}
    assert set(got) == equal | {(-1, 200)} | {(k, 200) for k in range(150)} | {(-1, k) for k in range(150)}
    assert all(got[k].area == pytest.approx(32.0) and got[k].share == pytest.approx(1.0) for k in equal)
    assert got[3, 200].area == pytest.approx(4.0) and got[3, 200].share == pytest.approx(4 / 32) and got[-1, 3].share == pytest.approx(4 / 8)


def test_lists_of_keys_are_expanded_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(spatial, "AT_ONCE", 5)
    a, b = pa.array([[1, 9], [4], [5, 6, 7]]), pa.array([[2, 3], [4, 8], [1, 2, 3]])
    out = list(spatial.expanded(a, b, np.array([1.0, 2.0, 3.0]), (np.array([2.0, 4.0, 6.0]), np.array([1.0, 1.0, 1.0]))))
    rows = [tuple(r.values()) for t in out for r in t.to_pylist()]
    assert len(out) == 3 and sorted(rows)[:2] == [(1, 2, 1.0, 0.5), (1, 3, 1.0, 0.5)] and (2, 9, 1.0, 1.0) in rows and (1, 7, 3.0, 3.0) in rows
    assert len(rows) == 4 + 2 + 9
