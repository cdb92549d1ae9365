"""Blocks about the set's mean, another set's and the mean of all rows, against numpy."""

import numpy as np
import pytest

from cohortspark.operators import context as C

CHANNELS, TIMES = 3, 4


def plain(s, r, ms, mr):
    ds, dr = s - ms, r - mr
    x = dr.reshape(TIMES, CHANNELS)
    stats = np.concatenate([x.mean(0), x.std(0), x.max(0), x.min(0), x.sum(0), x[-1], np.abs(x).max(0)])
    return {"static": s, "static_dev": ds, "static_abs": abs(ds), "series": r, "series_dev": dr, "series_abs": abs(dr), "series_stats": stats}


@pytest.mark.parametrize("kind", ["set", "alien", "global"])
def test_blocks(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(k // 3, k, rng.normal(size=5), rng.normal(size=CHANNELS * TIMES)) for k in range(21)] + [(9, 50, rng.normal(size=5), rng.normal(size=CHANNELS * TIMES))]
    df = spark.createDataFrame([(a, b, s.tolist(), r.tolist()) for a, b, s, r in rows], "set_id long, u long, s array<double>, r array<double>").repartition(4)
    got = {x.u: x for x in getattr(C, f"{kind}_blocks")(df, "set_id", "u", "s", "r", CHANNELS).collect()}
    mean = lambda part, of: np.mean([x[part] for x in rows if of is None or x[0] == of], axis=0)
    other = {x.set_id: x.other for x in C.derangement(df, "set_id").collect()}
    assert set(got) == {x[1] for x in rows} and all(a != b for a, b in other.items())
    for a, u, s, r in rows:
        of = {"set": a, "alien": other[a], "global": None}[kind]
        for name, want in plain(s, r, mean(2, of), mean(3, of)).items():
            assert np.allclose(got[u][name], want), name
    assert C.set_blocks(df.limit(0), "set_id", "u", "s", "r", CHANNELS).collect() == []
