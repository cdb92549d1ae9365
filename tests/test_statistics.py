"""Quantiles of groups, digests of ordered members and source discovery against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from cohortspark.operators.digest import ordered_digests
from cohortspark.operators.statistics import grouped_quantiles, quantiles
from cohortspark.sources.tables import discover


def test_grouped_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([rng.gauss(0, 1), 2.0, None, float("nan")])) for _ in range(3000)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.g: r for r in grouped_quantiles(df, ["g"], "x", probs).collect()}
    assert set(got) == {"hot", "a", None, "none", "one"}
    for g, r in got.items():
        own = [x for k, x in rows if k == g and x is not None and x == x]
        assert r.n == len(own) and (r.q is None if not own else r.q == pytest.approx(np.quantile(own, probs).tolist()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 900, 1100, 5000])
def test_quantiles_of_few_and_many_rows(spark, n):
    rng = random.Random(n)
    x = [rng.choice([rng.gauss(0, 1), 1.0]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.02, 0.25, 0.5, 0.999, 1.0]
    got = quantiles(df, {"x": df.x}, probs)["x"]
    assert got == ([None] * 6 if not n else pytest.approx(np.quantile(x, probs).tolist()))


def test_ordered_digests(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1] * 8 + [2, 3]), rng.randrange(10**6)) for _ in range(4000)] + [(9, 5), (None, 1), (7, None), (9, 5)]
    got = {r.g: (r.n, r.digest) for r in ordered_digests(spark.createDataFrame(rows, "g long, m long").repartition(6), "g", "m", "|").collect()}
    want = {}
    for g in (1, 2, 3, 9):
        own = sorted(m for k, m in rows if k == g)
        want[g] = (len(own), hashlib.sha256("|".join(map(str, own)).encode()).hexdigest())
    assert got == want


def test_discovery_picks_the_planted_table(spark):
    """Ten tables, one of which has all fields and all ids; ties by rows, then by name."""
    ids = spark.createDataFrame([(i,) for i in [*range(20), None]], "any long")
    tables = {f"t{i}": spark.createDataFrame([(k, k) for k in range(i + 1)], "other long, Unit_ID long") for i in range(8)}
    tables |= {"planted": spark.createDataFrame([(k, 1.0, "x") for k in range(30)], "unit long, Total_Price double, kind string"), "t7b": tables["t7"], "empty": tables["t0"].limit(0)}
    found = discover(tables, {"id": ("unit", "unit_id"), "total": ("totalprice",), "kind": ()}, "id", ids).orderBy("place").collect()
    assert [r.source for r in found][:3] == ["planted", "t7", "t7b"] and found[0].known == 1.0 and found[0].fields == 3 and found[-1].source == "empty"
