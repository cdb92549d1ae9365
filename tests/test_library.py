"""Operators on small cases: known values, properties and brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import scalars as S
from cohortspark.operators import assign, context, edges, metrics, spatial, statistics, temporal
from cohortspark.operators.bootstrap import draw_counts, paired_bootstrap
from cohortspark.operators.graph import connected_components
from cohortspark.operators.skew import split_join


def graph_of(spark, pairs):
    return spark.createDataFrame([(p, c, float(x)) for p, c, x in pairs], "p long, c long, cost double")


# Four demand rows (two cases, two controls each), five columns.
LEGAL = [(0, 0, 1), (0, 1, 2), (0, 2, 9), (1, 2, 9), (1, 3, 1), (1, 4, 2)]


def test_cheapest_assignment(spark):
    out = assign.cheapest_assignment(graph_of(spark, LEGAL), spark.createDataFrame([(0,), (1,)], "p long")).collect()
    assert sorted((r.p, r.c) for r in out) == [(0, 0), (0, 1), (1, 3), (1, 4)]


def test_common_support_of_two_cases(spark):
    g = graph_of(spark, [(0, 0, 1), (0, 1, 2), (1, 1, 1)])
    assert [r.p for r in assign.common_support(g).collect()] == [0]
    assert assign.maximum_flow(g).count() // 2 == 1


def best_support(pairs):
    cases = sorted({p for p, _, _ in pairs})
    best, cheapest = 0, {}
    for n in range(len(cases), 0, -1):
        for some in itertools.combinations(cases, n):
            options = [list(itertools.combinations(sorted({(c, x) for q, c, x in pairs if q == p}), 2)) for p in some]
            for pick in itertools.product(*options):
                used = [c for pair in pick for c, _ in pair]
                if len(set(used)) == len(used):
                    best = max(best, n)
                    cost = sum(x for pair in pick for _, x in pair)
                    cheapest[some] = min(cost, cheapest.get(some, cost))
        if best:
            break
    return best, cheapest


@pytest.mark.parametrize("seed, dense", [(3, 0.3), (4, 0.15)])
def test_searches_over_all_tasks_against_the_exact_solvers(spark, seed, dense):
    """One component without tasks that hold it: flow, cut, support, repair as by the exact methods, cost within the step."""
    rng = random.Random(seed)
    pairs = sorted({(p, 100 + c): rng.randint(1, 40) / 10 for p in range(8) for c in range(14) if rng.random() < dense}.items())
    g = graph_of(spark, [(p, c, x) for (p, c), x in pairs]).cache()
    legal = dict(pairs)
    for demand, capacity in ((2, 1), (2, 2)):
        (one, cut), (two, other) = (assign.certified_flow(g, demand, capacity, n) for n in (10**6, 0))
        one, two = one.collect(), two.collect()
        assert len(one) == len(two) == cut == other
        for got in (one, two):
            assert len(set(got)) == len(got) and {(r.p, r.c) for r in got} <= set(legal)
            assert max(Counter(r.p for r in got).values()) <= demand and max(Counter(r.c for r in got).values()) <= capacity
    support = assign.common_support(g).cache()
    by_rounds = {r.p for r in assign.common_support(g, largest=0).collect()}
    flow = assign.maximum_flow(g.where(F.col("p").isin([*by_rounds, -1])), 2, 1)
    assert flow.count() == 2 * len(by_rounds)  # they can all be served
    assert support.count() - 1 <= len(by_rounds) <= support.count()
    best = assign.cheapest_assignment(g, support).collect()
    near = assign.cheapest_assignment(g, support, largest=0, step=0.05).collect() if seed == 3 else best
    assert len(near) == len(best) and len({r.c for r in near}) == len(near) and all(legal[r.p, r.c] == r.cost for r in near)
    assert sum(r.cost for r in near) <= sum(r.cost for r in best) + 0.05 * len(best) + 1e-9
    slots = spark.createDataFrame([(r.p, i, None if r.c % 3 == 0 else r.c) for i, r in enumerate(best)], "p long, rank int, c long")
    fixed, small = (assign.repaired(slots, g.where("c % 5 <> 0 or p = 0"), largest=n).collect() for n in (0, 10**6))
    for rows in (fixed, small):
        used = [r.new for r in rows if r.new is not None]
        assert len(rows) == len(best) and len(set(used)) == len(used)
        assert all((r.p, r.new) in legal or r.new == r.old for r in rows if r.new is not None) and not any(r.new is None and r.old is not None for r in rows)
    assert sum(r.new is None for r in fixed) == sum(r.new is None for r in small)


@pytest.mark.parametrize("seed", range(40))
def test_ranked_support_by_brute_force(seed):
    """Of all sets of cases that can be served, the largest; of these the least sum of ranks."""
    rng = random.Random(100 + seed)
    g = {p: sorted(c for c in range(10, 18) if rng.random() < 0.4) for p in range(6)}
    g = {p: c for p, c in g.items() if c}
    rank = {p: rng.choice([0, 1, 2, 3, 5, 8]) for p in g}

    def served(cases, used=frozenset()):
        if not cases:
            return True
        return any(served(cases[1:], used | set(two)) for two in itertools.combinations([c for c in g[cases[0]] if c not in used], 2))

    sets = [s for n in range(len(g) + 1) for s in itertools.combinations(sorted(g), n) if served(s)]
    most = max(map(len, sets))
    got = assign._least_ranked(g, rank)
    assert len(got) == most and tuple(sorted(got)) in sets
    assert sum(rank[p] for p in got) == min(sum(rank[p] for p in s) for s in sets if len(s) == most)


def test_costs_that_cannot_be_met_raise(spark):
    """Two cases want two controls each of three, at either size."""
    g = graph_of(spark, [(p, c, 1) for p in range(2) for c in (10, 11, 12)])
    cases = g.select("p").distinct()
    for largest in (0, 10**6):
        with pytest.raises(Exception, match="get 2 controls"):
            assign.cheapest_assignment(g, cases, largest=largest).collect()


def test_contested_slots(spark):
    """Three vacant slots, two free controls: one stays vacant, at either size, and nothing is raised."""
    g = graph_of(spark, [(p, c, 1) for p in range(3) for c in (10, 11)])
    slots = spark.createDataFrame([(p, 1, None) for p in range(3)], "p long, rank int, c long")
    for largest in (0, 10**6):
        got = [r.new for r in assign.repaired(slots, g, largest=largest).collect()]
        assert sorted(c for c in got if c is not None) == [10, 11] and got.count(None) == 1


@pytest.mark.parametrize("seed", range(40))
def test_support_and_cost_by_brute_force(seed):
    rng = random.Random(seed)
    pairs = sorted({(p, 10 + c): rng.randint(1, 9) for p in range(4) for c in range(6) if rng.random() < 0.5}.items())
    pairs = [(p, c, x) for (p, c), x in pairs]
    g = {}
    for p, c, x in sorted(pairs, key=lambda e: (e[0], e[2], e[1])):
        g.setdefault(p, []).append(c)
    best, cheapest = best_support(pairs)
    got = assign._support(g)
    assert len(got) == best
    if got:
        cost = {(p, c): float(x) for p, c, x in pairs}
        own = {p: g[p] for p in got}
        picked = assign._cheapest(own, cost, 2)
        assert len({c for _, c in picked}) == 2 * len(got)
        assert sum(cost[e] for e in picked) == pytest.approx(cheapest[tuple(got)])


def test_repair_moves_as_few_slots_as_needed(spark):
    slots = spark.createDataFrame([(0, 1, 10), (1, 1, None)], "p long, rank int, c long")
    g = graph_of(spark, [(0, 10, 1), (0, 11, 2), (1, 10, 1)])
    got = {(r.p, r["rank"]): (r.old, r.new) for r in assign.repaired(slots, g).collect()}
    assert got == {(0, 1): (10, 11), (1, 1): (None, 10)}


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 100), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}


def test_triplet_scores(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.2), (0, 0, 0.1), (1, 1, 0.4), (1, 0, 0.6), (1, 0, 0.3)], "set_id int, y int, s double")
    o = metrics.set_outcomes(df, "s").orderBy("set_id").collect()
    assert [r.strict for r in o] == [1, 0] and sum(r.edge for r in o) / 2 == 0.75
    assert [round(r.margin, 9) for r in o] == [0.7, -0.2]


def test_ranking_metrics_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 12) / 4.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auroc(df, "s", "y").first()[0] == pytest.approx(want)
    ap, tp = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        now = sum(p >= s for p in pos)
        ap += (now - tp) / len(pos) * now / sum(x >= s for _, x in rows)
        tp = now
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)


def test_deviations_follow_a_permutation(spark):
    rows = [(s, u, f, float((s * 7 + u * 3 + f * 5) % 11)) for s in range(5) for u in range(3) for f in range(4)]
    one = spark.createDataFrame(rows, "set_id int, unit_id int, feature int, x double")
    two = spark.createDataFrame([(s, (u + 1) % 3, f, x) for s, u, f, x in rows], one.schema)
    a = {(r.set_id, r.unit_id, r.feature): r.signed for r in context.deviations(one).collect()}
    b = {(r.set_id, r.unit_id, r.feature): r.signed for r in context.deviations(two).collect()}
    assert all(b[s, (u + 1) % 3, f] == pytest.approx(v, abs=3e-6) for (s, u, f), v in a.items())


def test_derangement(spark):
    got = {r.k: r.other for r in context.derangement(spark.range(50).withColumnRenamed("id", "k"), "k").collect()}
    assert sorted(got) == sorted(got.values()) and all(k != v for k, v in got.items())


def test_exact_quantiles(spark):
    df = spark.range(1001).select((F.col("id") * 37 % 1001).cast("double").alias("x"))
    assert statistics.exact_quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 1.0}).first()[:] == (250.0, 500.0, 1000.0)


def test_nearest_far_away(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e5, 1e5)], "s long, x double, y double")
    pool = spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, -4.0), (9, 9e4, 1e5)], "i long, x double, y double")
    got = {r.s: (r.i, r.dist) for r in spatial.nearest_join(sites, pool, "s", "i", 1.0).collect()}
    assert got == {1: (7, 5.0), 2: (9, 1e4)}


def test_checked_join_fails_on_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(Exception, match="not unique"):
        edges.checked_join(a, b, ["k"]).collect()
    assert edges.checked_join(a, b, ["k"], validate="one_to_many").count() == 2


def test_bootstrap_draws_and_interval(spark):
    """Counts by the definition, of mean 1, and a normal interval for a plain mean."""
    import hashlib
    import math

    got = {(r.k, r.b): r.times for r in draw_counts(spark.range(300).withColumnRenamed("id", "k"), "k", 30, 3).collect()}
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    for k in range(300):
        for b in range(30):
            h = hashlib.md5(f"3:{b // 8}:{k}".encode()).hexdigest()
            u = int(h[4 * (b % 8) : 4 * (b % 8) + 4], 16)
            assert got.get((k, b), 0) == sum(u >= round(65536 * c) for c in cdf if round(65536 * c) < 65536)
    assert abs(sum(got.values()) / 9000 - 1) < 0.05
    rng = random.Random(1)
    d = [rng.gauss(0.3, 1) for _ in range(400)]
    r = paired_bootstrap(spark.createDataFrame([(i, 0.0, x) for i, x in enumerate(d)], "k long, a double, b double"), "k", "a", "b", 2000).first()
    mean, half = sum(d) / 400, 1.96 * (sum((x - sum(d) / 400) ** 2 for x in d) / 400) ** 0.5 / 20
    assert r.replicates == 2000 and r.observed == pytest.approx(mean) and r.low == pytest.approx(mean - half, abs=0.03) and r.high == pytest.approx(mean + half, abs=0.03)


def test_quantiles_in_ranges(spark):
    import numpy as np

    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000 + [float("nan"), None]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(x)], "x double, y long").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = statistics.quantiles(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None)}, probs)
    for n in (1, 2, 7, 88):
        few = [rng.gauss(0, 1) for _ in range(n)]
        assert statistics.quantiles(spark.createDataFrame([(v,) for v in few], "x double"), {"x": F.col("x")}, probs)["x"] == pytest.approx(np.quantile(few, probs))
    fine = [v for v in x if v is not None and v == v]
    assert got["x"] == pytest.approx(np.quantile(fine, probs)) and got["y"] == pytest.approx(np.quantile([i % 3 for i in range(len(x))], probs)) and got["none"] == [None] * 7


def test_decayed_sums_by_the_definition(spark):
    rng = random.Random(4)
    v = {k: [rng.random() for _ in range(n)] for k, n in (("a", 37), ("b", 5))}
    df = spark.createDataFrame([(k, i, x) for k, xs in v.items() for i, x in enumerate(xs)], "k string, i long, v double")
    for r in temporal.decayed_sum(df, "k", "i", "v", 0.8, 8).collect():
        assert r.decayed == pytest.approx(sum(0.8 ** (r.i - j) * v[r.k][j] for j in range(max(0, r.i - 7), r.i + 1)))


def test_split_join(spark):
    rows = spark.createDataFrame([(0 if i < 2000 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long").repartition(4)
    facts = spark.createDataFrame([(k, str(k)) for k in range(0, 2500)], "k long, t string")
    for how in ("inner", "left"):
        want, got = (sorted((tuple(r) for r in x.select("k", "v", "t").collect()), key=repr) for x in (rows.join(facts, "k", how), split_join(rows, facts, "k", how)))
        assert want == got


def test_layouts(spark):
    """792 and 2,446 values for static values of 92 and series of 70 x 10; a set's members deviate by its mean."""
    import numpy as np

    s, r = np.arange(3 * 92.0).reshape(3, 92), np.random.default_rng(0).normal(size=(3, 70, 10))
    df = spark.createDataFrame([(7, i, s[i].tolist(), r[i].ravel().tolist()) for i in range(3)], "set_id long, u long, s array<double>, r array<double>")
    rows = context.set_blocks(df, "set_id", "u", "s", "r", 10).select("u", *[context.variant(k).alias(k) for k in context.ABLATIONS]).collect()
    assert [len(rows[0][k]) for k in context.ABLATIONS] == [792, 1584, 1584, 2376, 976, 2262, 2446]
    for x in rows:
        ds, dr = s[x.u] - s.mean(0), (r - r.mean(0))[x.u]
        seven = np.concatenate([dr.mean(0), dr.std(0), dr.max(0), dr.min(0), dr.sum(0), dr[-1], np.abs(dr).max(0)])
        assert x.A6 == pytest.approx(np.concatenate([s[x.u], ds, np.abs(ds), r[x.u].ravel(), dr.ravel(), np.abs(dr).ravel(), seven]))


def test_scalars_with_nulls(spark):
    df = spark.createDataFrame([(None, None), (" NaN ", 1.0), ("2.0", None)], "t string, x double")
    r = df.select(S.cleaned(F.col("t")).alias("c"), S.truthy(F.col("t")).alias("b"), S.normal_id(F.col("t")).alias("i"), S.row_mean(F.col("x"), F.lit(3.0)).alias("m")).collect()
    assert [x.c for x in r] == [None, None, "2.0"] and [x.b for x in r][::2] == [False, True] and r[2].i == "2" and [x.m for x in r] == [3.0, 2.0, 3.0]
