"""Boosted trees against a plain search of the best split, and what they learn on planted tables."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import boosting as B
from cohortspark.operators import learn as L


def table(spark, rows, parts=3):
    """rows: (set_id, unit, y, fold, features)."""
    return spark.createDataFrame([(s, u, float(y), 1.0 if y else 0.5, f, x) for s, u, y, f, x in rows], "set_id long, unit long, y double, w double, fold int, x array<double>").repartition(parts)


def fitted(df, models, bins=16, seed=7):
    cuts = B.edges(df, "x", bins)
    t = B.binned(df, "x", cuts, "set_id", ["unit"], "y", "w", "fold")
    width, places = len(cuts), max((len(c) for c in cuts), default=0) + 2
    return cuts, t, B.train(t, models, width, places, seed)


def planted(seed, sets, noise=0.3, features=4):
    """The case of a set is the member of the largest value of a rule; each set has an offset that hides it from the others."""
    rng = random.Random(seed)
    rows = []
    for s in range(sets):
        offset = rng.gauss(0, 3)
        xs = [[rng.gauss(0, 1) for _ in range(features)] for _ in range(3)]
        worth = [x[0] * x[1] + (x[2] > 0) + rng.gauss(0, noise) for x in xs]
        case = max(range(3), key=worth.__getitem__)
        rows += [(s, 3 * s + i, int(i == case), s % 5, [*x[:-1], x[-1] + offset]) for i, x in enumerate(xs)]
    return rows


def plain_split(x, g, h, s, bins):
    """The best root split by trying all, as (gain, feature, bin)."""
    worth = lambda g, h: max(abs(g) - s.l1, 0) ** 2 / (h + s.l2) if h + s.l2 > 0 else 0
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for b in range(bins):
            left = x[:, f] <= b
            if min(left.sum(), (~left).sum()) < max(1, s.least_rows) or min(h[left].sum(), h[~left].sum()) < s.least_weight:
                continue
            gain = round(worth(g[left].sum(), h[left].sum()) + worth(g[~left].sum(), h[~left].sum()) - worth(g.sum(), h.sum()), 9)
            if gain > best[0]:
                best = (gain, f, b)
    return best


@pytest.mark.parametrize("loss", [B.LOGISTIC, B.PAIRS])
def test_first_round_against_all_splits(spark, loss):
    rng = random.Random(3)
    rows = [(s, 4 * s + i, int(i < 1 + s % 2), s % 3, [rng.choice([0.0, 1.0, 2.0, None]), rng.gauss(0, 1), float("nan") if rng.random() < 0.1 else rng.random(), 5.0]) for s in range(60) for i in range(rng.choice([1, 3, 4]))]
    setting = B.Setting("one", 0.5, 1, 2, least_rows=3, least_weight=0.2, l2=0.7, l1=0.05, loss=loss)
    cuts, t, (m,) = fitted(table(spark, rows), [B.Model(setting, without=2)])
    train = [r for r in rows if r[3] != 2]
    x = np.array([[len(c) + 1 if v is None or v != v else int((c < v).sum()) for v, c in zip(r[4], cuts, strict=True)] for r in train])
    y, w = np.array([r[2] for r in train]), np.array([1.0 if r[2] else 0.5 for r in train])
    start = np.log((w * y).sum() / (w * (1 - y)).sum()) if loss == B.LOGISTIC else 0.0
    assert m.start == pytest.approx(start)
    if loss == B.LOGISTIC:
        p = 1 / (1 + np.exp(-start))
        g, h = w * (p - y), w * p * (1 - p)
    else:  # one by one
        g, h = np.zeros(len(x)), np.zeros(len(x))
        for i, a in enumerate(train):
            for j, b in enumerate(train):
                if a[0] == b[0] and a[2] == 1 and b[2] == 0:
                    g[i], g[j], h[i], h[j] = g[i] - 0.5, g[j] + 0.5, h[i] + 0.25, h[j] + 0.25
    used = (h > 0) | (g != 0)
    x, g, h = x[used], g[used], h[used]
    tree, bins = m.trees[0], max(map(len, cuts)) + 2
    gain, feature, cut = plain_split(x, g, h, setting, bins)
    assert feature is not None and (tree.feature[1], tree.cut[1]) == (feature, cut)
    for node, own in ((2, x[:, feature] <= cut), (3, x[:, feature] > cut)):
        _, f, c = plain_split(x[own], g[own], h[own], setting, bins)
        if f is None:
            assert tree.cut[node] == -1
            continue
        assert (tree.feature[node], tree.cut[node]) == (f, c)
        for child, part in ((2 * node, x[own][:, f] <= c), (2 * node + 1, x[own][:, f] > c)):
            gs, hs = g[own][part].sum(), h[own][part].sum()
            assert tree.value[child] == pytest.approx(-0.5 * np.sign(gs) * max(abs(gs) - 0.05, 0) / (hs + 0.7))


def test_trees_do_not_depend_on_the_layout(spark):
    rows = planted(1, 120)
    setting = B.Setting("s", 0.3, 3, 3, l2=1.0, rows=0.8, columns=0.75, loss=B.PAIRS)
    first, second = (fitted(table(spark, rows, parts), [B.Model(setting)])[2][0] for parts in (1, 6))
    for a, b in zip(first.trees, second.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    dense, B.DENSE = B.DENSE, 1
    try:  # sparse histograms give the same trees
        third = fitted(table(spark, rows, 6), [B.Model(setting)])[2][0]
    finally:
        B.DENSE = dense
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() for a, b in zip(first.trees, third.trees, strict=True))


def test_ranker_beats_boosted_differences(spark):
    rows = planted(2, 400)
    df = table(spark, rows)
    setting = B.Setting("rank", 0.3, 12, 4, least_weight=1.0, l2=1.0, loss=B.PAIRS)
    held = [r for r in rows if r[3] == 0]
    _, t, models = fitted(df, [B.Model(setting, without=0)], bins=32)
    score = {r.unit: r.scores[0] for r in B.scores(t.where("fold = 0"), models, 4, ["unit"]).collect()}

    def strict(score):
        sets = {s: [r for r in held if r[0] == s] for s in {r[0] for r in held}}
        return np.mean([all(score[a[1]] > score[b[1]] for a in own if a[2] for b in own if not b[2]) for own in sets.values()])

    wide = df.select("set_id", "unit", "y", "fold", *(F.col("x")[i].alias(f"x{i}") for i in range(4)))
    case = wide.where("y = 1").select("set_id", *(F.col(f"x{i}").alias(f"p{i}") for i in range(4)))
    pairs = wide.where("y = 0 and fold <> 0").join(case, "set_id").withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    pairs = pairs.select((F.col("sign") > 0).cast("double").alias("label"), *((F.col("sign") * (F.col(f"p{i}") - F.col(f"x{i}"))).alias(f"x{i}") for i in range(4)))
    names = [f"x{i}" for i in range(4)]
    model = L.boosted(L.assembled(pairs, names), "label", rounds=12)
    other = {r.unit: r.score for r in L.probability(model, L.assembled(wide.where("fold = 0"), names), "score").collect()}
    assert strict(score) > strict(other) + 0.1 and strict(score) > 0.5


def test_early_stop_and_leaves(spark):
    rng = random.Random(4)
    noise = [(s, s, rng.random() < 0.5, s % 5, [rng.gauss(0, 1) for _ in range(3)]) for s in range(300)]
    setting = B.Setting("noise", 0.5, 30, 4, leaves=5)
    _, t, (m,) = fitted(table(spark, noise), [B.Model(setting, without=0, watch=1, patience=2)])
    assert m.done and len(m.trees) == int(np.argmin(m.losses)) < 8
    _, _, (whole,) = fitted(table(spark, noise), [B.Model(replace(setting, rounds=2))])
    for tree in whole.trees:
        assert (tree.cut >= 0).sum() == 4  # five leaves


def test_edges_of_tables(spark):
    setting = B.Setting("e", 0.5, 2, 2, loss=B.PAIRS)
    _, t, (m,) = fitted(table(spark, []), [B.Model(setting)])
    assert t.count() == 0 and m.score(np.zeros((1, 0), np.uint8)).tolist() == [0.0]
    same = [(s, 2 * s + i, i, 0, [1.0, None]) for s in range(5) for i in range(2)] + [(9, 99, 1, 0, [2.0, 1.0])] * 2  # equal values, and a set without controls
    _, t, (m,) = fitted(table(spark, same), [B.Model(setting)])
    assert B.scores(t, [m], 2, ["unit"]).count() == 12 and all((tree.cut < 0).all() for tree in m.trees)
