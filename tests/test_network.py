"""Networks: derivatives against differences, planted rules, early stopping and layouts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import network as N


def planted(spark, n=800, seed=1, noise=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, x, float(rng.random() < 0.5 if noise else x[0] * x[1] > 0), i % 4 == 0))
    return spark.createDataFrame(rows, "id long, x array<double>, y double, v boolean").repartition(3)


def auc(rows, score):
    ones, zeros = ([score(r) for r in rows if r.y == v] for v in (1.0, 0.0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("loss", [N.LOGISTIC, N.PULL])
def test_derivatives(loss):
    rng = np.random.default_rng(1)
    net = N.Network([4, 5, 3 if loss == N.PULL else 1], loss).begin(3)
    x, y, w = rng.normal(size=(12, 4)), (np.arange(12) % 3 == 0).astype(float), rng.random(12) + 0.5
    out = net.forward(x)[-1]
    value, grad = net.slope(out, y, w)
    middle = out[y == 1].mean(axis=0)

    def plain(o):
        if loss == N.LOGISTIC:
            z = o[:, 0]
            return (w * np.log1p(np.exp(np.where(y == 1, -z, z)))).sum() / w.sum()
        far = np.sqrt(((o - middle) ** 2).sum(axis=1))
        return (far[y == 1] ** 2).mean() + (np.maximum(0, 2.0 - far[y == 0]) ** 2).mean()

    assert value == pytest.approx(plain(out))
    for i in range(12):
        for j in range(out.shape[1]):
            up, down = out.copy(), out.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert grad[i, j] == pytest.approx((plain(up) - plain(down)) / 2e-6, abs=1e-6)


def test_learns_a_product_of_two_features(spark):
    df = planted(spark)
    net = N.fit(df, N.Network([3, 32, 16, 1]), "id", "x", "y", valid=F.col("v"), rounds=10, patience=4, per_worker=400)
    assert auc(N.applied(df.where("v"), net, "x", "p").collect(), lambda r: r.p) > 0.93
    again = N.fit(df.repartition(7), N.Network([3, 32, 16, 1]), "id", "x", "y", valid=F.col("v"), rounds=2, per_worker=400)
    first = N.fit(df, N.Network([3, 32, 16, 1]), "id", "x", "y", valid=F.col("v"), rounds=2, per_worker=400)
    assert all(np.allclose(a, b) for a, b in zip(first.weights, again.weights, strict=True))


def test_noise_ends_early(spark):
    net = N.fit(planted(spark, 200, noise=True), N.Network([3, 16, 1]), "id", "x", "y", valid=F.col("v"), rounds=15, patience=1)
    assert len(net.losses) < 15
    empty = N.fit(planted(spark, 8).limit(0), N.Network([3, 4, 1]), "id", "x", "y")
    assert len(empty.weights) == 4


def test_pull_brings_ones_together(spark):
    df = planted(spark, 600, seed=3)
    net = N.fit(df, N.Network([3, 32, 8], N.PULL, dropout=0.0), "id", "x", "y", valid=F.col("v"), rounds=8, per_worker=600)
    rows = N.applied(df, net, "x", "e").collect()
    middle = np.mean([r.e for r in rows if r.y == 1 and not r.v], axis=0)
    assert auc([r for r in rows if r.v], lambda r: -np.linalg.norm(np.array(r.e) - middle)) > 0.85
