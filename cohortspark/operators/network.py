"""Dense networks trained in rounds: every worker takes an epoch of mini-batches over its rows in numpy from the shared
parameters, Spark adds up the workers' parameters, and their mean by rows begins the next round.

Rows belong to workers by a hash of their key and are taken in the order of another, so nothing depends on files or
partitions. Validation rows end the training; the parameters of the least loss stay."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

LOGISTIC, PULL = "logistic", "pull"
PER_WORKER, BATCH = 20_000, 64


@dataclass
class Network:
    """Weights and biases of layers, ReLU between them; loss: the log loss of one output, or `pull`, which draws the outputs of
    ones together and pushes those of zeros at least `margin` away from them."""

    layers: Sequence[int]
    loss: str = LOGISTIC
    dropout: float = 0.2
    rate: float = 0.01
    margin: float = 2.0
    weights: list[np.ndarray] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def begin(self, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        self.weights = [w for a, b in zip(self.layers, self.layers[1:], strict=False) for w in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        return self

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        """The outputs of all layers; with rng, hidden ones are dropped out and the others raised accordingly."""
        out = [x]
        for i in range(0, len(self.weights), 2):
            x = x @ self.weights[i] + self.weights[i + 1]
            if i + 2 < len(self.weights):
                x = np.maximum(x, 0)
                if rng is not None and self.dropout:
                    x = x * (rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
            out.append(x)
        return out

    def slope(self, out: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss of a batch and its derivative by the network's output."""
        if self.loss == LOGISTIC:
            z = out[:, 0]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            return float((w * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / w.sum()), ((p - y) * w / w.sum())[:, None]
        ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
        grad, loss = np.zeros_like(out), 0.0
        if len(ones):
            middle = out[ones].mean(axis=0)  # a moving target, not differentiated
            away = out - middle
            far = np.sqrt((away**2).sum(axis=1)) + 1e-12
            short = np.maximum(0, self.margin - far[zeros])
            loss = float((far[ones] ** 2).mean() + ((short**2).mean() if len(zeros) else 0.0))
            grad[ones] = 2 * away[ones] / len(ones)
            if len(zeros):
                grad[zeros] = -2 * (short / far[zeros])[:, None] * away[zeros] / len(zeros)
        return loss, grad

    def step(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, moments: list[np.ndarray], t: int) -> None:
        """One step of Adam on a batch."""
        outs = self.forward(x, rng)
        _, grad = self.slope(outs[-1], y, w)
        for i in range(len(self.weights) - 2, -1, -2):
            own = outs[i // 2]
            parts = (own.T @ grad, grad.sum(axis=0))
            if i:
                grad = (grad @ self.weights[i].T) * (own > 0) / (1 - self.dropout)
            for k, g in enumerate(parts):
                m, v = moments[2 * (i + k)], moments[2 * (i + k) + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                self.weights[i + k] = self.weights[i + k] - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def epoch(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        moments, t = [np.zeros_like(p) for p in self.weights for _ in range(2)], 0
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own, t = order[at : at + BATCH], t + 1
            self.step(x[own], y[own], w[own], rng, moments, t)


def _rows(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(b["x"].to_list(), dtype=np.float64).reshape(len(b), -1), b["y"].to_numpy(dtype=np.float64), b["w"].to_numpy(dtype=np.float64)


def _worker(net: Network, turn: int, epochs: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a worker does in a round: some epochs from the shared parameters; its own ones, times its rows."""
    start = replace(net, losses=[])

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        own = replace(start, weights=[p.copy() for p in start.weights])
        rng = np.random.default_rng([seed, turn, int(group["worker"].iloc[0])])
        for _ in range(epochs):
            own.epoch(*_rows(group), rng)
        flat = np.concatenate([p.ravel() for p in own.weights]) * len(group)
        return pd.DataFrame({"i": np.arange(len(flat)), "p": flat, "n": len(group)})

    return work


def fit(rows: DataFrame, net: Network, key: str, x: str, label: str, weight: str | None = None, valid: Column | None = None, rounds: int = 30, patience: int = 5, epochs: int = 3, per_worker: int = PER_WORKER, seed: int = 7) -> Network:
    """The network trained on rows of key, x (array of double, no null), label (0 or 1) and weight. Rows where `valid` holds
    are not trained on; their loss after each round ends the training when it has not fallen for `patience` rounds. A worker
    holds about `per_worker` rows, whatever their number. A table without rows leaves the network as it began."""
    held = F.lit(False) if valid is None else F.coalesce(valid, F.lit(False))
    table = rows.select(F.col(key).cast("string").alias("k"), F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), held.alias("v"))
    n = table.where("not v").count()
    net.begin(seed)
    if not n:
        return net
    workers = max(1, -(-n // per_worker))
    table = durable(table.withColumn("worker", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(workers))))
    sizes = [w.size for w in net.weights]
    best: tuple[float, list[np.ndarray]] | None = None
    for turn in range(rounds):
        told = table.where("not v").groupBy("worker").applyInPandas(_worker(net, turn, epochs, seed), "i long, p double, n long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        got = told.orderBy("i").toPandas()  # a row per parameter
        flat = (got["p"] / got["n"]).to_numpy()
        net.weights = [part.reshape(w.shape) for part, w in zip(np.split(flat, np.cumsum(sizes)[:-1]), net.weights, strict=True)]
        if valid is not None:
            loss = _loss(table.where("v"), net)
            net.losses.append(loss)
            if best is None or loss < best[0] - 1e-9:
                best = loss, net.weights
            if turn - int(np.argmin(net.losses)) >= patience:
                break
    if best is not None:
        net.weights = best[1]
    return net


def _loss(rows: DataFrame, net: Network) -> float:
    """The mean loss, in blocks by key and not by partition: `pull` takes the middle of a block's ones."""

    def block(b: pd.DataFrame) -> pd.DataFrame:
        x, y, w = _rows(b.sort_values("k"))
        size = w.sum() if net.loss == LOGISTIC else float(len(b))
        return pd.DataFrame({"a": [net.slope(net.forward(x)[-1], y, w)[0] * size], "n": [size]})

    blocks = F.pmod(F.xxhash64("k"), F.lit(max(1, rows.count() // 4096)))
    r = rows.groupBy(blocks).applyInPandas(block, "a double, n double").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).first()
    return (r.a or 0.0) / (r.n or 1.0)


def applied(rows: DataFrame, net: Network, x: str, out: str) -> DataFrame:
    """Adds the network's output to every row: the probability of label 1, or an array of double under `pull`."""

    @F.pandas_udf("array<double>")
    def values(arrays: pd.Series) -> pd.Series:
        return pd.Series(list(net.forward(np.array(arrays.to_list(), dtype=np.float64).reshape(len(arrays), -1))[-1]), dtype=object)

    raw = values(F.col(x).cast("array<double>"))
    return rows.withColumn(out, raw) if net.loss == PULL else rows.withColumn(out, 1 / (1 + F.exp(-raw[0])))
