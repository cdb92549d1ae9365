"""Gradient boosting on binned features: pointwise logistic loss, or pairs of a case and a control of one set.

Features are binned by quantiles once and written as bytes, a row per set. A level of a tree is one pass: each task sums
gradients and curvatures by node, feature and bin, Spark adds up these histograms, running sums over the bins give every
split's gain, and the best split of each node comes to the driver, which holds nothing but trees. All models in training (settings,
folds) share the passes. Scores are worked out anew from the trees, so no table is rewritten."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import durable

LOGISTIC, PAIRS = "logistic", "pairs"
CHUNK = 1 << 22  # entries of a feature matrix that are summed at a time
DENSE = 1 << 20  # cells of a model's histograms that a task holds; more are given out chunk by chunk


@dataclass(frozen=True)
class Setting:
    """How trees are grown; leaves: None for all that the depth allows."""

    name: str
    rate: float
    rounds: int
    depth: int
    leaves: int | None = None
    least_rows: int = 1
    least_weight: float = 0.0  # of curvature in a leaf
    l2: float = 0.0
    l1: float = 0.0
    rows: float = 1.0  # share of the sets that a tree is grown on
    columns: float = 1.0  # share of the features that a tree may split
    loss: str = LOGISTIC


# The settings that are tried.
HISTOGRAM = (
    Setting("H1", 0.05, 300, 6, leaves=31, least_rows=20, l2=0.1),
    Setting("H2", 0.035, 450, 8, leaves=63, least_rows=20, l2=1.0),
    Setting("H3", 0.025, 600, 10, leaves=127, least_rows=20, l2=2.0),
)
EXTREME = (
    Setting("D4", 0.04, 450, 4, least_weight=2.0, l2=5.0, l1=0.05, rows=0.90, columns=0.85),
    Setting("D6", 0.03, 650, 6, least_weight=2.0, l2=5.0, l1=0.05, rows=0.90, columns=0.80),
    Setting("D8", 0.02, 850, 8, least_weight=2.0, l2=7.0, l1=0.10, rows=0.90, columns=0.75),
)


@dataclass(frozen=True)
class Tree:
    """Nodes by number, root 1, children 2n and 2n + 1: rows with a bin of at most cut go left."""

    feature: np.ndarray
    cut: np.ndarray  # -1 at a leaf
    value: np.ndarray
    depth: int

    def nodes(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            cut = self.cut[at]
            at = np.where(cut >= 0, 2 * at + (x[rows, self.feature[at]] > cut), at)
        return at


@dataclass
class Model:
    """A setting without the rows of one fold (None: with all), and its trees so far. watch: a fold left out as well, whose
    loss ends the training when it has not fallen for `patience` rounds; the trees up to the least loss stay."""

    setting: Setting
    without: int | None = None
    watch: int | None = None
    patience: int = 10
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.value[t.nodes(x)]
        return out


def edges(rows: DataFrame, features: str, bins: int = 64, accuracy: int = 10_000) -> list[np.ndarray]:
    """The different inner quantiles of each entry of an array column, at most bins - 1 of an entry: values of the table,
    from a mergeable sketch, exact where an entry has fewer than `accuracy` values. Nulls and NaN are left out."""
    probs = [i / bins for i in range(1, bins)]
    long = rows.select(F.posexplode(features).alias("i", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = {r.i: r.q for r in long.groupBy("i").agg(F.percentile_approx("x", probs, accuracy).alias("q")).collect()}
    n = rows.agg(F.max(F.size(features))).first()[0] or 0
    return [np.unique(np.array(found.get(i, []), dtype=np.float64)) for i in range(n)]


def binned(rows: DataFrame, features: str, cuts: Sequence[np.ndarray], group: str, keep: Sequence[str], label: str, weight: str, fold: str) -> DataFrame:
    """One row per group, written: group, fold, and arrays of its members: kept columns, y, w and bins (a byte for each
    feature: how many cuts are below the value; one more than all cuts where it is missing)."""

    @F.pandas_udf("binary")
    def places(arrays: pd.Series) -> pd.Series:
        x = np.array([[np.nan if v is None else v for v in a] for a in arrays], dtype=np.float64).reshape(len(arrays), len(cuts))
        out = np.empty(x.shape, dtype=np.uint8)
        for j, c in enumerate(cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j], side="left"))
        return pd.Series([row.tobytes() for row in out])

    member = F.struct(*(F.col(c).alias(f"k_{c}") for c in keep), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), places(features).alias("bins"))
    return durable(rows.select(F.col(group).alias("group"), F.col(fold).cast("int").alias("fold"), member.alias("m")).groupBy("group", "fold").agg(F.sort_array(F.collect_list("m")).alias("m")))


def _matrix(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """x, y, w, each member's fold, the ends of the groups, and the members of a batch."""
    lists = b.column(b.schema.get_field_index("m"))
    members, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    x = np.frombuffer(b"".join(members.field("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
    folds = np.repeat(b.column(b.schema.get_field_index("fold")).to_numpy(), sizes)
    return x, members.field("y").to_numpy(), members.field("w").to_numpy(), folds, np.cumsum([0, *sizes]), members


def pairs_of(y: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the case and of the control of each pair within a group."""
    case, other = [], []
    for a, b in zip(ends, ends[1:], strict=False):
        p, n = a + np.flatnonzero(y[a:b] == 1), a + np.flatnonzero(y[a:b] != 1)
        case.append(np.repeat(p, len(n)))
        other.append(np.tile(n, len(p)))
    return np.concatenate([*case, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*other, np.empty(0, np.int64)]).astype(np.int64)


def gradients(loss: str, score: np.ndarray, y: np.ndarray, w: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative of the loss by each row's score, and each row's share of the loss."""
    if loss == LOGISTIC:
        p = 1 / (1 + np.exp(-score))
        return w * (p - y), w * p * (1 - p), w * np.logaddexp(0, np.where(y == 1, -score, score))
    case, other = pairs
    gap = score[case] - score[other]
    miss, n = 1 / (1 + np.exp(gap)), len(score)
    count = lambda at, v: np.bincount(at, v, minlength=n)
    return count(other, miss) - count(case, miss), count(case, miss * (1 - miss)) + count(other, miss * (1 - miss)), count(case, np.logaddexp(0, -gap))


def _drawn(group: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A share of the groups, by a hash of their number in place of a draw, so that it does not depend on the layout."""
    h = (group.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def _histograms(table: DataFrame, models: Sequence[Model], growing: Sequence[Tree | None], level: int, width: int, bins: int, seed: int) -> DataFrame:
    """(model, node, feature, bin, g, h, n) of the nodes of one level, and a row of feature -1 with the loss on the
    watched fold (g) and its weight (h)."""
    todo = [(i, m, t) for i, (m, t) in enumerate(zip(models, growing, strict=True)) if t is not None]
    names = ["model", "node", "feature", "bin", "g", "h", "n"]

    def given(i: int, there: np.ndarray, sums: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(there), 100_000):
            cut = slice(a, a + 100_000)
            node, rest = np.divmod(there[cut], width * bins)
            columns = (np.full(len(node), i), node + (1 << level), *np.divmod(rest, bins), sums[0][cut], sums[1][cut], sums[2][cut].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = 1 << level, {}
        watched = {i: np.zeros(2) for i, m, _ in todo if m.watch is not None and level == 0}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w, folds, ends, _ = _matrix(b, width)
            pairs = pairs_of(y, ends) if any(m.setting.loss == PAIRS for _, m, _ in todo) else (ends[:0], ends[:0])
            groups = np.repeat([zlib.crc32(str(k).encode()) for k in b.column(b.schema.get_field_index("group")).to_pylist()], np.diff(ends))
            for i, m, tree in todo:
                s = m.setting
                g, h, loss = gradients(s.loss, m.score(x), y, w, pairs)
                if i in watched:
                    own = folds == m.watch
                    watched[i] += loss[own].sum(), w[own].sum()
                use = _drawn(groups, seed + 7919 * len(m.trees), s.rows) if s.rows < 1 else np.ones(len(x), bool)
                for out in (m.without, m.watch):
                    if out is not None:
                        use &= folds != out
                use &= (h > 0) | (g != 0)
                at = tree.nodes(x)
                use &= at >= first
                rows = np.flatnonzero(use)
                cells = first * width * bins
                if cells <= DENSE and i not in held:
                    held[i] = np.zeros((3, cells))
                for a in range(0, len(rows), max(1, CHUNK // width)):
                    r = rows[a : a + max(1, CHUNK // width)]
                    place = (((at[r] - first)[:, None] * width + np.arange(width)) * bins + x[r]).ravel()
                    if i not in held:
                        there, place = np.unique(place, return_inverse=True)
                    sums = [np.bincount(place, v, minlength=cells if i in held else 0) for v in (np.repeat(g[r], width), np.repeat(h[r], width), None)]
                    if i in held:
                        held[i] += sums
                    else:
                        yield from given(i, there, sums)
        for i, sums in held.items():
            there = np.flatnonzero(sums[2])
            yield from given(i, there, [v[there] for v in sums])
        for i, (loss, weight) in watched.items():
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (i, 0, -1, 0, float(loss), float(weight), 0)], names)

    return table.mapInArrow(work, "model long, node long, feature long, bin long, g double, h double, n long")


def best_splits(sums: DataFrame, models: Sequence[Model], allowed: Sequence[Sequence[int] | None]) -> DataFrame:
    """One row per model and node: its sums, and the split of the largest gain (equal to 9 digits: the smallest feature, then
    the smallest bin), null where none is allowed or gains."""
    spark = sums.sparkSession
    rule = spark.createDataFrame([(i, m.setting.l2, m.setting.l1, m.setting.least_rows, m.setting.least_weight) for i, m in enumerate(models)], "model long, l2 double, l1 double, least_rows long, least_weight double")
    whole = Window.partitionBy("model", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Dealt by node and feature, which serves the sums and the windows alike.
    hist = sums.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))
    run = hist.withColumns({f"{c}l": F.sum(c).over(upto) for c in ("g", "h", "n")}).withColumns({f"{c}t": F.sum(c).over(whole) for c in ("g", "h", "n")})
    run = run.withColumns({f"{c}r": F.col(f"{c}t") - F.col(f"{c}l") for c in ("g", "h", "n")}).join(F.broadcast(rule), "model")  # a row per model

    def worth(side: str) -> Column:
        g = F.col(f"g{side}")
        cut = F.signum(g) * F.greatest(F.abs(g) - F.col("l1"), F.lit(0.0))
        return cut * cut / F.nullif(F.col(f"h{side}") + F.col("l2"), F.lit(0.0))

    gain = F.round(worth("l") + worth("r") - worth("t"), 9)
    fits = (F.least("nl", "nr") >= F.col("least_rows")) & (F.least("hl", "hr") >= F.col("least_weight")) & (F.col("nr") > 0) & (gain > 1e-9)
    limited = [i for i, a in enumerate(allowed) if a is not None]
    if limited:
        may = spark.createDataFrame([(i, f, True) for i in limited for f in allowed[i]], "model long, feature long, may boolean")  # at most a row per model and feature
        run = run.join(may, ["model", "feature"], "left")
        fits = fits & (F.col("may") | ~F.col("model").isin(limited))
    split = F.when(fits, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "nl"))
    return run.groupBy("model", "node").agg(F.max(split).alias("s"), F.max_by(F.struct("gt", "ht", "nt"), F.col("feature")).alias("t")).select("model", "node", "t.*", "s.*")


def _tree(found: dict[int, dict], s: Setting) -> Tree:
    """The splits of the largest gains, from the root on, while leaves are allowed; a leaf's value from its sums."""
    size = 1 << (s.depth + 1)
    feature, cut, value = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64), np.zeros(size)

    def put(node: int, g: float, h: float) -> None:
        if h + s.l2 > 0:
            value[node] = -s.rate * math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2)

    if 1 in found:
        put(1, found[1]["gt"], found[1]["ht"])
    open_, leaves = [1], 1
    while s.leaves is None or leaves < s.leaves:
        ready = [n for n in open_ if n in found and found[n]["gain"] is not None]
        if not ready:
            break
        n = max(ready, key=lambda n: (found[n]["gain"], -n))
        r = found[n]
        feature[n], cut[n], value[n] = -r["f"], -r["b"], 0.0
        put(2 * n, r["gl"], r["hl"])
        put(2 * n + 1, r["gt"] - r["gl"], r["ht"] - r["hl"])
        open_.remove(n)
        open_ += [c for c in (2 * n, 2 * n + 1) if c < size // 2]
        leaves += 1
    return Tree(feature, cut, value, s.depth if (cut >= 0).any() else 0)


def _starts(table: DataFrame, models: Sequence[Model]) -> None:
    """Pointwise models begin at the log odds of the weights they train on, a pair's gap at none."""
    each = table.select("fold", F.explode("m").alias("m")).groupBy("fold").agg(F.sum(F.col("m.w") * F.col("m.y")).alias("p"), F.sum("m.w").alias("w")).collect()
    for m in models:
        rows = [r for r in each if r.fold not in (m.without, m.watch)]
        p, w = sum(r.p for r in rows), sum(r.w for r in rows)
        m.start = math.log(p / (w - p)) if m.setting.loss == LOGISTIC and 0 < p < w else 0.0


def train(table: DataFrame, models: Sequence[Model], width: int, bins: int, seed: int = 7) -> Sequence[Model]:
    """Grows the trees of all models on a table of `binned`; bins: places of a feature, missing included.

    A tree of depth d takes d passes over the table, for all models at once. A table without rows, or a fold without
    others, leaves models without trees' splits; sets without a case or without a control have no gradient under PAIRS."""
    _starts(table, models)
    while active := [i for i, m in enumerate(models) if not m.done and len(m.trees) < m.setting.rounds]:
        growing: list[Tree | None] = [None] * len(models)
        allowed: list[Sequence[int] | None] = [None] * len(models)
        found: dict[int, dict[int, dict]] = {i: {} for i in active}
        for i in active:
            s = models[i].setting
            growing[i] = _tree({}, s)
            if s.columns < 1:
                rng = np.random.default_rng([seed, i, len(models[i].trees)])
                allowed[i] = rng.choice(width, max(1, round(s.columns * width)), replace=False).tolist()
        for level in range(max(models[i].setting.depth for i in active)):
            sums = _histograms(table, models, growing, level, width, bins, seed)
            told = best_splits(sums, models, allowed).collect()
            for r in told:
                if r.node:
                    found[r.model][r.node] = r.asDict()
                else:
                    models[r.model].losses.append(r.gt / (r.ht or 1.0))
            for i in active:
                s = models[i].setting
                # Without a limit of leaves, so that every split that best-first growth may take is known.
                more = any(r.model == i and r.node and r.gain is not None for r in told) and level + 1 < s.depth
                growing[i] = _tree(found[i], replace(s, leaves=None)) if more else None
        for i in active:
            m = models[i]
            m.trees.append(_tree(found[i], m.setting))
            if m.losses and len(m.losses) - 1 - int(np.argmin(m.losses)) >= m.patience:
                m.done = True
    for m in models:
        if m.losses:
            m.trees = m.trees[: int(np.argmin(m.losses))] if m.done else m.trees
    return models


def scores(table: DataFrame, models: Sequence[Model], width: int, keep: Sequence[str]) -> DataFrame:
    """The members of a table of `binned`: its kept columns, y, fold, and an array of scores, one for each different
    setting in order: that of its model without the row's fold, or else of its model with all rows."""
    names = list(dict.fromkeys(m.setting.name for m in models))
    member = table.schema["m"].dataType.elementType
    schema = ", ".join([f"{c} {member[f'k_{c}'].dataType.simpleString()}" for c in keep] + ["y double, fold int, scores array<double>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y, _, folds, _, members = _matrix(b, width)
            out = np.zeros((len(x), len(names)))
            for m in models:
                own = np.ones(len(x), bool) if m.without is None else folds == m.without
                out[own, names.index(m.setting.name)] = m.score(x[own])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(members.field(f"k_{c}") for c in keep), pa.array(y), pa.array(folds.astype(np.int32)), flat], [*keep, "y", "fold", "scores"])

    return table.mapInArrow(work, schema)
