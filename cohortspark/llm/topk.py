"""Exact top-k by inner product: paged M-trees, searched best-first under stored triangle-inequality bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fits_broadcast

SLACK = 1e-9  # relative; distances are floats, scores are exact integers
LEAST = -(2**62)  # below any score
NONE = LEAST - 1


def quantised(df: DataFrame, vec_id: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, v: array<double> of integers, norm: its squared length) of the vectors that take part: not null and
    without null or non-finite components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = df.select(F.col(vec_id).alias("vec_id"), v.alias("x")).where(F.col("x").isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    q = q.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return q.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def stacked(rows: pd.Series, dim: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are padded with zeros, which leaves inner products as they are."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where no partial sum can pass 2 ** 53, else in int64."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if top < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


class MTree:
    """One block of rows in the space where inner products are distances.

    Row x gets one coordinate more, sqrt(R - |x|^2), R the largest squared length anywhere; queries get a zero. Then
    d(q, x)^2 = |q|^2 + R - 2 q.x, so the best scores are the nearest rows. Leaves are pages of rows around a routing
    row, with their distances to it and the covering radius; inner nodes cover leaves likewise."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, reach: float, page: int = 256, fan: int = 8) -> None:
        lifted = np.concatenate([v, np.sqrt(np.maximum(reach - (v * v).sum(1), 0))[:, None]], axis=1)
        self.ids, self.v, self.pages = ids, v, []
        heap = [np.arange(len(ids))]
        while heap:  # halve by the nearer of two far rows, until a part fits a page
            part = heap.pop()
            d0 = self._to(lifted[part], lifted[part[0]])
            if len(part) <= page or not d0.max() > 0:
                for at in range(0, len(part), page):
                    self._page(part[at : at + page], lifted)
                continue
            a = part[d0.argmax()]
            da = self._to(lifted[part], lifted[a])
            near = da <= self._to(lifted[part], lifted[part[da.argmax()]])
            heap += [part[near], part[~near]] if 0 < near.sum() < len(part) else [part[: len(part) // 2], part[len(part) // 2 :]]
        self.centres = np.stack([c for _, c, _, _ in self.pages])
        self.radii = np.array([r for _, _, r, _ in self.pages])
        self.inner = []
        for at in range(0, len(self.pages), fan):
            own = np.arange(at, min(at + fan, len(self.pages)))
            to = self._to(self.centres[own], self.centres[at])
            self.inner.append((self.centres[at], float((to + self.radii[own]).max()), own, to))

    @staticmethod
    def _to(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.sqrt(((rows - one) ** 2).sum(1))

    def _page(self, part: np.ndarray, lifted: np.ndarray) -> None:
        mean = lifted[part].mean(0)
        centre = lifted[part[self._to(lifted[part], mean).argmin()]]
        d = self._to(lifted[part], centre)
        by = d.argsort(kind="stable")
        self.pages.append((part[by], centre, float(d.max()), d[by]))

    def search(self, qids: np.ndarray, q: np.ndarray, norms: np.ndarray, reach: float, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of each query's best k rows here that score `floor` or more; ignore places with lower scores.

        All queries go through their pages together, each in its own best-first order: in turn j a query visits its
        jth nearest page, unless the page cannot beat its kth score."""
        n, none = len(q), NONE
        lifted = np.concatenate([q, np.zeros((n, 1))], axis=1)
        top_ids, top = np.full((n, k), -1, dtype=np.int64), np.full((n, k), none, dtype=np.int64)
        low = floor.astype(np.float64)
        slack = SLACK * (norms + reach + 1)

        def radius(rows: np.ndarray) -> np.ndarray:
            """No row farther off than this can still enter."""
            return np.sqrt(np.maximum(norms[rows] + reach - 2 * low[rows], 0) + slack[rows])

        every = np.arange(n)
        least = np.full((n, len(self.pages)), np.inf)
        for centre, cover, own, to in self.inner:
            d = self._to(lifted, centre)
            open_ = every[d - cover <= radius(every)]  # else the whole node is too far
            if not len(open_):
                continue
            maybe = np.abs(d[open_, None] - to[None, :]) - self.radii[own][None, :] <= radius(open_)[:, None]  # by stored parent distances
            rows = open_[maybe.any(1)]
            if len(rows):
                exact = np.sqrt(np.maximum(((lifted[rows] ** 2).sum(1)[:, None] + (self.centres[own] ** 2).sum(1)[None, :] - 2 * lifted[rows] @ self.centres[own].T), 0))
                least[np.ix_(rows, own)] = np.where(maybe[maybe.any(1)], np.maximum(exact - self.radii[own][None, :] - 1e-6 * (1 + exact), 0), np.inf)
        order = least.argsort(axis=1, kind="stable")
        for turn in range(len(self.pages)):
            page = order[:, turn]
            bound = least[every, page]
            alive = every[np.isfinite(bound) & (bound <= radius(every))]
            if not len(alive):
                if not np.isfinite(least[every, page]).any():
                    break
                continue
            for p in np.unique(page[alive]):
                rows = alive[page[alive] == p]
                part, centre, _, away = self.pages[p]
                d, r = self._to(lifted[rows], centre), radius(rows)
                lo, hi = np.searchsorted(away, (d - r).min() * (1 - 1e-9) - 1e-6), np.searchsorted(away, (d + r).max() * (1 + 1e-9) + 1e-6, side="right")
                part = part[lo:hi]
                if not len(part):
                    continue
                s = products(q[rows], self.v[part])
                s[qids[rows][:, None] == self.ids[part][None, :]] = none
                ids = np.concatenate([top_ids[rows], np.broadcast_to(self.ids[part], s.shape)], axis=1)
                s = np.concatenate([top[rows], s], axis=1)
                best = np.lexsort((ids, -s), axis=1)[:, :k] if s.shape[1] <= 4 * k else self._best(ids, s, k)
                top_ids[rows], top[rows] = np.take_along_axis(ids, best, 1), np.take_along_axis(s, best, 1)
                full = top[rows, k - 1] != none
                low[rows[full]] = np.maximum(low[rows[full]], top[rows[full], k - 1])
        return top_ids, top

    @staticmethod
    def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best by score, then smaller id; a partition first narrows each row to scores that can win."""
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        width = int((s >= kth).sum(1).max())
        some = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
        inner = np.lexsort((np.take_along_axis(ids, some, 1), -np.take_along_axis(s, some, 1)), axis=1)[:, :k]
        return np.take_along_axis(some, inner, 1)


def top_k(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, block_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by `every`.

    Rows fall into blocks by their nearest pivot (pivots: rows of a seeded sample of about `sample_rows`, twice as many
    at most), hot blocks are cut by a hash of the row; a table of blocks with radii is the root page. A query's kth score
    within the sample bounds its result from below, so it goes only to blocks that can beat it. Queries are dealt into
    chunks of neighbours, those of one pivot, and a block is sent to the chunks that reach it and no others; a task
    holds about block_rows rows and query_rows queries. Ties go to the smaller id. Null ids and vectors that are null
    or hold null or non-finite components take no part; shorter vectors count as padded with zeros, empty ones score 0
    everywhere. Of rows that repeat an id, that with the least vector is the query; its candidates are all rows with
    another id, repeats included. Scores are exact while they fit a long. An empty table gives an empty one."""
    spark = df.sparkSession
    q = durable(quantised(df, vec_id, vector))
    facts = q.agg(F.count("*").alias("n"), F.max("norm").alias("reach"), F.max(F.size("v")).alias("dim")).first()
    n, reach, dim = facts["n"], facts["reach"] or 0.0, max(facts["dim"] or 0, 1)
    sample = q.sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=3).limit(2 * sample_rows).toPandas().sort_values("vec_id", kind="stable")
    sample = sample.sample(frac=1.0, random_state=3)
    s_ids, s_v = sample["vec_id"].to_numpy(dtype=np.int64), stacked(sample["v"], dim)
    count = int(min(max(1, -(-n // block_rows)), max(1, len(s_ids))))
    lift = lambda v, norm: np.concatenate([v, np.sqrt(np.maximum(reach - norm, 0))[:, None]], axis=1)
    pivots = lift(s_v, (s_v * s_v).sum(1))[:count] if len(s_ids) else np.zeros((1, dim + 1))

    def distances(lifted: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * lifted @ pivots.T, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = distances(lift(stacked(b["v"], dim), b["norm"].to_numpy()))
            yield b.assign(pivot=d.argmin(1), away=d.min(1) if len(d) else [])

    placed = durable(q.mapInPandas(place, "vec_id long, v array<double>, norm double, pivot int, away double").withColumn("u", F.monotonically_increasing_id()))
    asked = F.count_if(F.col("vec_id") % every == 0).alias("queries")
    stats = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius"), asked).toPandas()  # a row per pivot
    radius = np.full(len(pivots), -np.inf)
    radius[stats["pivot"]] = stats["radius"]
    cuts = np.ones(len(pivots), dtype=np.int64)
    cuts[stats["pivot"]] = -(-stats["n"].to_numpy() // block_rows)
    parts = np.ones(len(pivots), dtype=np.int64)
    parts[stats["pivot"]] = np.maximum(1, -(-stats["queries"].to_numpy() // query_rows))
    most_parts = int(parts.max())

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, norm = stacked(b["v"], dim), b["norm"].to_numpy()
            ids = b["vec_id"].to_numpy(dtype=np.int64)
            s = products(v, s_v).astype(np.float64)
            s[ids[:, None] == s_ids[None, :]] = -np.inf
            floor = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] >= k else np.full(len(b), -np.inf)
            floor = np.where(np.isfinite(floor), floor, float(LEAST))
            most = np.sqrt(np.maximum(norm + reach - 2 * floor, 0) + SLACK * (norm + reach + 1))
            d = distances(lift(v, np.full(len(v), reach)))
            reached = d - radius[None, :] <= most[:, None] * (1 + 1e-9) + 1e-6 * (1 + d)
            chunk = b["home"].to_numpy() * most_parts + b["h"].to_numpy() % parts[b["home"]]
            yield b.assign(floor=floor.astype(np.int64), pivots=[np.flatnonzero(r) for r in reached], chunk=chunk)[["vec_id", "v", "norm", "floor", "pivots", "chunk"]]

    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm", F.col("pivot").alias("home"))).alias("q"))
    queries = queries.select("vec_id", "q.v", "q.norm", "q.home", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("h"))
    queries = queries.mapInPandas(route, "vec_id long, v array<double>, norm double, floor long, pivots array<int>, chunk long")
    queries = queries.select("vec_id", "v", "norm", "floor", F.explode("pivots").alias("pivot"), "chunk")
    cut = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cuts)], "pivot int, cuts int")
    cut = F.broadcast(cut) if fits_broadcast(len(cuts), 16) else cut
    queries = durable(queries.join(cut, "pivot").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts"))
    filled = durable(queries.select("pivot", "cut", "chunk").distinct())
    rows = placed.join(cut, "pivot").withColumn("cut", F.pmod(F.xxhash64("u", "vec_id"), F.col("cuts")).cast("int"))
    rows = rows.select("vec_id", "v", "pivot", "cut").join(filled, ["pivot", "cut"])

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        tree = MTree(rows["vec_id"].to_numpy(dtype=np.int64), stacked(rows["v"], dim), reach)
        qids = queries["vec_id"].to_numpy(dtype=np.int64)
        ids, scores = tree.search(qids, stacked(queries["v"], dim), queries["norm"].to_numpy(), reach, k, queries["floor"].to_numpy())
        used = scores.ravel() >= np.repeat(queries["floor"].to_numpy(), k)
        return pd.DataFrame({"query_id": np.repeat(qids, k)[used], "vec_id": ids.ravel()[used], "score": scores.ravel()[used]})

    cells = ["pivot", "cut", "chunk"]
    found = queries.groupBy(*cells).cogroup(rows.groupBy(*cells)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
