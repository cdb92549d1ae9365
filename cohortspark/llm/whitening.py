"""Whitening of embeddings: a compensated covariance in double-double arithmetic and its eigenvectors.

Sums and centred outer products are pairs of doubles, high and low part. Within a block of rows each centred entry is
split, without error, into slices of so few bits that products and sums of slices are exact in doubles (the error-free
transformation of a matrix product); slices' products join the pair by two-sums. Pairs of tasks are merged by two-sums,
a bounded number at a time, so what arrives at the driver is one pair of matrices. The eigen-solve there is LAPACK's
syevd: reduction to tridiagonal form, then divide and conquer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.types import ArrayType as Array

from .common import durable, own_names

SCALE, SHIFT, BLOCK, FAN_IN, COMPONENTS = 64, 1_000_000, 1024, 64, 16
WIDEST = 1 << 52  # whole doubles end at twice this
SLICES, BITS = 4, 21  # 2 * 21 bits and 10 for the rows of a block stay below 53

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as its rounded value and the error of the rounding."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(x: Pair, y: Pair) -> Pair:
    """The sum of two pairs."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def quotient(x: Pair, n: int) -> Pair:
    """A pair divided by a whole number."""
    q = x[0] / n
    p, e = two_product(q, float(n))
    rest = ((x[0] - p) - e) + x[1]
    return two_sum(q, rest / n)


def two_product(a: np.ndarray, b: np.ndarray | float) -> Pair:
    """a * b as its rounded value and the error of the rounding (Dekker's splitting)."""

    def halves(v: np.ndarray | float) -> tuple:
        c = 134217729.0 * v
        high = c - (c - v)
        return high, v - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def sliced(x: Pair) -> list[np.ndarray]:
    """Matrices that add up to a pair, each column a whole number of at most BITS bits times one power of two."""
    out, (high, low) = [], x
    top = np.abs(high).max(axis=0, initial=0.0)
    unit = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) - BITS + 1), 1.0)
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        high, low = two_sum(high - part, low)
        out.append(part)
        unit = unit * 2.0**-BITS
    return out


def outer(x: Pair) -> Pair:
    """The sum over the rows of a block of each row's outer product with itself. A product of two slices is exact; those
    below the last slice's size times the first's are left out, 2^-80 of the largest."""
    slices = sliced(x)
    dims = x[0].shape[1]
    total = (np.zeros((dims, dims)), np.zeros((dims, dims)))
    for i in range(SLICES):
        for j in range(SLICES - i):
            total = added(total, (slices[i].T @ slices[j], np.zeros((dims, dims))))
    return total


def total(x: Pair) -> Pair:
    """The sum over the rows of a block, by pairs of rows."""
    high, low = x
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.vstack([m, np.zeros((1, m.shape[1]))]) for m in (high, low))
        high, low = added((high[::2], low[::2]), (high[1::2], low[1::2]))
    return high[:1], low[:1]


def summed(rows: DataFrame, column: str, dims: int, of: Callable[[np.ndarray], Pair]) -> tuple[int, Pair]:
    """(number of rows, sum over all rows of `of` of the rows' vectors), `of` taking a block of rows to a matrix.

    Each task adds up its blocks; the tasks' matrices are merged FAN_IN at a time, row by row of the matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pair = 0, None
        for b in batches:
            whole = np.asarray(b.column(0).flatten()).reshape(-1, dims).astype(np.float64)
            for at in range(0, len(whole), BLOCK):
                own = of(whole[at : at + BLOCK])
                pair = own if pair is None else added(pair, own)
            n += len(whole)
        if pair is not None:
            size, task = len(pair[0]), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [task] * size, "i": list(range(size)), "n": [n] * size, "high": list(pair[0]), "low": list(pair[1])}, schema=ARROW)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        pair = (group["high"].iloc[0], group["low"].iloc[0])
        for high, low in zip(group["high"].iloc[1:], group["low"].iloc[1:], strict=True):
            pair = added(pair, (high, low))
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "i": [group["i"].iloc[0]], "n": [group["n"].sum()], "high": [pair[0]], "low": [pair[1]]})

    kind = "part long, i long, n long, high array<double>, low array<double>"
    parts = durable(rows.select(column).mapInArrow(work, kind))
    while (tasks := parts.agg(F.countDistinct("part")).first()[0]) > 1:
        parts = durable(parts.groupBy("i", F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(merged, kind))
    if not tasks:
        return 0, (np.zeros((0, dims)), np.zeros((0, dims)))
    got = parts.orderBy("i").collect()
    return got[0].n, (np.array([r.high for r in got]), np.array([r.low for r in got]))


ARROW = pa.schema([("part", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Whitening:
    """What `fit` found: n vectors of the fit list, their sums per dimension, mean (a pair), components as columns by
    falling eigenvalue, those eigenvalues, their shares of the trace, and the largest error of the identity."""

    n: int
    sums: list[int]
    mean: Pair
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of a block of x vectors."""
        return (((x - self.mean[0]) - self.mean[1]) @ self.vectors) / np.sqrt(self.values)


@own_names
def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds _x, the vector's entries c as floor(64 * c) + 1000000, and drops rows that take no part: a null vector, null or
    non-finite entries, no entries, or another number of entries than most rows have (of equal counts the larger number
    stands). Entries beyond 2^52 / 64 are held to that."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    valid = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    sizes = valid.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    held = lambda c: F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), F.floor(c.cast("double") * SCALE).cast("double")))
    return valid.where(F.size(vector) == (sizes["size"] if sizes else 0)).withColumn("_x", F.transform(vector, lambda c: held(c).cast("long") + SHIFT))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table with _x (of `whole_vectors`): each different _x counts once, whatever its copies. None
    where there is no row. Components without variance, to the precision of doubles, are left out."""
    listed = durable(rows.select("_x").distinct())
    first = listed.first()
    if first is None:
        return None
    dims = len(first[0])
    zero = lambda x: (x, np.zeros_like(x))
    n, sums = summed(listed, "_x", dims, lambda x: total(zero(x)))
    mean = quotient((sums[0][0], sums[1][0]), n)
    centred = lambda x: two_sum(*(lambda s: (s[0], s[1] - mean[1]))(two_sum(x, -mean[0])))
    _, moments = summed(listed, "_x", dims, lambda x: outer(centred(x)))
    covariance = quotient(moments, n)[0]
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * dims * np.finfo(float).eps]
    values, vectors = values[order], vectors[:, order]
    whole = [int(a) + int(b) for a, b in zip(sums[0][0], sums[1][0], strict=True)]
    found = Whitening(n, whole, mean, vectors, values, values / np.trace(covariance) if len(values) else values, 0.0)
    error = 0.0
    if len(values):
        _, own = summed(listed, "_x", dims, lambda x: total(zero(found.project(x))))
        middle = quotient((own[0][0], own[1][0]), n)
        _, spread = summed(listed, "_x", dims, lambda x: outer(zero((found.project(x) - middle[0]) - middle[1])))
        error = float(np.abs(quotient(spread, n)[0] - np.eye(len(values))).max())
    return Whitening(found.n, found.sums, found.mean, found.vectors, found.values, found.explained, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - sum)^2 for each row, exact."""
    about = x * float(n) - np.array(sums, dtype=np.float64)
    fits = ((about * about).sum(axis=1) < 2.0**62) & (np.abs(x).max(axis=1, initial=0.0) * n < 2.0**62) & (max(map(abs, sums), default=0) < 1 << 62)
    out: list[int] = []
    small = np.zeros(len(x), dtype=np.int64)
    if fits.any():
        away = x[fits].astype(np.int64) * n - np.array(sums, dtype=np.int64)
        small[fits] = (away * away).sum(axis=1)
    for i, ok in enumerate(fits.tolist()):
        out.append(int(small[i]) if ok else sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums, strict=True)))
    return out


@own_names
def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows that take part (see `whole_vectors`), with whitened (array of double, a value for each component), deviation
    (decimal(38, 0), null where it has more digits) and the same n, explained (array) and identity_error for all rows.

    Repeated rows are whitened alike, each different vector having counted once; the other columns are carried along, those
    with the added names replaced; an empty table, or one without a valid vector, gives no row. Where all vectors are equal
    there is no component and whitened is empty."""
    added_names = ["whitened", "deviation", "n", "explained", "identity_error"]
    valid = durable(whole_vectors(rows.drop(*(c for c in added_names if c != vector)), vector))
    found = fit(valid, components)
    kept = [f for f in valid.schema.fields if f.name not in ("_x", *added_names)]
    schema = StructType(list(kept)).add("whitened", Array(DoubleType())).add("deviation", StringType())
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(b.schema.get_field_index("_x")).flatten()).reshape(b.num_rows, -1).astype(np.float64)
            own = [pa.array(list(found.project(x)), pa.list_(pa.float64())), pa.array(list(map(str, deviations(x, found.n, found.sums))), pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *own], [*names, "whitened", "deviation"])

    out = valid.mapInArrow(work, schema) if found else rows.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(x)) for x in found.explained)) if found else F.array()
    return out.withColumns({"deviation": F.expr("try_cast(deviation as decimal(38, 0))"), "n": F.lit(found.n if found else 0).cast("long"), "explained": explained.cast("array<double>"), "identity_error": F.lit(found.identity_error if found else 0.0)})
