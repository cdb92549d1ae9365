"""Robust and standard scaling; parameters are small tables, fitted once and applied to any pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import quantiles


def robust_params(df: DataFrame, cols: Sequence[str], log1p: Sequence[str] = ()) -> DataFrame:
    """One row: med_x and iqr_x of each column, exact, nulls and NaN left out."""
    found = quantiles(df, {c: F.log1p(F.col(c)) if c in log1p else F.col(c) for c in cols}, [0.25, 0.5, 0.75])
    row = [q[1] for q in found.values()] + [None if q[0] is None else q[2] - q[0] for q in found.values()]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join([*(f"med_{c} double" for c in cols), *(f"iqr_{c} double" for c in cols)]))


def robust_apply(df: DataFrame, params: DataFrame, cols: Sequence[str], log1p: Sequence[str] = (), zero_iqr: str = "drop") -> DataFrame:
    """Adds z_x. Where the IQR is 0: "drop" gives null, "one" takes 1 in its place, "zero" gives 0."""
    out = df.join(F.broadcast(params.limit(1)))  # one row
    for c in cols:
        x = (F.log1p(F.col(c)) if c in log1p else F.col(c)) - F.col(f"med_{c}")
        iqr = F.col(f"iqr_{c}")
        flat = {"drop": F.lit(None).cast("double"), "one": x, "zero": F.lit(0.0)}[zero_iqr]
        out = out.withColumn(f"z_{c}", F.when(iqr > 0, x / F.nullif(iqr, F.lit(0.0))).otherwise(flat))
    return out.drop(*params.columns)


def standard_params(df: DataFrame, cols: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row: mean_x and sd_x (population; 1 where below floor)."""
    sd = {c: F.stddev_pop(c) for c in cols}
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.when(sd[c] < floor, 1.0).otherwise(sd[c]).alias(f"sd_{c}") for c in cols])


def standard_apply(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = df.join(F.broadcast(params.limit(1)))  # one row
    return out.withColumns({f"s_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in cols}).drop(*params.columns)
