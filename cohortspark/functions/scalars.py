"""Scalar expressions, with the rules for nulls and NaN in one place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, and for yes.
NULL_TOKENS = ("", "nan", "none", "null", "<na>", "nat")
YES = ("YES", "TRUE", "1", "Y", "T")


def number(c: Column) -> Column:
    """A text as double; what is no number, and NaN, becomes null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def cleaned(c: Column) -> Column:
    """Trimmed text; tokens for a missing value become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def truthy(c: Column) -> Column:
    """Numbers above 0 and the words for yes; all else, null too, is false."""
    t = F.upper(F.trim(c.cast("string")))
    return F.coalesce(t.isin(*YES) | (t.try_cast("double") > 0), F.lit(False))


def normal_id(c: Column) -> Column:
    """Trimmed id without the .0 that a float leaves behind."""
    return F.regexp_replace(F.trim(c), r"^(-?[0-9]+)\.0$", "$1")


def choose(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(default)
    for cond, value in reversed(cases):
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def reasons(*cases: tuple[Column, str], by: str = ";") -> Column:
    """Codes of all cases that hold, in order."""
    return F.concat_ws(by, *[F.when(cond, code) for cond, code in cases])


def right_closed_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label i for edges[i] < x <= edges[i + 1]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > lo) & (c <= hi), label).otherwise(out)
    return out


def row_mean(*cols: Column) -> Column:
    """Mean of what is not null; null if nothing is."""
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]) / F.nullif(n, F.lit(0))


def argmax_name(*names: str) -> Column:
    """Name of the largest column, the first by name if tied; null if all are null."""
    best = F.array_min(F.filter(F.array(*[F.struct((-F.col(n)).alias("v"), F.lit(n).alias("n")) for n in sorted(names)]), lambda s: s["v"].isNotNull()))
    return best["n"]


def missing_pattern(*names: str) -> Column:
    """First 16 hex digits of the SHA-256 of a byte per column, 01 where it is null and 00 elsewhere."""
    bits = F.concat(*[F.when(F.col(n).isNull(), "01").otherwise("00") for n in names])
    return F.substring(F.sha2(F.unhex(bits), 256), 1, 16)


def sigmoid(c: Column, clip: float = 60.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), c))))


def logit(c: Column, clip: float = 1e-6) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), c))
    return F.log(p / (1.0 - p))


def rounded(c: Column, digits: int = 6) -> Column:
    """A double with so many decimals, and no negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded_as_sql(c: Column, digits: int = 6) -> Column:
    """Rounded as SQL engines on doubles do: the scaled double, half away from zero. F.round takes the shortest decimal
    digits instead, and differs where these end in a 5 that the double is not quite."""
    return F.round(c.cast("double") * 10.0**digits) / 10.0**digits
