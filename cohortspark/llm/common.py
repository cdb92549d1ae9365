"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import durable, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fits_broadcast(rows: int, row_bytes: int, limit: int = 32 << 20) -> bool:
    return rows * row_bytes <= limit


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body uses it and wherever the optimiser moves it."""
    return F.transform(F.array(value), body)[0]


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator on a table: its inner columns begin with an underscore, so columns of the table that do are given
    other names before and their own names afterwards. Arguments that name such columns are changed alike."""

    @wraps(operator)
    def run(docs: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        other: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("_"):
                other[c] = next(n for i in range(len(taken) + len(other) + 1) if (n := f"kept{i}{c}") not in taken and n not in other.values())
        if not other:
            return operator(docs, *args, **kwargs)
        named = lambda x: other.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(other), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def running(values: Column, op: Callable[[Column, Column], Column], chunk: int = 128) -> Column:
    """op over each head of an array<int>, beginning at 0: running sums or maxima. Results are appended in chunks, whose
    last ones are brought together alike: an append copies an array, so one fold over all would take quadratic time."""
    kind = "array<int>"

    def heads(a: Column) -> Column:
        return F.aggregate(a, F.array().cast(kind), lambda s, x: F.concat(s, F.array(op(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)), x))))

    def joined(chunks: Column) -> Column:
        return let(
            F.transform(chunks, heads),
            lambda own: let(
                F.struct(own.alias("own"), heads(F.transform(own, lambda c: F.get(c, F.size(c) - 1))).alias("last")),
                lambda p: F.flatten(F.transform(p["own"], lambda c, i: F.transform(c, lambda x: op(F.coalesce(F.get(p["last"], i - 1), F.lit(0)), x)))),
            ),
        )

    def cut(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda i: F.slice(a, i * chunk + 1, chunk))

    return let(values, lambda a: F.when(F.size(a) > 0, joined(cut(a))).otherwise(F.array().cast(kind)))
