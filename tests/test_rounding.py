"""Rounding as SQL does."""

from pyspark.sql import functions as F

from cohortspark.functions.scalars import rounded_as_sql


def test_rounded_as_sql(spark):
    import duckdb

    values = [(2 * i + 1) / 2e6 * s for i in range(0, 900000, 907) for s in (1, -1)] + [0.0, 1.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded_as_sql(F.col("x"))).collect()]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", params=[values]).fetchall()]
    assert got == want
