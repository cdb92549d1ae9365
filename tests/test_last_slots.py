"""The tensor reads the grid's last slots only."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from cohortspark.operators import temporal as T
from cohortspark.plans import representation, windows
from cohortspark.registry import Tables

SF = "/root/testdata/sf0.001"


def test_last_span_ends_with_the_table_and_does_not_begin_before_it(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 05:40:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert T.last_span(events, "ts", 3) == ("2024-01-01 04:30:00", "2024-01-01 05:30:00")
    assert T.last_span(events, "ts", 100) == T.span(events, "ts") == ("2024-01-01 00:00:00", "2024-01-01 05:30:00")


def test_tensor_is_made_of_its_last_slots_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(representation, "rain", lambda t, last=None: asked.append(last) or windows.rain(t, last))
    n = representation.tensor(Tables(spark, SF)).count()
    assert asked == [309] and n == Tables(spark, SF).events.select("user_id").distinct().count()


@pytest.mark.parametrize("name", ["sp16_rain_tensor", "sp20_content_replay"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rows = con.sql(e.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in e.queries()[name](spark, SF).collect()]
    assert len(got) == len(rows)
    for a, b in zip(sorted(got), sorted(rows), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=0.011)
