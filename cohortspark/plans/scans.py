"""Scans and sinks (SC)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import durable, shared_folder
from ..registry import Tables, query
from ..sources import tables as S


@query("sc1_csv_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_round_trip(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}.csv"
    S.write_table(t.nation, path)
    return S.read_table(t.spark, path, ["n_nationkey", "n_name"], "n_nationkey bigint, n_name string, n_regionkey int")


@query("sc2_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def projection(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_quantity").where("l_quantity > 45")


@query("sc3_partitioned_predicate", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def partitioned_predicate(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}.parquet"
    S.write_table(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), path, ["o_orderstatus"])
    part = t.spark.read.parquet(path).where(F.col("o_orderstatus").isin("F", "P"))
    return part.where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_orderstatus")


@query("sc4_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"))


@query("sc5_candidates_of_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0)")
def candidates_of_keys(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(keys, "l_orderkey", "left_semi")


@query(
    "sc6_duplicate_audit",
    "SELECT count(*) AS n, count(DISTINCT (user_id, ts)) AS n_keys, (count(*) - count(DISTINCT (user_id, ts)))::BIGINT AS n_repeats, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM events",
)
def duplicate_audit(t: Tables) -> DataFrame:
    keys = t.events.groupBy("user_id", "ts").agg(F.count("*").alias("n"))
    out = keys.agg(F.sum("n").alias("n"), F.count("*").alias("n_keys"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.select("n", "n_keys", (F.col("n") - F.col("n_keys")).alias("n_repeats"), F.col("a").cast("string").alias("first_ts"), F.col("b").cast("string").alias("last_ts"))


@query("sc7_vector_arrays", "SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vector_arrays(t: Tables) -> DataFrame:
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 5).alias("total"))


@query("sc10_schema_lookup", "SELECT 'o_orderkey' AS field, 'bigint' AS type UNION ALL SELECT 'o_totalprice', 'double' UNION ALL SELECT 'o_orderstatus', 'string'")
def schema_lookup(t: Tables) -> DataFrame:
    return S.facts(t.orders).where(F.col("field").isin("o_orderkey", "o_totalprice", "o_orderstatus")).select("field", "type")


# Where orders are: by four fields, under their names in any table, and the ids that line items ask for.
ORDER_FIELDS = {"order": ("o_orderkey", "l_orderkey", "order_id"), "customer": ("o_custkey", "c_custkey", "customer_id"), "total": ("o_totalprice", "total"), "date": ("o_orderdate", "order_date")}
_HELD = {"orders": ("o_orderkey", 4), "lineitem": ("l_orderkey", 1), "customer": (None, 1), "part": (None, 0), "supplier": (None, 0), "events": (None, 0), "documents": (None, 0), "pages": (None, 0)}
_HELD_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS source, {k}::BIGINT AS fields, (SELECT count(*) FROM {n}) AS rows, "
    + (f"(SELECT count(DISTINCT {c}) FROM {n} WHERE {c} IN (SELECT id FROM asked)) / (SELECT count(*) FROM asked)::DOUBLE" if c else "0::DOUBLE")
    + " AS known"
    for n, (c, k) in _HELD.items()
)


@query(
    "sc10_source_discovery",
    f"""WITH asked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 25), f AS ({_HELD_SQL}), s AS (SELECT *, 0.6::DOUBLE * fields / 4 + 0.4::DOUBLE * known AS score FROM f)
SELECT source, fields, rows, round(known, 6) AS known, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, rows DESC, source) - 1 AS place FROM s""",
)
def source_discovery(t: Tables) -> DataFrame:
    found = S.discover({n: getattr(t, n) for n in _HELD}, ORDER_FIELDS, "order", t.lineitem.where("l_quantity > 25").select("l_orderkey"))
    return found.select("source", "fields", "rows", F.round("known", 6).alias("known"), F.round("score", 6).alias("score"), "place")


@query("sc11_alias_columns", "SELECT c_custkey AS unit_id, c_acctbal AS balance FROM customer")
def alias_columns(t: Tables) -> DataFrame:
    return S.resolve(t.customer, {"unit_id": ["id", "C-CustKey"], "balance": ["C_ACCTBAL"]}).select("unit_id", "balance")


@query("sc12_json_sink", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_sink(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}.json"
    S.write_table(t.region, path)
    return S.read_table(t.spark, path, ["r_regionkey", "r_name"], "r_regionkey bigint, r_name string")


@query("sc13_row_signature", "SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(md5(n_nationkey::VARCHAR || chr(31) || n_name), {1 + 8 * i}, 8))::BIGINT)::BIGINT AS h{i}" for i in range(4)) + " FROM nation")
def row_signature(t: Tables) -> DataFrame:
    return S.signature(t.nation, ["n_nationkey", "n_name"])


@query("sc13_file_manifest")
def file_manifest(t: Tables) -> DataFrame:
    return S.file_manifest(t.spark, f"{t.sf_dir}/region.parquet")


@query("sc14_signed_result", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def signed_result(t: Tables) -> DataFrame:
    key = S.signature(t.orders, ["o_orderkey", "o_orderstatus"])
    return S.kept_result(t.spark, f"{shared_folder(t.spark)}/signed", key, lambda: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("sc14_checkpoint", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def checkpointed(t: Tables) -> DataFrame:
    return durable(t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")))
