"""Projections, predicates and classification (PR)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.statistics import quantiles
from ..registry import Tables, query
from .cohort import MEMBERS_SQL, SETSCORE_SQL, UNITS_SQL, set_scores, units


@query("pr1_select_rename", "SELECT c_custkey AS unit_id, c_acctbal AS balance, c_acctbal * 2 AS twice FROM customer")
def select_rename(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_name", "c_acctbal").withColumnsRenamed({"c_custkey": "unit_id", "c_acctbal": "balance"})
    return df.drop("c_name").withColumn("twice", F.col("balance") * 2)


@query("pr2_conjunction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_discount >= 0.05 AND l_extendedprice < 20000 AND l_tax <= 0.04")
def conjunction(t: Tables) -> DataFrame:
    keep = (F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05) & (F.col("l_extendedprice") < 20000) & (F.col("l_tax") <= 0.04)
    return t.lineitem.where(keep).select("l_orderkey", "l_linenumber")


@query("pr3_membership", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def membership(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("pr4_first_match", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS class FROM orders")
def first_match(t: Tables) -> DataFrame:
    cls = S.choose((F.col("o_totalprice") > 200000, "large"), (F.col("o_orderpriority").like("1%"), "urgent"), (F.col("o_orderstatus") == "F", "done"), default="other")
    return t.orders.select("o_orderkey", cls.alias("class"))


@query("pr5_reasons", "SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 200000 THEN 'LARGE' END, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'LOW' END) AS reasons FROM orders")
def reasons(t: Tables) -> DataFrame:
    r = S.reasons((F.col("o_totalprice") > 200000, "LARGE"), (F.col("o_orderstatus") == "P", "PENDING"), (F.col("o_orderpriority").like("5%"), "LOW"))
    return t.orders.select("o_orderkey", r.alias("reasons"))


TRANSITION_SQL = "CASE WHEN NOT a AND b THEN 'corrected' WHEN a AND b THEN 'retained' WHEN a AND NOT b THEN 'lost' ELSE 'unresolved' END"


@query("pr6_transitions", f"WITH {SETSCORE_SQL} SELECT set_id, {TRANSITION_SQL} AS transition FROM (SELECT set_id, raw_p > greatest(raw_1, raw_2) AS a, ctx_p > greatest(ctx_1, ctx_2) AS b FROM setscore)")
def transitions(t: Tables) -> DataFrame:
    a, b = F.col("raw_p") > F.greatest("raw_1", "raw_2"), F.col("ctx_p") > F.greatest("ctx_1", "ctx_2")
    return set_scores(t).select("set_id", S.choose((~a & b, "corrected"), (a & b, "retained"), (a & ~b, "lost"), default="unresolved").alias("transition"))


MESSY = "CASE o_orderkey % 8 WHEN 0 THEN ' yes' WHEN 1 THEN 'No' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'nan' WHEN 5 THEN NULL WHEN 6 THEN '2.5' ELSE 'T ' END"


@query("pr7_truthy", f"SELECT o_orderkey, coalesce(upper(trim(m)) IN ('YES','TRUE','1','Y','T') OR TRY_CAST(trim(m) AS DOUBLE) > 0 AND NOT isnan(TRY_CAST(trim(m) AS DOUBLE)), FALSE) AS flag FROM (SELECT o_orderkey, {MESSY} AS m FROM orders)")
def truthy(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.expr(MESSY).alias("m"))
    return df.select("o_orderkey", S.truthy(S.cleaned(F.col("m"))).alias("flag"))


@query("pr8_normal_ids", r"SELECT o_orderkey, regexp_replace(trim(' ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.0 ' ELSE '' END), '^(-?[0-9]+)\.0$', '\1') AS id FROM orders")
def normal_ids(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0 ").otherwise(""))
    return t.orders.select("o_orderkey", S.normal_id(raw).alias("id"))


@query("pr9_null_tokens", f"SELECT o_orderkey, CASE WHEN lower(trim(m)) IN ('', 'nan', 'none', 'null', '<na>', 'nat') THEN NULL ELSE trim(m) END AS v FROM (SELECT o_orderkey, {MESSY} AS m FROM orders)")
def null_tokens(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.cleaned(F.expr(MESSY)).alias("v"))


@query("pr10_roles", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'positive' WHEN o_orderstatus = 'O' THEN 'control' END AS role FROM orders")
def roles(t: Tables) -> DataFrame:
    word = F.lower(F.trim(F.when(F.col("o_orderstatus") == "F", " Case").when(F.col("o_orderstatus") == "O", "CONTROL ").otherwise("?")))
    role = S.choose((word.isin("positive", "case", "1"), "positive"), (word.isin("control", "negative", "0"), "control"))
    return t.orders.select("o_orderkey", role.alias("role"))


@query("pr11_hierarchy", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'HEAVY' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'HOME' ELSE 'OTHER' END AS parent FROM customer")
def hierarchy(t: Tables) -> DataFrame:
    parents = F.create_map(*[F.lit(x) for kv in {"AUTOMOBILE": "HEAVY", "MACHINERY": "HEAVY", "BUILDING": "HOME", "FURNITURE": "HOME"}.items() for x in kv])
    return t.customer.select("c_custkey", F.coalesce(parents[F.col("c_mktsegment")], F.lit("OTHER")).alias("parent"))


@query("pr12_dominant", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax AND l_discount >= q THEN 'l_discount' WHEN l_tax >= q THEN 'l_tax' ELSE 'q' END AS top FROM (SELECT *, l_quantity / 500 AS q FROM lineitem)")
def dominant(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("q", F.col("l_quantity") / 500)
    return df.select("l_orderkey", "l_linenumber", S.argmax_name("l_discount", "l_tax", "q").alias("top"))


@query("pr13_missing_pattern", "SELECT o_orderkey, substr(sha256(unhex((CASE WHEN o_orderkey % 3 = 0 THEN '01' ELSE '00' END) || (CASE WHEN o_orderkey % 5 = 0 THEN '01' ELSE '00' END))), 1, 16) AS pattern FROM orders")
def missing_pattern(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, 1).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, 1).alias("b"))
    return df.select("o_orderkey", S.missing_pattern("a", "b").alias("pattern"))


@query("pr14_completeness", "SELECT o_orderkey, CASE WHEN n = 0 THEN 'NONE' WHEN n = 3 THEN 'ALL' ELSE 'PARTIAL' END AS block FROM (SELECT o_orderkey, (o_orderkey % 3 = 0)::INTEGER + (o_orderkey % 3 = 0)::INTEGER + (o_orderkey % 6 = 0)::INTEGER AS n FROM orders)")
def completeness(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    df = t.orders.select(k, F.when(k % 3 == 0, 1.0).alias("a"), F.when(k % 3 == 0, 2.0).alias("b"), F.when(k % 6 == 0, 3.0).alias("c"))
    n = sum((F.col(c).isNotNull().cast("int") for c in "abc"), F.lit(0))
    return df.select("o_orderkey", S.choose((n == 0, "NONE"), (n == 3, "ALL"), default="PARTIAL").alias("block"))


@query("pr15_fixed_bins", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high' END AS bin FROM orders")
def fixed_bins(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.right_closed_bin(F.col("o_totalprice"), [0, 50000, 150000, 300000], ["low", "mid", "high"]).alias("bin"))


@query(
    "pr16_quantile_bins",
    "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM customer) SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'NA' ELSE 'Q' || greatest(1, len(list_filter(edges, lambda x: x < c_acctbal))) END AS bin FROM customer, e",
)
def quantile_bins(t: Tables) -> DataFrame:
    found = quantiles(t.customer, {"x": F.col("c_acctbal")}, [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    df = t.customer.select("c_custkey", "c_acctbal")
    below = F.greatest(F.lit(1), sum(((F.col("c_acctbal") > e).cast("int") for e in sorted(set(found))), F.lit(0)))
    return df.select("c_custkey", F.when(F.col("c_acctbal").isNull(), "NA").otherwise(F.concat(F.lit("Q"), below.cast("string"))).alias("bin"))


@query(
    "pr17_thresholds",
    "WITH q AS (SELECT quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.5, 0.75, 0.95]) AS v FROM orders) SELECT round(value, 4) AS threshold, string_agg(name, '|' ORDER BY name) AS sources FROM (SELECT unnest(v) AS value, unnest(['q05', 'q25', 'q50', 'q50b', 'q75', 'q95']) AS name FROM q) GROUP BY 1",
)
def thresholds(t: Tables) -> DataFrame:
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q50b": 0.5, "q75": 0.75, "q95": 0.95}
    found = quantiles(t.orders, {"x": F.col("o_totalprice")}, sorted(set(probs.values())))["x"]
    at = dict(zip(sorted(set(probs.values())), found, strict=True))
    each = t.spark.createDataFrame([(n, at[p]) for n, p in probs.items()], "n string, v double")
    return each.groupBy(F.round("v", 4).alias("threshold")).agg(F.array_join(F.array_sort(F.collect_set("n")), "|").alias("sources"))


@query("pr18_fold_roles", f"WITH {UNITS_SQL} SELECT unit_id, outer_fold, CASE WHEN unit_id % 5 = outer_fold THEN 'test' WHEN unit_id % 5 = (outer_fold + 1) % 5 THEN 'validation' ELSE 'train' END AS role FROM units, (SELECT unnest(range(5)) AS outer_fold)")
def fold_roles(t: Tables) -> DataFrame:
    df = units(t).select("unit_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("outer_fold"))
    fold = F.pmod("unit_id", F.lit(5))
    role = S.choose((fold == F.col("outer_fold"), "test"), (fold == (F.col("outer_fold") + 1) % 5, "validation"), default="train")
    return df.select("unit_id", "outer_fold", role.alias("role"))


@query("fn_math", "SELECT o_orderkey, round(1 / (1 + exp(-greatest(-60, least(60, (o_totalprice - 150000) / 30000)))), 6) AS p, round(ln(1 + o_totalprice), 6) AS l, sign(o_totalprice - 150000)::DOUBLE AS s, round(degrees(atan(o_totalprice / 100000)), 6) AS a FROM orders")
def math(t: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", S.rounded(S.sigmoid((x - 150000) / 30000)).alias("p"), S.rounded(F.log1p(x)).alias("l"), F.signum(x - 150000).alias("s"), S.rounded(F.degrees(F.atan(x / 100000))).alias("a"))


@query("fn_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS local_time, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS n_days FROM orders")
def dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("day"), F.date_format(d + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss").alias("local_time"), F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).alias("n_days"))


@query("fn_json_counts", "WITH k AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, '{' || string_agg('\"' || s || '\":' || n, ',' ORDER BY s) || '}' AS counts FROM k GROUP BY 1")
def json_counts(t: Tables) -> DataFrame:
    k = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    # A handful of segments per nation, whatever the number of customers.
    return k.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))))).alias("counts"))


@query("fn_logit_clip", f"WITH {MEMBERS_SQL} SELECT set_id, slot, round(ln(p / (1 - p)), 3) AS z FROM (SELECT set_id, slot, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-raw * 5)))) AS p FROM scores)")
def logit_clip(t: Tables) -> DataFrame:
    from .cohort import scores

    return scores(t).select("set_id", "slot", F.round(S.logit(S.sigmoid(F.col("raw") * 5)), 3).alias("z"))
