"""Representations (RP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import context as C
from ..operators import temporal as T
from ..operators.scaling import robust_apply, robust_params, standard_apply, standard_params
from ..registry import Tables, query
from .cohort import MEMBERS_SQL, UNITS_SQL, members, units
from .windows import GRID_SQL, HOURS, rain

R = F.round


@query("rp1_train_preprocessor", f"WITH {UNITS_SQL}, x AS (SELECT unit_id, CASE WHEN unit_id % 7 <> 0 THEN price END AS p, bal, unit_id % 5 AS fold FROM units), par AS (SELECT quantile_cont(ln(1 + p), 0.5) AS m, quantile_cont(ln(1 + p), 0.75) - quantile_cont(ln(1 + p), 0.25) AS i FROM x WHERE fold > 1) SELECT unit_id, round((coalesce(ln(1 + p), m) - m) / i, 6) AS z, (p IS NULL)::INTEGER AS missing FROM x, par")
def train_preprocessor(t: Tables) -> DataFrame:
    x = units(t).select("unit_id", F.when(F.col("unit_id") % 7 != 0, F.col("price")).alias("p"))
    params = robust_params(x.where("unit_id % 5 > 1"), ["p"], log1p=["p"])
    z = robust_apply(x, params, ["p"], log1p=["p"], zero_iqr="one")
    return z.select("unit_id", R(F.coalesce("z_p", F.lit(0.0)), 6).alias("z"), F.col("p").isNull().cast("int").alias("missing"))


@query("rp2_one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER AS s{i}" for i, s in enumerate(("AUTOMOBILE", "BUILDING", "MACHINERY"))) + ", (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))::INTEGER AS unknown FROM customer")
def one_hot(t: Tables) -> DataFrame:
    known = ("AUTOMOBILE", "BUILDING", "MACHINERY")
    s = F.coalesce("c_mktsegment", F.lit("MISSING"))
    return t.customer.select("c_custkey", *[(s == k).cast("int").alias(f"s{i}") for i, k in enumerate(known)], (~s.isin(*known)).cast("int").alias("unknown"))


@query("rp3_raw_vector", "SELECT vec_id, len(v)::INTEGER AS dim, round(v[65], 4) AS first_extra, round(list_sum(v), 4) AS total FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda x: x::DOUBLE), [label::DOUBLE, label * 2.0::DOUBLE]) AS v FROM embeddings)")
def raw_vector(t: Tables) -> DataFrame:
    v = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("double"), F.col("label") * 2.0))
    df = t.embeddings.select("vec_id", v.alias("v"))
    return df.select("vec_id", F.size("v").alias("dim"), R(F.col("v")[64], 4).alias("first_extra"), R(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def long_features(t: Tables) -> DataFrame:
    """Vectors in sets of three, in long form."""
    e = t.embeddings.select((F.col("vec_id") / 3).cast("long").alias("set_id"), F.col("vec_id").alias("unit_id"), F.posexplode("embedding").alias("feature", "x"))
    return e.withColumn("x", F.col("x").cast("double"))


LONG_SQL = "long AS (SELECT vec_id // 3 AS set_id, vec_id AS unit_id, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings), dev AS (SELECT *, x - avg(x) OVER (PARTITION BY set_id, feature) AS signed FROM long)"


@query("rp4_set_deviations", f"WITH {LONG_SQL} SELECT set_id, unit_id, feature::INTEGER AS feature, round(signed, 5) AS signed, round(abs(signed), 5) AS absdev FROM dev")
def set_deviations(t: Tables) -> DataFrame:
    return C.deviations(long_features(t)).select("set_id", "unit_id", "feature", R("signed", 5).alias("signed"), R("absdev", 5).alias("absdev"))


@query("rp4_feature_vector", f"WITH {LONG_SQL} SELECT unit_id, 192 AS dim, round(sum(x) + sum(signed) + sum(abs(signed)), 4) AS total FROM dev GROUP BY 1")
def feature_vector(t: Tables) -> DataFrame:
    d = C.deviations(long_features(t))
    v = d.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("feature", "x", "signed", "absdev"))).alias("v"))
    parts = F.concat(*[F.col(f"v.{c}") for c in ("x", "signed", "absdev")])
    return v.select("unit_id", parts.alias("f")).select("unit_id", F.size("f").alias("dim"), R(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


SUMMARY_SQL = ", ".join(f"round({e}, 3) AS {n}" for n, e in (("mean", "avg(v)"), ("std", "stddev_pop(v)"), ("max", "max(v)"), ("min", "min(v)"), ("sum", "sum(v)"), ("last", "arg_max(v, slot)"), ("maxabs", "max(abs(v))")))


@query("rp5_seven_summaries", f"WITH {GRID_SQL} SELECT user_id, {SUMMARY_SQL} FROM rain GROUP BY 1")
def seven_summaries(t: Tables) -> DataFrame:
    return C.summaries(rain(t), ["user_id"], "v", "slot").select("user_id", *[R(s, 3).alias(s) for s in C.STATISTICS])


# Units: users with an embedding; static: its 64 values and the squares of the first 28; series: 70 half hours of ten
# channels (value, eight rolling sums, decayed index). Sets are three users in turn.
CHANNELS = ("v", *(f"h{h}" for h in HOURS), "api")
SLOTS, PAST = 70, 240  # the longest sum and the decayed index reach back PAST slots, the slot itself included
_SUMS = ", ".join(f"sum(v) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW) AS h{h}" for h in HOURS)
TENSOR_SQL = f"""{GRID_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS i, row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) AS back, {_SUMS} FROM rain),
api AS (SELECT a.user_id, a.i, sum(pow(0.9, a.i - b.i) * b.v) AS api FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 239 AND a.i WHERE a.back <= 70 GROUP BY ALL),
tensor AS (SELECT user_id, flatten(list([{", ".join(CHANNELS)}] ORDER BY i)) AS r FROM n JOIN api USING (user_id, i) GROUP BY 1),
member AS (SELECT vec_id // 3 AS set_id, vec_id AS unit_id, list_concat(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding[1:28], lambda x: x::DOUBLE * x::DOUBLE)) AS s, r FROM embeddings JOIN tensor ON user_id = vec_id)"""
BLOCKS_SQL = f"""{TENSOR_SQL},
ls AS (SELECT *, x - avg(x) OVER (PARTITION BY set_id, i) AS d FROM (SELECT set_id, unit_id, unnest(range(92)) AS i, unnest(s) AS x FROM member)),
lr AS (SELECT *, x - avg(x) OVER (PARTITION BY set_id, i) AS d FROM (SELECT set_id, unit_id, unnest(range(700)) AS i, unnest(r) AS x FROM member)),
seven AS (SELECT unit_id, i % 10 AS c, [avg(d), stddev_pop(d), max(d), min(d), sum(d), last(d ORDER BY i), max(abs(d))] AS z FROM lr GROUP BY ALL),
z AS (SELECT unit_id, list(z[k] ORDER BY k, c) AS series_stats FROM seven, (SELECT unnest(range(1, 8)) AS k) GROUP BY 1),
blk AS (SELECT * FROM (SELECT unit_id, list(x ORDER BY i) AS static, list(d ORDER BY i) AS static_dev, list(abs(d) ORDER BY i) AS static_abs FROM ls GROUP BY 1)
  JOIN (SELECT unit_id, list(x ORDER BY i) AS series, list(d ORDER BY i) AS series_dev, list(abs(d) ORDER BY i) AS series_abs FROM lr GROUP BY 1) USING (unit_id) JOIN z USING (unit_id))"""
# The second sum weighs values by their place, so that it shows an order other than the layout's.
_SEEN = "len({f})::INTEGER AS dim, round(list_sum({f}), 2) AS total, round(list_sum(list_transform(range(1, len({f}) + 1), lambda k: k * {f}[k])) / len({f}), 2) AS by_place"


def tensor(t: Tables) -> DataFrame:
    """(user_id, r): 70 x 10 values, time by time. They depend on the grid's last SLOTS + PAST - 1 slots only."""
    n = T.decayed_sum(T.rolling_sums(rain(t, SLOTS + PAST - 1), "user_id", "slot", "v", HOURS), "user_id", "slot", "v", 0.9, PAST).withColumnRenamed("decayed", "api")
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("slot")))
    n = n.withColumn("back", back).where(F.col("back") <= SLOTS)
    return n.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array(*CHANNELS).alias("x")))), lambda s: s["x"])).alias("r"))


def set_members(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    static = F.concat(e, F.transform(F.slice(e, 1, 28), lambda x: x * x))
    rows = t.embeddings.select((F.col("vec_id") / 3).cast("long").alias("set_id"), F.col("vec_id").alias("unit_id"), static.alias("s"))
    return rows.join(tensor(t).withColumnRenamed("user_id", "unit_id"), "unit_id")


def seen(v: Column) -> list[Column]:
    place = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.size(v).alias("dim"), R(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 2).alias("total"), R(place / F.size(v), 2).alias("by_place")]


@query("sp16_rain_tensor", f"WITH {TENSOR_SQL} SELECT user_id, {_SEEN.format(f='r')} FROM tensor")
def rain_tensor(t: Tables) -> DataFrame:
    return tensor(t).select("user_id", *seen(F.col("r")))


@query("rp6_ablation_dims", f"WITH {BLOCKS_SQL}, a AS (" + " UNION ALL ".join(f"SELECT unit_id, '{k}' AS variant, {' || '.join(v)} AS f FROM blk" for k, v in C.ABLATIONS.items()) + f") SELECT unit_id, variant, {_SEEN.format(f='f')} FROM a")
def ablation_dims(t: Tables) -> DataFrame:
    """Every unit's vector in each of the seven ablations: 792, 1,584, 1,584, 2,376, 976, 2,262 and 2,446 values."""
    b = C.set_blocks(set_members(t), "set_id", "unit_id", "s", "r", len(CHANNELS))
    vectors = F.array(*[F.struct(F.lit(k).alias("variant"), C.variant(k).alias("f")) for k in C.ABLATIONS])
    return b.select("unit_id", F.explode(vectors).alias("v")).select("unit_id", "v.variant", *seen(F.col("v.f")))


@query("rp3_raw_layout", f"WITH {TENSOR_SQL} SELECT unit_id, {_SEEN.format(f='(s || r)')} FROM member")
def raw_layout(t: Tables) -> DataFrame:
    return set_members(t).select("unit_id", *seen(F.concat("s", "r")))


@query(
    "rp8_alien_context",
    f"""WITH {TENSOR_SQL}, o AS (SELECT DISTINCT set_id FROM member), nx AS (SELECT set_id, coalesce(lead(set_id) OVER w, first_value(set_id) OVER w) AS other FROM o WINDOW w AS (ORDER BY md5(set_id::VARCHAR), set_id)),
x AS (SELECT set_id, unit_id, unnest(range(92)) AS i, unnest(s) AS x FROM member), m AS (SELECT set_id, i, avg(x) AS m FROM x GROUP BY ALL)
SELECT x.unit_id, round(sum(x - m), 4) AS signed, round(sum(abs(x - m)), 4) AS absdev FROM x JOIN nx USING (set_id) JOIN m ON m.set_id = nx.other AND m.i = x.i GROUP BY 1""",
)
def alien_context(t: Tables) -> DataFrame:
    """The placebo's features: deviations from another set's mean."""
    x = set_members(t).select("set_id", "unit_id", F.posexplode("s").alias("i", "x"))
    means = x.groupBy("set_id", "i").agg(F.avg("x").alias("m"))
    other = C.derangement(x, "set_id")
    d = x.join(other, "set_id").select("unit_id", "i", "x", F.col("other").alias("set_id")).join(means, ["set_id", "i"]).withColumn("d", F.col("x") - F.col("m"))
    return d.groupBy("unit_id").agg(R(F.sum("d"), 4).alias("signed"), R(F.sum(F.abs("d")), 4).alias("absdev"))


@query("rp7_global_centring", f"WITH {UNITS_SQL} SELECT unit_id, round(price - (SELECT avg(price) FROM units WHERE unit_id % 5 > 1), 4) AS centred FROM units")
def global_centring(t: Tables) -> DataFrame:
    u = units(t).select("unit_id", "price")
    return u.join(F.broadcast(u.where("unit_id % 5 > 1").agg(F.avg("price").alias("m")))).select("unit_id", R(F.col("price") - F.col("m"), 4).alias("centred"))


@query("rp9_pair_differences", f"WITH {MEMBERS_SQL} SELECT p.set_id, c.slot AS control, sign, (sign > 0)::INTEGER AS label, round(sign * (p.z_price - c.z_price), 6) AS d FROM members p JOIN members c ON p.set_id = c.set_id AND p.slot = 0 AND c.slot > 0, (SELECT unnest([1, -1]) AS sign)")
def pair_differences(t: Tables) -> DataFrame:
    m = members(t).select("set_id", "slot", "z_price")
    pairs = m.where("slot = 0").select("set_id", F.col("z_price").alias("p")).join(m.where("slot > 0"), "set_id")
    signed = pairs.select("set_id", F.col("slot").alias("control"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), (F.col("p") - F.col("z_price")).alias("d"))
    return signed.select("set_id", "control", "sign", (F.col("sign") > 0).cast("int").alias("label"), R(F.col("sign") * F.col("d"), 6).alias("d"))


@query("rp10_standardised", f"WITH {UNITS_SQL}, par AS (SELECT avg(price) AS m, CASE WHEN stddev_pop(price) < 1e-6 THEN 1 ELSE stddev_pop(price) END AS s FROM units WHERE unit_id % 5 > 1) SELECT unit_id, round((price - m) / s, 6) AS z FROM units, par")
def standardised(t: Tables) -> DataFrame:
    u = units(t).select("unit_id", "price")
    return standard_apply(u, standard_params(u.where("unit_id % 5 > 1"), ["price"]), ["price"]).select("unit_id", R("s_price", 6).alias("z"))


@query("rp11_role_weights", f"WITH {MEMBERS_SQL} SELECT set_id, slot, CASE WHEN slot = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM scores")
def role_weights(t: Tables) -> DataFrame:
    return members(t).select("set_id", "slot", F.when(F.col("slot") == 0, 1.0).otherwise(0.5).alias("weight"))


@query("rp12_external_categories", "SELECT o_orderkey, coalesce(v.i, 99)::INTEGER AS code FROM orders LEFT JOIN (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority < '4')) v ON p = o_orderpriority")
def external_categories(t: Tables) -> DataFrame:
    """Codes fitted on one part; what it has not seen is UNKNOWN (99)."""
    seen = t.orders.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("p")).distinct()
    codes = seen.agg(F.array_sort(F.collect_set("p")).alias("all"))  # a vocabulary of categories
    at = F.array_position("all", F.col("o_orderpriority")) - 1
    return t.orders.join(F.broadcast(codes)).select("o_orderkey", F.when(at >= 0, at).otherwise(99).cast("int").alias("code"))


@query("rp13_process_summaries", f"WITH {GRID_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS i FROM rain) SELECT user_id, round(quantile_cont(v, 0.9), 4) AS p90, round(arg_min(i, struct_pack(v := -v, i := i)) / (count(*) - 1)::DOUBLE, 6) AS peak FROM i GROUP BY 1")
def process_summaries(t: Tables) -> DataFrame:
    i = rain(t).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("slot")) - 1)
    peak = F.min(F.struct((-F.col("v")).alias("v"), "i"))["i"] / (F.count("*") - 1)
    return i.groupBy("user_id").agg(R(F.percentile("v", F.lit(0.9)), 4).alias("p90"), R(peak, 6).alias("peak"))


@query("rp17_replace_source", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 1.1::DOUBLE ELSE p_retailprice END AS price, (p_partkey % 4 = 0)::INTEGER AS replaced FROM part")
def replace_source(t: Tables) -> DataFrame:
    new = t.part.where("p_partkey % 4 = 0").select("p_partkey", (F.col("p_retailprice") * 1.1).alias("n"))
    return t.part.select("p_partkey", "p_retailprice").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("n", "p_retailprice").alias("price"), F.col("n").isNotNull().cast("int").alias("replaced"))
