"""Scoring metrics (ME)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..operators import metrics as M
from ..operators.statistics import quantiles
from ..registry import Tables, query
from .cohort import MEMBERS_SQL, SETSCORE_SQL, scores, set_scores

R = F.round
STRICT = "({a}_p > greatest({a}_1, {a}_2))::INTEGER"
EDGE = "(({a}_p > {a}_1)::INTEGER + ({a}_p > {a}_2)::INTEGER) / 2.0"


@query("me1_strict_pair_edge", f"WITH {SETSCORE_SQL} SELECT region, round(avg({STRICT.format(a='ctx')}), 6) AS strict, round(avg({EDGE.format(a='ctx')}), 6) AS edge FROM setscore JOIN (SELECT set_id, region FROM scores WHERE slot = 0) USING (set_id) GROUP BY 1")
def strict_pair_edge(t: Tables) -> DataFrame:
    s = scores(t)
    o = M.set_outcomes(s, "ctx").join(s.where("slot = 0").select("set_id", "region"), "set_id")
    return o.groupBy("region").agg(R(F.avg("strict"), 6).alias("strict"), R(F.avg("edge"), 6).alias("edge"))


RANK_SQL = """r AS (SELECT {s} AS s, sum((y = 1)::INTEGER) AS pos, sum((y = 0)::INTEGER) AS neg FROM scores GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM r)"""


@query("me2_auroc", f"WITH {MEMBERS_SQL}, {RANK_SQL.format(s='ctx')} SELECT round(sum(pos * (bn + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auroc FROM c")
def auroc(t: Tables) -> DataFrame:
    return M.auroc(scores(t), "ctx", "y").select(R("auroc", 6).alias("auroc"))


@query("me3_average_precision", f"WITH {MEMBERS_SQL}, {RANK_SQL.format(s='ctx')} SELECT round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 6) AS auprc FROM c")
def average_precision(t: Tables) -> DataFrame:
    return M.average_precision(scores(t), "ctx", "y").select(R("auprc", 6).alias("auprc"))


@query("me4_margins", f"WITH {SETSCORE_SQL} SELECT count(*) AS n, round(min(g), 6) AS lo, round(avg(g), 6) AS mean, round(quantile_cont(g, 0.25), 6) AS q1, round(quantile_cont(g, 0.75), 6) AS q3 FROM (SELECT ctx_p - greatest(ctx_1, ctx_2) AS g FROM setscore)")
def margins(t: Tables) -> DataFrame:
    g = t.once("margins", lambda: M.set_outcomes(scores(t), "ctx"))
    q1, q3 = quantiles(g, {"margin": F.col("margin")}, [0.25, 0.75])["margin"]
    return g.agg(F.count("*").alias("n"), R(F.min("margin"), 6).alias("lo"), R(F.avg("margin"), 6).alias("mean"), R(F.lit(q1), 6).alias("q1"), R(F.lit(q3), 6).alias("q3"))


@query("me5_confusion", f"WITH {MEMBERS_SQL}, p AS (SELECT y, 1 / (1 + exp(-ctx)) AS p FROM scores), c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn, avg((p - y) ** 2) AS brier FROM p) SELECT tp, fp, tn, fn, round(brier, 6) AS brier, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c")
def confusion(t: Tables) -> DataFrame:
    p = scores(t).select("y", sigmoid(F.col("ctx")).alias("p"))
    return M.confusion(p, "p", "y", 0.5).select("tp", "fp", "tn", "fn", *[R(c, 6).alias(c) for c in ("brier", "sensitivity", "specificity", "f1")])


@query("me6_validation_scalar", f"WITH {SETSCORE_SQL}, {RANK_SQL.format(s='ctx')}, a AS (SELECT sum(pos * (bn + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos) AS auprc FROM c), b AS (SELECT avg({STRICT.format(a='ctx')}) AS strict, avg({EDGE.format(a='ctx')}) AS edge FROM setscore) SELECT round((auroc + auprc + strict + edge) / 4, 6) AS scalar FROM a, b")
def validation_scalar(t: Tables) -> DataFrame:
    s = scores(t)
    parts = M.auroc(s, "ctx", "y").join(F.broadcast(M.average_precision(s, "ctx", "y"))).join(F.broadcast(M.set_outcomes(s, "ctx").agg(F.avg("strict").alias("strict"), F.avg("edge").alias("edge"))))
    return parts.select(R((F.col("auroc") + F.col("auprc") + F.col("strict") + F.col("edge")) / 4, 6).alias("scalar"))


@query("me7_weighted_median", "WITH c AS (SELECT p_size AS s, sum(p_retailprice) AS w FROM part GROUP BY 1), r AS (SELECT s, sum(w) OVER (ORDER BY s) AS upto, sum(w) OVER () / 2 AS half FROM c) SELECT (min(s) FILTER (upto >= half) + min(s) FILTER (upto > half)) / 2.0::DOUBLE AS weighted_median FROM r")
def weighted_median(t: Tables) -> DataFrame:
    return M.weighted_median(t.part, "p_size", "p_retailprice")


FOLD_WINS_SQL = f"f AS (SELECT set_id // 20 % 5 AS fold, avg({STRICT.format(a='raw')}) AS a, avg({STRICT.format(a='ctx')}) AS b FROM setscore GROUP BY 1)"


@query("me8_deltas_and_wins", f"WITH {SETSCORE_SQL}, {FOLD_WINS_SQL} SELECT round(avg(b - a), 6) AS mean_delta, count(*) FILTER (b > a) AS fold_wins FROM f")
def deltas_and_wins(t: Tables) -> DataFrame:
    strict = lambda a: F.avg((F.col(f"{a}_p") > F.greatest(f"{a}_1", f"{a}_2")).cast("int"))
    f = set_scores(t).groupBy((F.floor(F.col("set_id") / 20) % 5).alias("fold")).agg(strict("raw").alias("a"), strict("ctx").alias("b"))
    return f.agg(R(F.avg(F.col("b") - F.col("a")), 6).alias("mean_delta"), F.count_if(F.col("b") > F.col("a")).alias("fold_wins"))


ARMS = {"m1": "ctx", "m2": "raw", "m3": "(raw + ctx)", "m4": "(ctx - raw)"}
ARM_SQL = "arms AS (SELECT set_id, " + ", ".join(f"(max({e}) FILTER (slot = 0) > max({e}) FILTER (slot > 0))::INTEGER AS {n}" for n, e in ARMS.items()) + " FROM scores GROUP BY 1)"


@query("me9_consensus", f"WITH {MEMBERS_SQL}, {ARM_SQL} SELECT m1 + m2 + m3 + m4 AS n_success, count(*) AS n_sets FROM arms GROUP BY 1")
def consensus(t: Tables) -> DataFrame:
    value = lambda e, c: F.max(F.when(F.expr(c), F.expr(e)))
    g = scores(t).groupBy("set_id").agg(*[(value(e, "slot = 0") > value(e, "slot > 0")).cast("int").alias(n) for n, e in ARMS.items()])
    return g.groupBy((F.col("m1") + F.col("m2") + F.col("m3") + F.col("m4")).alias("n_success")).agg(F.count("*").alias("n_sets"))


@query("me10_block_audit", f"WITH {SETSCORE_SQL}, u AS (SELECT s.*, x.price, x.bal FROM setscore s JOIN scores x ON x.set_id = s.set_id AND x.slot = 0), q AS (SELECT quantile_cont(price, 0.5) AS pm, quantile_cont(bal, 0.5) AS bm FROM u) SELECT 'P' || (1 + (price > pm)::INTEGER) || '_B' || (1 + (bal > bm)::INTEGER) AS block, count(*) AS n, round(avg({STRICT.format(a='raw')}), 6) AS raw_strict, round(avg({STRICT.format(a='ctx')}), 6) AS ctx_strict FROM u, q GROUP BY 1")
def block_audit(t: Tables) -> DataFrame:
    u = t.once("cases", lambda: set_scores(t).join(scores(t).where("slot = 0").select("set_id", "price", "bal"), "set_id"))
    middle = {c: q[0] for c, q in quantiles(u, {c: F.col(c) for c in ("price", "bal")}, [0.5]).items()}
    half = lambda c: (1 + (F.col(c) > F.lit(middle[c])).cast("int")).cast("string")
    strict = lambda a: R(F.avg((F.col(f"{a}_p") > F.greatest(f"{a}_1", f"{a}_2")).cast("int")), 6)
    block = F.concat(F.lit("P"), half("price"), F.lit("_B"), half("bal"))
    return u.groupBy(block.alias("block")).agg(F.count("*").alias("n"), strict("raw").alias("raw_strict"), strict("ctx").alias("ctx_strict"))


@query(
    "me11_reproduction_audit",
    f"""WITH {SETSCORE_SQL}, one AS (SELECT set_id, {STRICT.format(a='ctx')} AS strict FROM setscore),
two AS (SELECT set_id, (count(*) FILTER (slot > 0 AND ctx >= (SELECT max(b.ctx) FROM scores b WHERE b.set_id = a.set_id AND b.slot = 0)) = 0)::INTEGER AS strict FROM scores a GROUP BY 1)
SELECT (SELECT round(avg(strict), 6) FROM one) AS reported, (SELECT round(avg(strict), 6) FROM two) AS recomputed, count(*) AS sets, count(*) FILTER (one.strict IS DISTINCT FROM two.strict) AS disagree FROM one FULL JOIN two USING (set_id)""",
)
def reproduction_audit(t: Tables) -> DataFrame:
    """The strict share from members, set by set against that from the sets' three scores."""
    one = set_scores(t).select("set_id", (F.col("ctx_p") > F.greatest("ctx_1", "ctx_2")).cast("int").alias("reported"))
    two = M.set_outcomes(scores(t), "ctx").select("set_id", F.col("strict").alias("recomputed"))
    both = one.join(two, "set_id", "full")
    return both.agg(R(F.avg("reported"), 6).alias("reported"), R(F.avg("recomputed"), 6).alias("recomputed"), F.count("*").alias("sets"), F.count_if(~F.col("reported").eqNullSafe(F.col("recomputed"))).alias("disagree"))
