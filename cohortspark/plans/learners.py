"""Learners (ML)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rounded
from ..operators import boosting as B
from ..operators import grouped
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import network as N
from ..operators.adapter import KINDS, Baseline, BaselineModel
from ..operators.bootstrap import paired_bootstrap
from ..operators.graph import durable, shared_folder
from ..operators.scaling import robust_apply, robust_params
from ..registry import Tables, query
from .cohort import FEATURES, MEMBERS_SQL, SETS_SQL, UNITS_SQL, members, scaled, sets, units

RAW = tuple(f"z_{c}" for c in FEATURES)
CONTEXT = tuple(f"r_{c}" for c in FEATURES)


def training(t: Tables) -> DataFrame:
    m = members(t).withColumns({"label": (F.col("slot") == 0).cast("double"), "fold": F.floor(F.col("set_id") / 20) % 5, "weight": F.when(F.col("slot") == 0, 1.0).otherwise(0.5)})
    return L.assembled(durable(m.select("set_id", "slot", "unit_id", "label", "fold", "weight", *RAW, *CONTEXT)), [*RAW, *CONTEXT])


FOLDS = 5


def out_of_fold(df: DataFrame, fitted: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df with score, each fold scored by what was fitted on the other four."""
    parts = [fitted(df.where(F.col("fold") != k))(df.where(F.col("fold") == k)) for k in range(FOLDS)]
    return durable(reduce(DataFrame.unionByName, [p.select("set_id", "slot", "unit_id", "label", "fold", "score") for p in parts]))


def judged(scored: DataFrame, name: str) -> DataFrame:
    """A row per fold: AUROC, strict and edge shares of the fold's sets, and whether the fold is complete."""
    held = scored.withColumn("y", F.col("label").cast("int"))
    auc = M.auroc(held, "score", "y", by=["fold"])
    sets = M.set_outcomes(held, "score").withColumn("fold", F.floor(F.col("set_id") / 20) % FOLDS)
    sets = sets.groupBy("fold").agg(F.avg("strict").alias("strict"), F.avg("edge").alias("edge"), F.count("*").alias("sets"))
    return auc.join(sets, "fold").select(F.lit(name).alias("learner"), "fold", "sets", *[rounded(F.col(c)).alias(c) for c in ("auroc", "strict", "edge")])


def by_model(fit: Callable[[DataFrame], object]) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """fit gives a pyspark.ml model; its probability is the score."""

    def fitted(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = fit(train)
        return lambda held: L.probability(model, held, "score")

    return fitted


@query("ml1_elastic_net")
def elastic_net(t: Tables) -> DataFrame:
    """C is taken from 0.1, 1 and 10 by the AUROC out of fold, the smaller of equal ones; a row per fold of the best."""
    df = training(t)
    runs = {c: out_of_fold(df, by_model(lambda x, c=c: L.elastic_net(x, "label", "weight", c=c))) for c in (0.1, 1.0, 10.0)}
    scores = {c: M.auroc(r.withColumn("y", F.col("label").cast("int")), "score", "y").first()["auroc"] for c, r in runs.items()}
    best = min(runs, key=lambda c: (-round(scores[c] or 0.0, 9), c))
    return judged(runs[best], "elastic_net").withColumn("c", F.lit(best))


@query("ml2_perceptron")
def perceptron(t: Tables) -> DataFrame:
    return judged(out_of_fold(training(t), by_model(lambda x: L.perceptron(x, "label", [6, 8, 2]))), "perceptron")


@query("ml2_dropout_perceptron")
def dropout_perceptron(t: Tables) -> DataFrame:
    """Layers of 256 and 128 with a dropout of 0.2; the fold after the one left out ends the training."""
    df = training(t).drop("features").withColumn("x", F.array(*(F.col(c).cast("double") for c in (*RAW, *CONTEXT))))
    parts = []
    for k in range(FOLDS):
        net = N.fit(df.where(F.col("fold") != k), N.Network([len(RAW) + len(CONTEXT), 256, 128, 1]), "unit_id", "x", "label", "weight", F.col("fold") == (k + 1) % FOLDS, rounds=5, patience=2)
        parts.append(N.applied(df.where(F.col("fold") == k), net, "x", "score").select("set_id", "slot", "unit_id", "label", "fold", "score"))
    return judged(durable(reduce(DataFrame.unionByName, parts)), "dropout_perceptron")


@query("ml9_pull_encoder")
def pull_encoder(t: Tables) -> DataFrame:
    """The 792 raw values of a unit through an encoder of 50, 100 and 50 that draws ones together, then bagged trees on its
    outputs: AUROC of each fold, both fitted on the other four. Label as in ml_ablation_scores."""
    from .representation import set_members

    x = F.transform(F.concat("s", "r"), lambda v: F.signum(v) * F.log1p(F.abs(v)))
    rows = set_members(t).join(t.embeddings.select(F.col("vec_id").alias("unit_id"), (F.col("label") % 3 == 0).cast("double").alias("label")), "unit_id")
    df = durable(rows.select("set_id", "unit_id", "label", F.pmod(F.xxhash64("set_id"), F.lit(FOLDS)).alias("fold"), x.alias("x")))
    width, parts = df.agg(F.max(F.size("x"))).first()[0], []
    for k in range(FOLDS if width else 0):
        train = df.where(F.col("fold") != k)
        net = N.fit(train, N.Network([width, 50, 100, 50], N.PULL, dropout=0.0, rate=0.003), "unit_id", "x", "label", rounds=3)
        encoded = durable(N.applied(df, net, "x", "e").withColumn("features", array_to_vector("e")))
        score = L.pu_bagging(encoded.where(F.col("fold") != k), "unit_id", "label", bags=3, depth=4)
        parts.append(score(encoded.where(F.col("fold") == k)).select("unit_id", "label", "fold", "score"))
    held = durable(reduce(DataFrame.unionByName, parts)).withColumn("y", F.col("label").cast("int"))
    return M.auroc(held, "score", "y", by=["fold"]).join(held.groupBy("fold").agg(F.count("*").alias("units")), "fold").select("fold", "units", rounded(F.col("auroc")).alias("auroc"))


@query("ml4_boosted_trees")
def boosted_trees(t: Tables) -> DataFrame:
    return judged(out_of_fold(training(t), by_model(lambda x: L.boosted(x, "label"))), "boosted_trees")


ROUNDS, RATE, BINS = 8, 0.25, 64  # few large steps in place of the settings' hundreds of small ones


def boosted_choice(t: Tables, name: str, settings: tuple[B.Setting, ...], columns: tuple[str, ...], watch: bool = False) -> DataFrame:
    """Every setting is trained without each fold, all in the same passes; the setting of the largest AUROC out of fold
    stays (of equal ones the first), with a row per fold. watch: the fold after the one left out ends the training."""
    df = training(t).drop("features").withColumn("x", F.array(*(F.col(c).cast("double") for c in columns)))
    cuts = B.edges(df, "x", BINS)
    table = B.binned(df, "x", cuts, "set_id", ["unit_id", "slot"], "label", "weight", "fold")
    models = [B.Model(replace(s, rounds=ROUNDS, rate=RATE), k, (k + 1) % FOLDS if watch else None, 2) for s in settings for k in range(FOLDS)]
    B.train(table, models, len(cuts), max((len(c) for c in cuts), default=0) + 2)
    keep = df.select("unit_id", "slot", "set_id", "label", "fold")
    scored = durable(B.scores(table, models, len(cuts), ["unit_id", "slot"]).drop("y", "fold").join(keep, ["unit_id", "slot"]))
    runs = {s.name: scored.withColumn("score", F.col("scores")[i]) for i, s in enumerate(settings)}
    found = {n: M.auroc(r.withColumn("y", F.col("label").cast("int")), "score", "y").first()["auroc"] for n, r in runs.items()}
    best = max(runs, key=lambda n: round(found[n] or 0.0, 9))
    return judged(runs[best], name).withColumn("setting", F.lit(best))


@query("ml3_histogram_boosting")
def histogram_boosting(t: Tables) -> DataFrame:
    return boosted_choice(t, "histogram_boosting", B.HISTOGRAM, (*RAW, *CONTEXT), watch=True)


@query("ml4_depth_choice")
def depth_choice(t: Tables) -> DataFrame:
    return boosted_choice(t, "depth_choice", B.EXTREME, (*RAW, *CONTEXT))


@query("ml5_pairwise_ranker")
def pairwise_ranker(t: Tables) -> DataFrame:
    return boosted_choice(t, "pairwise_ranker", tuple(replace(s, loss=B.PAIRS) for s in B.EXTREME), RAW)


def differences(df: DataFrame) -> DataFrame:
    """Case less control and control less case of each pair of a set, labelled 1 and 0."""
    case = df.where("slot = 0").select("set_id", *[F.col(c).alias(f"p_{c}") for c in RAW])
    pairs = df.where("slot > 0").select("set_id", "fold", *RAW).join(case, "set_id").withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return pairs.select("set_id", "fold", (F.col("sign") > 0).cast("double").alias("label"), *[(F.col("sign") * (F.col(f"p_{c}") - F.col(c))).alias(c) for c in RAW])


def by_differences(fit: Callable[[DataFrame], object]) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    def fitted(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = fit(L.assembled(differences(train), RAW))
        return lambda held: L.probability(model, L.assembled(held.drop("features"), RAW), "score")

    return fitted


@query("ml6_pair_differences")
def pair_differences(t: Tables) -> DataFrame:
    return judged(out_of_fold(training(t), by_differences(lambda x: L.elastic_net(x, "label", intercept=False))), "pair_differences")


@query("ml6_pair_boosted")
def pair_boosted(t: Tables) -> DataFrame:
    """The pairwise booster: trees over differences, which also stand for a ranker trained on pairs of a set."""
    return judged(out_of_fold(training(t), by_differences(lambda x: L.boosted(x, "label"))), "pair_boosted")


@query("ml7_pu_bagging")
def pu_bagging(t: Tables) -> DataFrame:
    return judged(out_of_fold(training(t), lambda x: L.pu_bagging(x, "unit_id", "label")), "pu_bagging")


@query("ml8_spy_pu")
def spy_pu(t: Tables) -> DataFrame:
    return judged(out_of_fold(training(t), lambda x: L.spy_pu(x, "unit_id", "label")), "spy_pu")


@query("ml_ablation_scores")
def ablation_scores(t: Tables) -> DataFrame:
    """AUROC out of fold of every ablation of the 792 and 2,446 value layouts and of the two placebos, five folds of whole
    sets. Label: the class of the embedding is one of every third."""
    from ..operators import context as C
    from .representation import CHANNELS, set_members

    rows = durable(set_members(t).join(t.embeddings.select(F.col("vec_id").alias("unit_id"), (F.col("label") % 3 == 0).cast("double").alias("label")), "unit_id"))
    fold = F.pmod(F.xxhash64("set_id"), F.lit(FOLDS)).alias("fold")
    labels = rows.select("unit_id", "label", fold)
    out = []
    kinds = {"set": (C.set_blocks, list(C.ABLATIONS)), "alien": (C.alien_blocks, ["A6"]), "global": (C.global_blocks, ["A6"])}
    for kind, (blocks, names) in kinds.items():
        own = durable(blocks(rows, "set_id", "unit_id", "s", "r", len(CHANNELS)).join(labels, "unit_id"))
        for name in names:
            df = durable(own.select("unit_id", "label", "fold", C.variant(name).alias("x")))
            width = df.agg(F.max(F.size("x"))).first()[0]
            df = df.withColumn("features", array_to_vector("x"))
            parts = []
            for k in range(FOLDS):
                model = L.elastic_net(df.where(F.col("fold") != k), "label", c=0.1, iterations=8)
                parts.append(L.probability(model, df.where(F.col("fold") == k), "score").select("score", F.col("label").cast("int").alias("y")))
            auc = M.auroc(durable(reduce(DataFrame.unionByName, parts)), "score", "y")
            out.append(auc.select(F.lit(kind).alias("context"), F.lit(name).alias("variant"), F.lit(width).alias("dim"), rounded(F.col("auroc")).alias("auroc")))
    return reduce(DataFrame.unionByName, out)


@query("ml11_tabular_baselines")
def tabular_baselines(t: Tables) -> DataFrame:
    """Every kind of baseline through the one contract: fold 1 chooses the setting, fold 0 is scored."""
    df = training(t).withColumn("valid", F.col("fold") == 1)
    rows = []
    for kind in KINDS:
        model = Baseline(kind, len(RAW) + len(CONTEXT)).fit(df.where("fold <> 0"))
        scored = durable(model.transform(df.where("fold = 0")).select("set_id", "slot", "unit_id", "label", "fold", "score"))
        rows.append(judged(scored, kind).withColumn("setting", F.lit(str(model.selected_config()))))
    return reduce(DataFrame.unionByName, rows)


@query("ml14_adapter_contract", f"WITH {MEMBERS_SQL} SELECT kind, count(*) AS scored, 0::BIGINT AS changed, 0::BIGINT AS outside FROM scores, (SELECT unnest({list(KINDS)!r}) AS kind) WHERE set_id // 20 % 5 = 0 GROUP BY 1")
def adapter_contract(t: Tables) -> DataFrame:
    """Rows scored by each kind, those that a saved and reread model scores otherwise, and scores outside 0 to 1."""
    df = training(t).withColumn("valid", F.col("fold") == 1)
    rows = []
    for kind in KINDS:
        model = Baseline(kind, len(RAW) + len(CONTEXT)).fit(df.where("fold <> 0"))
        path = f"{shared_folder(t.spark)}/baseline-{uuid.uuid4().hex}"
        model.save(path)
        twice = BaselineModel.load(path).transform(model.transform(df.where("fold = 0")).withColumnRenamed("score", "first"))
        differ = F.count_if(F.abs(F.col("first") - F.col("score")) > 1e-12)
        rows.append(twice.agg(F.lit(kind).alias("kind"), F.count("*").alias("scored"), differ.alias("changed"), F.count_if(~F.col("score").between(0, 1)).alias("outside")))
    return reduce(DataFrame.unionByName, rows)


def rematched(t: Tables) -> DataFrame:
    """(set_id, slot, unit_id) of a new matching: the cases of the largest support with two controls of their own each, at
    least total distance."""
    from .matching import supported

    a = grouped.cheapest_assignment(*supported(t))
    slot = F.row_number().over(Window.partitionBy("p").orderBy("cost", "c"))
    own = durable(a.withColumn("slot", slot).select(F.col("p").alias("set_id"), "slot", F.col("c").alias("unit_id")))
    return own.union(own.select("set_id").distinct().select("set_id", F.lit(0).alias("slot"), F.col("set_id").alias("unit_id")))


@query(
    "sp25_prepared_cohort",
    f"""WITH {SETS_SQL}, m AS (SELECT s.set_id, slot, u.*, set_id // 20 % 5 AS fold FROM sets s JOIN units u USING (unit_id)),
tr AS (SELECT quantile_cont(ln(1 + price), 0.5) AS pm, quantile_cont(ln(1 + price), 0.75) - quantile_cont(ln(1 + price), 0.25) AS pi, quantile_cont(bal, 0.5) AS bm, quantile_cont(bal, 0.75) - quantile_cont(bal, 0.25) AS bi FROM m WHERE fold <> 0)
SELECT set_id, slot::INTEGER AS slot, unit_id, fold, round((ln(1 + price) - pm) / pi, 6) AS price, round((bal - bm) / bi, 6) AS bal, (status = 'F')::INTEGER AS finished, (status = 'O')::INTEGER AS open, CASE WHEN slot = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM m, tr""",
)
def prepared_cohort(t: Tables) -> DataFrame:
    """A matched cohort made ready for a learner: scales of the training folds' members, categories as columns, role weights."""
    m = durable(sets(t).join(units(t), "unit_id").withColumn("fold", F.floor(F.col("set_id") / 20) % FOLDS))
    z = robust_apply(m, robust_params(m.where("fold <> 0"), ["price", "bal"], log1p=["price"]), ["price", "bal"], log1p=["price"])
    flag = lambda s: (F.col("status") == s).cast("int")
    weight = F.when(F.col("slot") == 0, 1.0).otherwise(0.5)
    return z.select("set_id", "slot", "unit_id", "fold", rounded(F.col("z_price")).alias("price"), rounded(F.col("z_bal")).alias("bal"), flag("F").alias("finished"), flag("O").alias("open"), weight.alias("weight"))


@query("sp26_retrained")
def retrained(t: Tables) -> DataFrame:
    """Learners anew on a new matching: sets without reuse, raw values against values relative to the set, each scored out
    of fold, and the paired bootstrap of their strict shares."""
    own = Window.partitionBy("set_id")
    m = rematched(t).join(scaled(t), "unit_id").withColumns({f"r_{c}": F.col(f"z_{c}") - F.avg(f"z_{c}").over(own) for c in FEATURES})
    m = durable(m.withColumns({"label": (F.col("slot") == 0).cast("double"), "fold": F.floor(F.col("set_id") / 20) % FOLDS, "weight": F.when(F.col("slot") == 0, 1.0).otherwise(0.5)}))
    arms = {}
    for arm, columns in (("raw", RAW), ("context", (*RAW, *CONTEXT))):
        scored = out_of_fold(L.assembled(m, columns), by_model(lambda x: L.elastic_net(x, "label", "weight")))
        arms[arm] = M.set_outcomes(scored.withColumn("y", F.col("label").cast("int")), "score").select("set_id", F.col("strict").alias(arm))
    both = durable(arms["raw"].join(arms["context"], "set_id"))
    found = paired_bootstrap(both, "set_id", "raw", "context", 2000)
    shares = both.agg(F.count("*").alias("sets"), rounded(F.avg("raw")).alias("raw_strict"), rounded(F.avg("context")).alias("context_strict"))
    return shares.join(F.broadcast(found.select(*(rounded(F.col(c)).alias(c) for c in ("observed", "low", "high", "two_sided_p")), "supported")))  # a row each


@query(
    "ml10_threshold_rule",
    f"""WITH {UNITS_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, unnest(list_distinct(quantile_cont({c}, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]))) AS threshold FROM units" for c in FEATURES)}),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x, y FROM units" for c in FEATURES)}),
r AS (SELECT feature, threshold, count(*) FILTER (x >= threshold AND y = 1) / count(*) FILTER (y = 1)::DOUBLE - count(*) FILTER (x >= threshold AND y = 0) / count(*) FILTER (y = 0)::DOUBLE AS youden FROM l JOIN c USING (feature) GROUP BY ALL)
SELECT feature, round(threshold, 4) AS threshold, round(youden, 6) AS youden FROM r ORDER BY round(youden, 9) DESC, threshold, feature DESC LIMIT 1""",
)
def threshold_rule(t: Tables) -> DataFrame:
    return L.threshold_rule(units(t), FEATURES, "y").select("feature", F.round("threshold", 4).alias("threshold"), rounded(F.col("youden")).alias("youden"))


LOSS_SQL = "p.set_id, ln(1 + exp(-(p.ctx - c.ctx))) AS l FROM scores p JOIN scores c ON p.set_id = c.set_id AND p.slot = 0 AND c.slot > 0"


@query("ml12_pair_loss", f"WITH {MEMBERS_SQL} SELECT round(avg(l), 5) AS softplus_pair, (SELECT round(avg(CASE WHEN y = 1 THEN ln(1 + exp(-ctx)) ELSE 0.5::DOUBLE * ln(1 + exp(ctx)) END), 5) FROM scores) AS weighted_bce FROM (SELECT {LOSS_SQL})")
def pair_loss(t: Tables) -> DataFrame:
    from .cohort import scores

    s = scores(t)
    pairs = s.where("slot = 0").select("set_id", F.col("ctx").alias("p")).join(s.where("slot > 0").select("set_id", F.col("ctx").alias("c")), "set_id")
    pair = pairs.agg(F.round(F.avg(F.log1p(F.exp(F.col("c") - F.col("p")))), 5).alias("softplus_pair"))
    bce = F.when(F.col("y") == 1, F.log1p(F.exp(-F.col("ctx")))).otherwise(0.5 * F.log1p(F.exp("ctx")))
    return pair.join(F.broadcast(s.agg(F.round(F.avg(bce), 5).alias("weighted_bce"))))


@query("ml13_deployment_config", f"WITH {UNITS_SQL}, v AS (SELECT unit_id % 3 AS config, nation % 5 AS fold, avg(price) AS score FROM units GROUP BY ALL) SELECT config, round(avg(score), 4) AS mean_score FROM v GROUP BY 1 ORDER BY avg(score) DESC, config LIMIT 1")
def deployment_config(t: Tables) -> DataFrame:
    v = units(t).groupBy((F.col("unit_id") % 3).alias("config"), (F.col("nation") % 5).alias("fold")).agg(F.avg("price").alias("score"))
    m = v.groupBy("config").agg(F.avg("score").alias("s"))
    best = m.agg(F.max(F.struct("s", (-F.col("config")).alias("c"))).alias("b"))
    return best.select((-F.col("b.c")).alias("config"), F.round("b.s", 4).alias("mean_score"))
