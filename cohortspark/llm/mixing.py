"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, then token-prefixes."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import split_join
from .common import durable, fits_broadcast, own_names
from .sentencepiece_codec import token_counts

LEVELS = ("domain", "language", "source")
# Production tables: the domain of each source (others: OTHER), weights of domains, and of languages in a domain (others
# get REST); sources in a language weigh alike.
SOURCE_DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4", "src10", "src11", "src12", "src13", "src14"),
    "reference": ("src5", "src6", "src7", "src15", "src16", "src17"),
    "forum": ("src8", "src9", "src18", "src19"),
}
OTHER = "other"
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
REST = 0.05
# Rows of the largest leaf that share a bucket, and the bits of the bucket's number.
BUCKET_ROWS, FEWEST_BITS, MOST_BITS = 100, 4, 20


def default_domain(source: Column) -> Column:
    """The domain of a source by the table above."""
    out = F.lit(OTHER)
    for domain, sources in SOURCE_DOMAINS.items():
        out = F.when(source.isin(*sources), domain).otherwise(out)
    return out


def filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds given to nodes (with weight, cap, and budget, their parent's): weighted water-filling among siblings.

    Each node gets level * weight up to its cap, with one level for all siblings such that they use up the budget if
    they can. In order of cap / weight the first nodes are full; the level is what remains for the others."""
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *LEVELS)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    seen = nodes.withColumn("_level", level).withColumn("_full", F.col("cap") <= F.col("_level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("_full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("_level").alias("l")))).over(Window.partitionBy(*parent))
    return seen.withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), open_level["l"] * F.col("weight")))).drop("_level", "_full")


def budgets(leaves: DataFrame, total: float, max_epochs: float, domain_weights: dict | None = None, language_weights: dict | None = None, source_weight: Column | None = None) -> DataFrame:
    """(domain, language, source, tokens, given): the tokens each leaf is to give.

    leaves has a row per leaf with its tokens. Weights go down the tree; a child that has less than its share leaves
    the rest to its siblings, and only what a whole node cannot give goes up to its parent's siblings, as a node's
    cap is the sum of its leaves' caps."""

    def weight(of: str, table: dict) -> Column:
        out = F.lit(REST)
        for k, v in table.items():
            out = F.when(F.col(of) == k, F.lit(float(v))).otherwise(out)
        return out

    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    langs = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("source", F.lit(""))
    tops = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"language": F.lit(""), "source": F.lit(""), "root": F.lit(0)})
    tops = filled(tops.withColumns({"weight": weight("domain", domain_weights or DOMAIN_WEIGHTS), "budget": F.lit(float(total))}), ["root"])
    langs = langs.withColumn("weight", weight("language", language_weights or LANGUAGE_WEIGHTS)).join(tops.select("domain", F.col("given").alias("budget")), "domain")
    langs = filled(langs, ["domain"])
    low = leaves.withColumn("weight", source_weight if source_weight is not None else F.lit(1.0)).join(langs.select("domain", "language", F.col("given").alias("budget")), ["domain", "language"])
    return filled(low, ["domain", "language"]).select(*LEVELS, "tokens", "given")


@own_names
def mix(docs: DataFrame, share: float = 0.5, max_epochs: int = 2, seed: int = 7, doc_id: str = "doc_id", text: str = "text", domain: Column | None = None, language: Column | None = None, source: Column | None = None, total: float | None = None, tokens: Column | None = None, carry: list[str] | None = None, **weights: dict) -> DataFrame:
    """Rows of docs, each once for every epoch (from 0) that takes it, with added columns domain, language, source_leaf,
    tokens, epoch. The budget is `total` tokens, or `share` of all. Tokens are those of the SentencePiece codec, or
    given as a column; a row counts as one at least. `carry`: the columns of docs to keep, all if not given.

    A leaf gives whole epochs as long as its budget covers them; of the last it gives a prefix in a seeded order that
    is new for each epoch: the rows before which the epoch's tokens have not come up to the budget. A hash of seed,
    epoch, id and text orders them; its first bits make buckets, as many as leave about a hundred rows of the largest
    leaf in each, whose sums, added up before they are shuffled, show the one bucket where the prefix ends, and only
    rows there are sorted. So a hot leaf is never in one task. The table with its token counts is written once. Null
    domains, languages and sources count as "", null texts as one token; rows equal in id and text tie; an empty table
    gives an empty one; columns with the added names are replaced, all others are carried along, whatever their names."""
    added = ["domain", "language", "source_leaf", "tokens", "epoch"]
    kept = [c for c in (carry or docs.columns) if c not in added]
    source = F.col("source") if source is None else source
    named = {"_domain": default_domain(source) if domain is None else domain, "_language": F.col("lang") if language is None else language, "_source": source}
    count = F.greatest(F.lit(1), F.coalesce(token_counts(F.col(text)) if tokens is None else tokens, F.lit(0))).cast("long")
    marked = docs.withColumns({**{k: F.coalesce(c, F.lit("")) for k, c in named.items()}, "_tokens": count, "_h": F.xxhash64(F.lit(seed), text), "_id": F.col(doc_id)})
    leaf = ["_domain", "_language", "_source"]
    marked = durable(marked.select(*[F.col(c).alias(f"_keep_{c}") for c in kept], *leaf, "_tokens", "_h", "_id", F.concat_ws("\x1f", *leaf).alias("_leaf")))
    slim = durable(marked.groupBy(*leaf, "_leaf").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("_rows")))
    facts = slim.agg(F.sum("tokens").alias("tokens"), F.max("_rows").alias("rows"), F.count("*").alias("leaves")).first()
    if total is None:
        total = share * (facts["tokens"] or 0)
    bits = min(MOST_BITS, max(FEWEST_BITS, ceil(log2(max(1, (facts["rows"] or 1) / BUCKET_ROWS)))))
    plan = budgets(slim.withColumnsRenamed(dict(zip(leaf, LEVELS, strict=True))).drop("_leaf", "_rows"), total, max_epochs, **weights)
    # Whole epochs, and the tokens that the next one still has to give (less than one token is none).
    plan = plan.withColumn("_whole", F.floor(F.col("given") / F.col("tokens") + 1e-9).cast("int"))
    plan = plan.withColumn("_left", F.greatest(F.lit(0.0), F.col("given") - F.col("_whole") * F.col("tokens"))).withColumn("_left", F.when(F.col("_left") < 1e-6 * F.col("tokens"), 0.0).otherwise(F.col("_left")))
    plan = durable(plan.select(F.concat_ws("\x1f", *LEVELS).alias("_leaf"), "_whole", "_left"))

    def joined(rows: DataFrame, facts_: DataFrame, how: str) -> DataFrame:
        """A row per leaf: broadcast while their number allows, else with the hot leaves apart."""
        return rows.join(F.broadcast(facts_), "_leaf", how) if fits_broadcast(facts["leaves"], 256) else split_join(rows, facts_, "_leaf", how)

    ready = joined(marked, plan, "inner").withColumn("_order", F.xxhash64(F.lit(seed), "_whole", "_id", "_h")).withColumn("_bucket", F.shiftrightunsigned(F.col("_order"), 64 - bits))
    sums = ready.where("_left > 0").groupBy("_leaf", "_bucket", "_left").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    # At most one bucket per leaf: the first in which the tokens come up to the rest.
    edge = durable(sums.where("_before < _left and _before + _sum >= _left").select("_leaf", F.col("_bucket").alias("_edge"), "_before"))
    ready = joined(ready, edge, "left")
    # Without an edge all buckets are taken, if any of the epoch is.
    inside = (F.col("_left") > 0) & (F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    at_edge = ready.where("_bucket = _edge and _left > 0")
    running = Window.partitionBy("_leaf", "_edge").orderBy(F.shiftleft("_order", bits), "_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = at_edge.withColumn("_in", F.col("_before") + F.coalesce(F.sum("_tokens").over(running), F.lit(0)) < F.col("_left"))
    rest = ready.where("not (_bucket <=> _edge and _left > 0)").withColumn("_in", inside)
    taken = rest.unionByName(at_edge).withColumn("_n", F.col("_whole") + F.col("_in").cast("int")).where("_n > 0")
    out = taken.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in kept], F.col("_domain").alias("domain"), F.col("_language").alias("language"), F.col("_source").alias("source_leaf"), F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))
