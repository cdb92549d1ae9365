"""One document of each group of near-duplicates: SimHash links found by Golay keys, completed, verified by exact Jaccard.

SimHash links fingerprints within 3 bits of 64. That finds few pairs of a similarity just over 0.8 (7 % by simulation,
55 % at 0.95), so what it leaves apart is sought in bands of minima over the same shingles. Each link, whichever way it
was found, is held against the exact similarity of the two texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components, durable
from ..operators.skew import hot_keys, split_join
from .common import fits_broadcast, own_names
from .simhash import neighbour_links

# Bands of ROWS minima each: a pair of similarity 0.8 shares none of 32 bands of 5 with probability 3e-6.
BANDS, ROWS, TURNS, WORDS, CHUNK = 32, 5, 2, 32, 2048
HELD = 8  # sets of shingles held at a time
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """XXH64 of words, mostly taken once each; beyond MOST words it starts anew."""

    MOST = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_set(text: bytes | None, size: int) -> set[bytes]:
    """The distinct runs of `size` words; a shorter text is one run."""
    ws = words_of(text)
    return {b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: bytes | None, size: int, memo: Hashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `size` words."""
    words = words_of(text)
    h = np.array([memo[w] for w in words], dtype=np.uint64)
    size = min(size, len(words))
    out = np.zeros(max(1, len(words) - size + 1), dtype=np.uint64)
    for j in range(size):
        out = mixed(out * FACTOR + h[j : j + len(out)])
    return np.unique(out)


def majority(x: np.ndarray) -> int:
    """SimHash fingerprint of hashed shingles: the bits set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        ones += np.unpackbits(x[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


def signatures(text: Column, size: int) -> Column:
    """Per text: node, a hash of its set of shingles; fp, their SimHash; n, their number; bands, a hash of each band of
    minima."""

    @F.pandas_udf("node long, fp long, n long, bands array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rng, memo = np.random.default_rng(5), Hashes()
        a, b = rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
        a = a * np.uint64(2) + np.uint64(1)
        node, fp = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64)
        n, least = np.empty(len(texts), np.int64), np.empty((len(texts), BANDS * ROWS), np.uint64)
        for i, t in enumerate(texts):
            x = shingle_hashes(t, size, memo)
            node[i], fp[i], n[i] = xxhash.xxh64_intdigest(x.tobytes()), majority(x), len(x)
            least[i] = np.min([(a * x[at : at + CHUNK] + b).min(1) for at in range(0, len(x), CHUNK)], axis=0)
        least = least.reshape(-1, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
        for j in range(ROWS):
            keys = mixed(keys * FACTOR + least[:, :, j])
        return pd.DataFrame({"node": node.view(np.int64), "fp": fp.view(np.int64), "n": n, "bands": list(keys.view(np.int64))})

    return sign(text.cast("binary"))


def similarity(a: Column, b: Column, size: int) -> Column:
    """Jaccard similarity of the sets of shingles of two texts; b is taken from a few texts at a time."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out, held = [], {}
        for x, y in zip(a, b, strict=True):
            if y not in held:
                if len(held) == HELD:
                    held.clear()
                held[y] = shingle_set(y, size)
            x, y = shingle_set(x, size), held[y]
            both = len(x & y)
            out.append(both / (len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return jaccard(a.cast("binary"), b.cast("binary"))


def parities(text: Column, size: int) -> Column:
    """n, the number of a text's shingles, and bits, WORDS longs: bit i tells whether the hashes of an odd number of
    them fall to i. In two texts as many bits differ as shingles are in one of them only, at most."""

    @F.pandas_udf("n long, bits array<long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        memo, n, bits = Hashes(), [], []
        for t in texts:
            x = shingle_hashes(t, size, memo)
            odd = np.bincount((x >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
            n.append(len(x))
            bits.append(np.packbits(odd.astype(bool)).view(np.int64))
        return pd.DataFrame({"n": n, "bits": bits})

    return marks(text.cast("binary"))


def links(rows: DataFrame, text: str, size: int, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts have a similarity of `least` or more, enough of them to connect all that do.

    First each SimHash fingerprint's least node is compared with that of its smallest neighbour within 3 bits. Then, in
    each of TURNS turns, each node of a bucket (texts that share a band) is compared with one node of it, and buckets
    whose nodes are all connected are done. In the first turn that is the node with the most others in all its buckets,
    as the text that others were made from has, in later turns another one each time. What is still apart in a bucket
    is paired where a bound allows it: the nodes that are not of the bucket's largest group with those of other groups, if
    the bits in which their `parities` differ leave room for the similarity. The bound never excludes a link, and for
    texts of up to some thousand words few others pass it.

    The text with more partners comes last in a comparison, and hot ones by broadcast; buckets that hold many nodes meet
    their facts where they are (split_join). Texts are fetched for nodes that share a bucket or a SimHash neighbourhood."""
    nodes = durable(rows.groupBy("_s.node", "_s.fp").agg(F.min("_uid").alias("_uid")))
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    by_print = neighbour_links(durable(prints.select("fp", F.col("fp").alias("root"))))
    side = lambda k: prints.withColumnsRenamed({"fp": k, "node": f"n{k}"})
    close = durable(by_print.join(side("a"), "a").join(side("b"), "b").select(F.col("nb").alias("a"), F.col("na").alias("b")).distinct())
    signed = rows.join(nodes.select("_uid"), "_uid", "left_semi").select("_s.node", "_s.n", F.explode("_s.bands").alias("key"))
    common = durable(signed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    if fits_broadcast(common.count(), 16):
        members = durable(signed.join(F.broadcast(common), "key"))
    else:
        members = durable(split_join(durable(signed), common, "key"))
    fellows = members.groupBy("node").agg(F.sum("c").alias("c"))
    members = durable(members.drop("c").join(fellows, "node").select("key", "node", "n", "c"))
    asked = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("_uid")
    texts = durable(rows.select("_uid", "_s.node", F.coalesce(text, F.lit("")).alias("_text")).join(wanted, "_uid", "left_semi").select("node", "_text"))
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-9)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), b the one with more partners, those that are alike."""
        one, two = (texts.select(F.col("node").alias(k), F.col("_text").alias(f"t{k}")) for k in "ab")
        alike, hot = similarity(F.col("ta"), F.col("tb"), size) >= F.lit(least), hot_keys(pairs, "b")
        if hot is None:
            return durable(pairs.join(two, "b").join(one, "a").where(alike).select("a", "b"))
        few = F.broadcast(two.join(F.broadcast(hot), "b", "left_semi"))
        told = pairs.join(F.broadcast(hot), "b", "left_anti").join(two, "b").join(one, "a").unionByName(pairs.join(one, "a").join(few, "b"))
        return durable(told.where(alike).select("a", "b"))

    def fresh(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs (a, b) not tried in either order, each once."""
        key = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
        new = pairs.groupBy(*key).agg(F.max("b").alias("b")).join(tried.select(*key), ["x", "y"], "left_anti")
        return durable(new.select(F.when(F.col("b") == F.col("y"), F.col("x")).otherwise(F.col("y")).alias("a"), "b"))

    def with_roots(members: DataFrame, found: DataFrame) -> DataFrame:
        return members.select("key", "node", "n", "c").join(connected_components(found), "node", "left").select("key", "node", "n", "c", F.coalesce("root", "node").alias("root"))

    def still_open(members: DataFrame, *facts: Column) -> DataFrame:
        """Members of buckets that hold several groups, with facts of their bucket."""
        buckets = members.groupBy("key").agg(*facts, F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
        return durable(split_join(members, durable(buckets), "key"))

    found, tried = verified(close), close
    members = durable(with_roots(members, found))
    for turn in range(TURNS):
        order = -F.col("c") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        members = still_open(members, F.min(F.struct(order.alias("order"), "node", "n", "root")).alias("first"))
        apart = (F.col("root") != F.col("first.root")) & near(F.col("n"), F.col("first.n"))
        pairs = fresh(members.where(apart).select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct(), tried)
        tried, found = tried.union(pairs), found.union(verified(pairs))
        members = durable(with_roots(members, found))
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("k"))
    largest = durable(sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main"))
    open_ = durable(split_join(members, largest, "key"))
    marked = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", parities(F.col("_text"), size).alias("s"))
    words = [F.col("s.bits")[i].alias(f"b{i}") for i in range(WORDS)]
    told = durable(open_.select("key", "node", "root", "main").join(durable(marked.select("node", "s.n", *words)), "node"))
    x, y = told.where("root <> main").alias("x"), told.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    both = F.col("x.n") + F.col("y.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(WORDS)])
    # With d shingles in one text only, (n + n - d) / 2 are in both and (n + n + d) / 2 in either.
    enough = (both - differ) >= (both + differ) * F.lit(least - 1e-9)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & near(F.col("x.n"), F.col("y.n")) & enough
    rest = x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return found.union(verified(fresh(rest, tried)))


@own_names
def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of texts connected by a Jaccard similarity of `least` or more of their `size`-word
    shingles: that of the smallest doc_id (null after all others), and of several rows with this id the least by a hash
    of their columns. Words are as in simhash; null texts count as empty, and texts with equal sets of shingles are one
    node. Rows are brought down to one per node, and nodes to one per group, before they are joined, so copies and large
    groups are no hot keys. Equal rows are one node, so one of them stays; an empty table gives an empty one."""
    rows = durable(docs.withColumns({"_s": signatures(F.col(text), size), "_uid": F.monotonically_increasing_id()}))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(*plain), F.col("_uid").alias("_uid"))
    best = durable(rows.groupBy("_s.node").agg(F.min(order).alias("_best")))
    roots = connected_components(links(rows, text, size, least))
    kept = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("_best").alias("_best")).select("_best._uid")
    return rows.join(kept, "_uid", "left_semi").select(docs.columns)
