"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, durable
from ..operators.skew import split_join

# The generator polynomial of the binary [23,12,7] Golay code, and the widths of three and of four segments.
GENERATOR, WIDTHS = 0b110001110101, {3: (22, 21, 21), 4: (16, 16, 16, 16)}
# From so many different fingerprints on, keys of 40 bits are taken in place of 24.
WIDE = 1 << 22
CHUNK = 1 << 15


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one UTF-8 text; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n, ones = max(1, len(words) - size + 1), np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(at, min(n, at + CHUNK))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """Fingerprint of each text as a signed long; null and wordless texts get 0."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text.cast("binary"))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of weight 3 or less of each syndrome."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low, high = np.array([rest(x) for x in range(1 << 12)]), np.array([rest(x << 12) for x in range(1 << 11)])
    errors = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 4095] ^ high[e >> 12]] = e
    return low, high, errors


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit vector."""
    low, high, errors = golay_tables()
    return (v ^ errors[low[v & 4095] ^ high[v >> 12]]) >> 11


def segments(fps: np.ndarray, parts: int = 3) -> list[np.ndarray]:
    u, out, at = fps.view(np.uint64), [], 0
    for width in WIDTHS[parts]:
        out.append(((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def fuzzy_keys(fps: np.ndarray, side: int, parts: int = 3) -> list[np.ndarray]:
    """Keys of each fingerprint on one side of the join.

    A segment's ball are the codeword indices of all vectors within one bit of it: 1 or 6. If two vectors differ in one
    bit at most, either's own index is in the other's ball. So for a pair of segments, side 0 emits ball x own index
    and side 1 own x ball, and both sides meet where each segment holds one error at most.

    With three segments, 3 errors leave some two of them with one error at most each: three kinds of keys of 24 bits.
    With four, three segments hold 2 errors at most, one of them none: twelve kinds of 40 bits (the errorless segment
    as it is), so that far fewer strangers meet. Two fingerprints within 3 bits share a key whichever side each is
    taken from, for either number of segments."""
    raw = segments(fps, parts)
    own, ball = [], []
    for s, width in zip(raw, WIDTHS[parts], strict=True):
        own.append(decode(s))
        ball.append(np.sort(np.stack([own[-1], *(decode(s ^ (1 << b)) for b in range(width))], axis=1), axis=1))
    fresh = [np.concatenate([np.ones((len(fps), 1), bool), b[:, 1:] != b[:, :-1]], axis=1) for b in ball]
    kinds = [(a, b, c) for a, b in combinations(range(parts), 2) for c in (range(parts) if parts == 4 else [None]) if c not in (a, b)]
    out = []
    for k, (a, b, c) in enumerate(kinds):
        head = np.full(len(fps), k, dtype=np.int64) if c is None else k << 16 | raw[c]
        wide, narrow = (a, b) if side == 0 else (b, a)
        out.append(np.where(fresh[wide], (head << 24 | own[narrow] << 12)[:, None] | ball[wide], -1) if side == 0 else np.where(fresh[wide], (head << 24)[:, None] | ball[wide] << 12 | own[narrow][:, None], -1))
    keys = np.concatenate(out, axis=1)
    return [row[row >= 0] for row in keys]


def keys_column(fp: str, side: int, parts: int) -> Column:
    @F.pandas_udf("array<long>")
    def keys(fps: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(fps.to_numpy(dtype=np.int64), side, parts))

    return keys(F.col(fp))


def neighbour_links(grouped: DataFrame, bits: int = 3, wide: int = WIDE) -> DataFrame:
    """(b, a): for each root b of grouped (fp, root), the smallest other root a with a fingerprint within `bits` bits
    of one of b's. At most one row per root, brought down before the shuffle, however many pairs are near."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys cover 0 to 3 differing bits")
    parts = 4 if grouped.count() >= wide else 3
    left = grouped.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.explode(keys_column("fp", 0, parts)).alias("key"))
    right = grouped.select(F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(keys_column("fp", 1, parts)).alias("key"))
    near = (F.col("ra") != F.col("rb")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return left.join(right, "key").where(near).groupBy(F.col("rb").alias("b")).agg(F.min("ra").alias("a"))


def fingerprint_groups(distinct_fps: DataFrame, bits: int = 3, wide: int = WIDE) -> DataFrame:
    """(fp, root) of the distinct longs in column fp: groups linked at `bits` differing bits (3 at most), root a
    group's smallest fp.

    Pairs are not put out: in a round each group is linked to the smallest of its neighbours (neighbour_links), and
    linked groups become one, until no neighbours are apart. Of `wide` fingerprints or more the longer keys are taken,
    which give the same links with fewer strangers per key."""
    grouped = durable(distinct_fps.select("fp", F.col("fp").alias("root")))
    while True:
        links = durable(neighbour_links(grouped, bits, wide))
        if links.isEmpty():
            return grouped
        moved = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
        grouped = durable(split_join(grouped, moved, "root", "left").select("fp", F.coalesce("to", "root").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id, root: the component's smallest fp) of every row.

    Rows with equal fingerprints are one node of the graph, so copies are never paired. component_id is the smallest
    doc_id reachable; null ids are passed over, and a component of null ids alone has a null id. Null, empty and
    wordless texts have fingerprint 0 and are linked like any other; repeated rows are kept; an empty table gives an
    empty one. Other columns of docs are not read.

    Ids are brought down to one per fingerprint and then one per component before anything is joined; a component is
    joined to its fingerprints and a fingerprint to its rows with the hot ones apart."""
    fps = durable(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = durable(fingerprint_groups(least.select("fp"), bits).join(least, "fp"))
    named = durable(split_join(nodes.select("fp", "root"), nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root"))
    return split_join(fps, named, "fp").select("doc_id", "fp", "component_id", "root")
