"""Prefix trie of conversations: Patricia construction over the sorted sequences of turns.

A turn is a 16-byte hash of role and text, a conversation's path the hashes one after another, so texts are never shuffled
and paths sort as sequences do. Different paths are dealt by ranges and each range is one pass with a stack: it makes only
ends, leaves and branches (where neighbours part), with whole edges between them, adds up on this compressed tree, and
when an edge is done gives its unary nodes from sums over the edge's tail. Nodes on the path that a range shares with its
neighbours are given in part, each range's part, and added up by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import ranged
from ..operators.skew import split_join
from .common import durable

SHARED, MOST_HEAD = 5, 9  # fixed values: conversations that share a head, and one more than its turns at most
WIDTH = 16
NONE = hashlib.sha256(b"").hexdigest()


def turn_hash(role: Column, text: Column) -> Column:
    """32 hex digits of a turn's role and text; null counts as empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path and sizes (UTF-8 bytes of each text) of conversations given as rows of conv_id, turn, role, text.

    Turns stand in the order of turn, null first, equal ones in that of their hash. Conversation c gets the first h turns of
    conversation c - c % 5 (fewer if there are fewer, none without it) in place of its own first h, h = crc32(c) % 9; it
    may be left without turns. Rows without conv_id take no part, repeated rows are turns of their own, and an empty table
    gives an empty one. A conversation's hashes, 16 bytes a turn, are one value."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), turn_hash(F.col("role"), F.col("text")).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    own = turns.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = durable(own.select("conv_id", F.transform("t", lambda t: F.struct(t["hash"].alias("hash"), t["size"].alias("size"))).alias("t")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    heads = own.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("of"), F.slice("t", 1, MOST_HEAD - 1).alias("head"))
    both = own.withColumns({"of": F.col("conv_id") - F.col("conv_id") % SHARED, "h": h}).join(heads, "of", "left")
    none = F.array().cast("array<struct<hash:string,size:bigint>>")
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("t", F.col("h") + 1, F.size("t")))
    return both.select("conv_id", whole.alias("t")).select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["hash"]), "")).alias("path"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Each different path once: conv_id, its least, path, sizes, n, how many have it, and ends, the SHA-256 of their
    conv_ids in ascending order, joined by commas.

    A path's conv_ids are dealt by ranges and joined to strings there, so a path that many have is split; the digest
    reads one string after another."""
    paths = durable(paths.withColumn("seq", F.unhex(F.md5("path"))))
    dealt = ranged(paths.select("seq", "conv_id"), "seq", "conv_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = dealt.groupBy("seq", "_p").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), joined.alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, conv, n, hashed = None, 0, 0, None
        for b in batches:
            out = []
            for s, k, c, text in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("seq", "n", "conv_id", "text")), strict=True):
                if s != seq:
                    if hashed:
                        out.append((seq, conv, n, hashed.hexdigest()))
                    seq, conv, n, hashed = s, c, 0, hashlib.sha256()
                elif n:
                    hashed.update(b",")
                n += k
                hashed.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, x, strict=True)) for x in out], schema=DIGESTS)
        if hashed:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, (seq, conv, n, hashed.hexdigest()), strict=True))], schema=DIGESTS)

    digests = parts.repartition("seq").sortWithinPartitions("seq", "_p").mapInArrow(digest, "seq binary, conv_id long, n long, ends string")
    return digests.drop("seq").join(paths.select("conv_id", "path", "sizes"), "conv_id")


DIGESTS = pa.schema([("seq", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
FOUND = pa.schema([("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary())])
DONE, WAITS, PART = 0, 1, 2  # kinds: a whole node; one whose parent is shared by ranges; a range's part of a shared node


def common_turns(a: bytes, b: bytes) -> int:
    """The number of first turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


class Point:
    """A node of the compressed tree while it is open. new: first met in this range, so counted here."""

    __slots__ = ("children", "depth", "ends", "inner", "leaves", "least", "n", "new", "saved", "waiting")

    def __init__(self, depth: int, new: bool) -> None:
        self.depth, self.new, self.n, self.least, self.children, self.leaves, self.saved = depth, new, 0, None, 0, 0, 0
        self.ends, self.inner, self.waiting = None, False, []

    def take(self, n: int, least: int, leaves: int, saved: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.leaves += leaves
        self.saved += saved


class Range:
    """One range of sorted paths. before and after: the turns that its first and last path share with the neighbouring
    ranges' nearest paths, -1 where there is none. Nodes go to `out` as tuples of FOUND."""

    def __init__(self, before: int, after: int) -> None:
        self.after, self.out = after, []
        self.path, self.sizes = None, []
        self.stack = [Point(d, d > before) for d in range(max(before, 0) + 1)]

    def key(self, depth: int) -> bytes | None:
        return None if depth < 0 else hashlib.md5(self.path[: depth * WIDTH]).digest()

    def add(self, path: bytes, sizes: list[int], n: int, conv_id: int, ends: str) -> None:
        if self.path is not None:
            self.close(common_turns(self.path, path))
        self.path, self.sizes = path, sizes
        if len(sizes) > self.stack[-1].depth:
            self.stack.append(Point(len(sizes), True))
        end = self.stack[-1]
        end.ends = ends
        end.take(n, conv_id, 0, 0)

    def close(self, depth: int, shared: bool = False) -> None:
        """Closes the points below `depth`; what is left open at the top of the stack has that depth."""
        while self.stack and self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack and self.stack[-1].depth < depth:
                self.stack.append(Point(depth, True))
            self.give(p, self.stack[-1] if self.stack else None, shared or not p.new)

    def give(self, p: Point, parent: Point | None, shared: bool) -> None:
        """Gives out a point and the unary nodes between it and its parent; shared: each is a part only."""
        top = (parent.depth if parent else -1) + 1
        if not p.inner and not (shared and p.new):
            p.leaves += 1
        size = lambda d: self.sizes[d - 1] if d else 0
        p.saved += (p.n - p.new) * size(p.depth)
        for fields in p.waiting:
            kind = (WAITS, fields[0], fields[1], None) if shared else (DONE, fields[0], fields[1], p.least)
            self.out.append((*kind, *fields[2:], None, self.key(p.depth) if shared else None))
        saved, children, ends = p.saved, p.children, p.ends
        for d in range(p.depth, top - 1, -1):
            if d < p.depth:
                saved, children, ends = saved + (p.n - 1) * size(d), 1, None
            counts = (p.n, children, p.leaves, saved, ends)
            if shared:
                self.out.append((PART, p.least, d, None, *counts, self.key(d), self.key(d - 1)))
            elif d > top or parent is None:
                self.out.append((DONE, p.least, d, p.least if d else None, *counts, None, None))
            else:
                parent.waiting.append((p.least, d, *counts))
        if parent:
            parent.take(p.n, p.least, p.leaves, saved)
            parent.children += p.new
            parent.inner = True

    def finish(self) -> None:
        self.close(self.after)
        self.close(-1, shared=self.after >= 0)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _boundaries(rows: DataFrame) -> DataFrame:
    """_p, before and after of each range."""

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else common_turns(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    ends = durable(rows.groupBy("_p").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    numbers = ends.select("_p", F.row_number().over(Window.orderBy("_p")).alias("k"))  # a row per range
    ends = ends.join(numbers, "_p")
    near = ends.join(ends.select((F.col("k") + 1).alias("k"), F.col("last").alias("left")), "k", "left").join(ends.select((F.col("k") - 1).alias("k"), F.col("first").alias("right")), "k", "left")
    return near.select("_p", common("left", "first").alias("before"), common("last", "right").alias("after"))


def nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, sizes, as `rebuilt` gives): conv_id, the least member, depth,
    parent_conv_id (the root's: null), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A member of a node begins with its turns; equal conversations are one path. Conversations without turns end at the
    root, which is there if any conversation is; an empty table gives no node. Columns of other names play no part."""
    rows = ranged(distinct_paths(paths.select("conv_id", "path", "sizes")), "path")
    told = rows.join(F.broadcast(_boundaries(rows)), "_p")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current = None, None
        batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), FOUND.types, strict=True)], schema=FOUND)
        for b in batches:
            for r in b.to_pylist():
                if r["_p"] != current:
                    if own:
                        own.finish()
                        yield batch(own.taken())
                    current, own = r["_p"], Range(r["before"], r["after"])
                own.add(r["path"], r["sizes"], r["n"], r["conv_id"], r["ends"])
                if len(own.out) >= 10_000:
                    yield batch(own.taken())
        if own:
            own.finish()
            yield batch(own.taken())

    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in FOUND)
    found = durable(told.repartition("_p").sortWithinPartitions("_p", "path").mapInArrow(build, schema))
    sums = [F.sum(c).alias(c) for c in COUNTS]
    merged = found.where(F.col("kind") == PART).groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.first("parent_key", True).alias("parent_key"))
    merged = durable(merged)
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", *COUNTS, F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")]
    waits = durable(found.where(F.col("kind") == WAITS))
    late = lambda rows, how: split_join(rows.drop("parent_conv_id"), parents, "parent_key", how).withColumnRenamed("above", "parent_conv_id").select(*columns)
    return found.where(F.col("kind") == DONE).select(*columns).unionByName(late(waits, "inner")).unionByName(late(merged, "left"))
