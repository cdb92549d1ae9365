"""Largest sets of cases with two controls each, of least total rank, between groups of equal cases and equal controls.

Most cases are sure of two controls: those that no alternating path joins to a case that a largest flow leaves open. Only
the others compete, and only with those of their connected piece. Controls dealt to a piece in order of rank, one by one,
cost the least; if every case has two or none then, that is the answer. Else the piece's rows are solved as a weighted
matching, which starts from there."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import assign
from .graph import durable
from .grouped import Groups, _by_degree, _Network, _read, _tasks, parts

PIECES = "part long, p long, c long, most long, n_c long"


def contested(e: pd.DataFrame) -> pd.DataFrame:
    """most: what a case group can have at all. A row (c null) for each group that is sure of it; the edges of the others,
    with part, the first group of their piece."""
    graph, n_p, n_c, _ = _read(e)
    most = {p: min(n_p[p], sum(n_c[c] for c in cs) // 2) for p, cs in graph.items()}
    net = _Network(graph, {p: 2 * n for p, n in most.items()}, n_c)
    net.fill(_by_degree(graph))
    _, open_, _ = net.reached([p for p in graph if net.total(p) < net.supply[p]])
    takers: dict[int, list[int]] = {}
    for p in open_:
        for c in graph[p]:
            takers.setdefault(c, []).append(p)
    part: dict[int, int] = {}
    for first in sorted(open_):
        queue = [] if first in part else [first]
        part.setdefault(first, first)
        while queue:
            for c in graph[queue.pop()]:
                for q in takers.pop(c, ()):
                    if q not in part:
                        part[q] = first
                        queue.append(q)
    rows = [(None, p, None, n, None) for p, n in most.items() if p not in part]
    rows += [(r, p, c, most[p], n_c[c]) for p, r in part.items() for c in graph[p]]
    return pd.DataFrame(rows, columns=["part", "p", "c", "most", "n_c"], dtype="object").astype("Int64")


def _dealt(graph: dict, ranks: dict, room: dict) -> tuple[dict, dict]:
    """Units of each case group, dealt in order of rank as long as there is a path, and the rank at which a control was
    out of reach. ranks: of each group's cases, ascending."""
    net = _Network(graph, {p: 2 * len(r) for p, r in ranks.items()}, room)
    until, full = {}, set()
    for r, p, _ in sorted((r, p, i) for p, rs in ranks.items() for i, r in enumerate(rs)):
        left = 0 if p in full else 2
        while left:
            by_c, by_p, end = net.reached([p])
            if end is None:
                full |= by_p.keys()
                until = dict.fromkeys(by_c, r) | until
                break
            left -= net.push(by_c, by_p, end, left)
    return net.have, until


class _Matching:
    """A matching of most weight by Edmonds' method: duals y of vertices and z of blossoms, trees from all vertices without a
    mate at once. Edges (u, v, w) have y[u] + y[v] >= w at the start, and those of mates are tight. Vertices from `may` on
    may stay `alone`, at a loss of `high` each, so their y is at least -high. y, w and high are even, so all steps are whole."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, y: np.ndarray, mate: list[int], may: int, high: int) -> None:
        self.u, self.v, self.w, self.y, self.mate, self.may, self.high = u, v, w, y, mate, may, high
        self.alone: set[int] = set()
        n = len(mate)
        self.top, self.label = np.arange(n), np.zeros(n, dtype=np.int8)  # of vertices: outer blossom; 1 even, 2 odd, 0 no tree
        self.base: dict[int, int] = {i: i for i in range(n)}
        self.leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
        self.inside: dict[int, int] = {}
        self.children: dict[int, list[int]] = {}
        self.links: dict[int, list[tuple[int, int]]] = {}
        self.z: dict[int, int] = {}
        self.entry: dict[int, tuple[int, int]] = {}
        self.names = n

    def solve(self) -> list[int]:
        while roots := [i for i, m in enumerate(self.mate) if m == -1 and i not in self.alone]:
            self.label[:] = 0
            for i in roots:
                self.mark(int(self.top[i]), 1)
            while not self.step():
                pass
        return self.mate

    def mark(self, b: int, label: int) -> None:
        self.label[self.leaves[b]] = label

    def state(self, b: int) -> int:
        return int(self.label[self.leaves[b][0]])

    def step(self) -> bool:
        """One change of the duals and what it makes tight; whether the matching has grown."""
        a, b = self.label[self.u], self.label[self.v]
        both = (a == 1) & (b == 1) & (self.top[self.u] != self.top[self.v])
        at = np.flatnonzero(both | (a + b == 1))
        both = both[at]
        slack = self.y[self.u[at]] + self.y[self.v[at]] - self.w[at]
        slack = np.where(both, slack // 2, slack)
        odd = [x for x in self.z if x not in self.inside and self.state(x) == 2]
        even = self.may + np.flatnonzero(self.label[self.may :] == 1)
        steps = [*(x.min() for x in (slack, self.y[even] + self.high) if len(x)), *(self.z[x] // 2 for x in odd)]
        if not steps:
            raise ValueError("no matching of all that must have a mate")
        d = min(steps)
        self.y = self.y + np.array([0, -1, 1], dtype=self.y.dtype)[self.label] * d
        for x in self.z:
            if x not in self.inside:
                self.z[x] += {0: 0, 1: 2, 2: -2}[self.state(x)] * d
        for e in at[slack == d]:
            if self.tight(int(self.u[e]), int(self.v[e])):
                return True
        lowest = even[self.y[even] == -self.high]
        if len(lowest):
            self.augment(int(lowest[0]), -1)
            self.alone.add(int(lowest[0]))
            return True
        for x in odd:
            if x in self.z and x not in self.inside and self.state(x) == 2 and self.z[x] == 0:
                self.expand(x)
        return False

    def tight(self, u: int, v: int) -> bool:
        if self.label[u] != 1:
            u, v = v, u
        b = int(self.top[v])
        if self.label[v] == 0 and self.mate[self.base[b]] == -1:
            self.alone.discard(self.base[b])
            self.augment(u, v)
            self.augment(v, u)
            return True
        if self.label[v] == 0:
            self.entry[b] = u, v
            self.mark(b, 2)
            self.mark(int(self.top[self.mate[self.base[b]]]), 1)
        elif self.label[v] == 1 and self.top[u] != b:
            one, two = self.path(u), self.path(v)
            if one[0][-1] != two[0][-1]:
                self.augment(u, v)
                self.augment(v, u)
                return True
            self.shrink(u, v, one, two)
        return False

    def path(self, v: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Blossoms from that of v to the root, and the edges between them."""
        nodes, ups = [int(self.top[v])], []
        while (x := self.mate[self.base[nodes[-1]]]) != -1:
            ups.append((self.base[nodes[-1]], x))
            nodes.append(int(self.top[x]))
            p, q = self.entry[nodes[-1]]
            ups.append((q, p))
            nodes.append(int(self.top[p]))
        return nodes, ups

    def augment(self, v: int, w: int) -> None:
        while True:
            b = int(self.top[v])
            x = self.mate[self.base[b]]
            self.rebase(b, v)
            self.mate[v] = w
            if x == -1:
                return
            t = int(self.top[x])
            v, w = self.entry[t]
            self.rebase(t, w)
            self.mate[w] = v

    def rebase(self, b: int, v: int) -> None:
        """Makes v the vertex of b whose mate is outside."""
        if b not in self.z:
            return
        child = v
        while self.inside[child] != b:
            child = self.inside[child]
        self.rebase(child, v)
        own, links = self.children[b], self.links[b]
        i = own.index(child)
        for j in range(0, i, 2) if i % 2 == 0 else range(i + 1, len(own), 2):
            p, q = links[j]
            self.rebase(own[j], p)
            self.rebase(own[(j + 1) % len(own)], q)
            self.mate[p], self.mate[q] = q, p
        self.children[b], self.links[b], self.base[b] = own[i:] + own[:i], links[i:] + links[:i], v

    def shrink(self, u: int, v: int, one: tuple, two: tuple) -> None:
        (a, up_a), (b, up_b) = one, two
        i = next(k for k, x in enumerate(a) if x in set(b))
        j = b.index(a[i])
        new, self.names = self.names, self.names + 1
        self.children[new] = [a[i], *a[:i][::-1], *b[:j]]
        self.links[new] = [*((q, p) for p, q in up_a[:i][::-1]), (u, v), *up_b[:j]]
        self.base[new], self.z[new] = self.base[a[i]], 0
        self.inside |= dict.fromkeys(self.children[new], new)
        self.leaves[new] = [x for c in self.children[new] for x in self.leaves[c]]
        self.top[self.leaves[new]] = new
        self.mark(new, 1)

    def expand(self, b: int) -> None:
        """Takes an odd blossom apart: its children on the even way from its entry to its base stay in the tree."""
        own, links, entry = self.children.pop(b), self.links.pop(b), self.entry[b]
        child = entry[1]
        while self.inside[child] != b:
            child = self.inside[child]
        del self.z[b], self.leaves[b], self.base[b]
        for c in own:
            del self.inside[c]
            self.top[self.leaves[c]] = c
            self.mark(c, 0)
        k, i = len(own), own.index(child)
        way = range(i, -1, -1) if i % 2 == 0 else range(i, k + 1)
        before = None
        for step, j in enumerate(way):
            if step % 2 == 0:
                self.mark(own[j % k], 2)
                if before is not None:
                    p, q = links[j] if j < before else links[before]
                    entry = (q, p) if j < before else (p, q)
                self.entry[own[j % k]] = entry
            else:
                self.mark(own[j % k], 1)
            before = j


def _matched(graph: dict, rank: dict, have: dict, until: dict) -> list:
    """The cases of a largest set of least ranks (whole numbers). A case is two vertices with an edge between them, matched
    if it gets none, and edges to its controls; have, until: what `_dealt` gives, in which some have one control only, whose
    controls are without a mate at the start. A control stays alone at a loss of more than all ranks."""
    cases, controls = {p: 2 * i for i, p in enumerate(graph)}, {c: 2 * len(graph) + i for i, c in enumerate(until)}
    n = 2 * len(cases) + len(controls)
    mate = [-1] * n
    for p, a in cases.items():
        mate[a], mate[a + 1] = a + 1, a
        if len(have[p]) == 2:
            for i, c in enumerate(have[p]):
                mate[a + i], mate[controls[c]] = controls[c], a + i
    high = 4 * (sum(rank.values()) + 1)
    kind = np.int64 if high < 2**58 else object  # Python's whole numbers, which have no bound
    y = [2 * max([rank[p], *(until[c] for c in cs)]) for p, cs in graph.items() for _ in range(2)] + [-2 * r for r in until.values()]
    u, v, w = [], [], []
    for some in (
        ((a, a + 1, 4 * rank[p]) for p, a in cases.items()),
        ((cases[p] + i, controls[c], 0) for p, cs in graph.items() for c in cs for i in range(2)),
    ):
        for x, z, weight in some:
            u.append(x)
            v.append(z)
            w.append(weight)
    found = _Matching(np.array(u), np.array(v), np.array(w, dtype=kind), np.array(y, dtype=kind), mate, 2 * len(cases), high).solve()
    return [p for p, a in cases.items() if found[a] != a + 1]


def least_ranked(graph: dict, ranks: dict, room: dict) -> dict[int, int]:
    """How many of each case group are in a largest set of least ranks, its first ones. ranks: of those of each group that
    can have two controls at all, ascending."""
    have, _ = _dealt(graph, ranks, room)
    total = {p: sum(own.values()) for p, own in have.items()}
    if not any(n % 2 for n in total.values()):
        return {p: n // 2 for p, n in total.items()}
    scale = math.lcm(*(float(r).as_integer_ratio()[1] for rs in ranks.values() for r in rs))
    rank = {(p, i): int(float(r).as_integer_ratio()[0] * (scale // float(r).as_integer_ratio()[1])) for p, rs in ranks.items() for i, r in enumerate(rs)}
    whole = {(p, i): [(c, j) for c in graph[p] for j in range(room[c])] for p, i in rank}
    have, until = _dealt(whole, {k: [r] for k, r in rank.items()}, {k: 1 for cs in whole.values() for k in cs})
    out = dict.fromkeys(graph, 0)
    for p, _ in _matched(whole, rank, have, until):
        out[p] += 1
    return out


def ranked_support(g: Groups, ranks: DataFrame, largest: int = assign.LARGEST_FLOW) -> DataFrame:
    """(p): most cases that can all get two controls without reuse, and of these sets one of the least sum of ranks (p,
    rank >= 0). Exact at every size: components over `largest` group edges, too, leave to a task but the pieces in which
    cases compete."""

    def solve(key: tuple, e: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        graph: dict[int, list[int]] = {}
        for p, c in e.sort_values(["p", "c"])[["p", "c"]].itertuples(index=False):
            graph.setdefault(p, []).append(c)
        own = {p: sorted(rs)[:n] for (p, n), rs in r.groupby(["p", "most"])["rank"]}
        out = least_ranked(graph, own, dict(zip(e["c"], e["n_c"], strict=True)))
        return pd.DataFrame(list(out.items()), columns=["first", "_n"]).astype("int64")

    small, big = parts(g, largest)
    found = _tasks(small)[0].groupBy("_task").applyInPandas(contested, PIECES)
    members = g.cases
    if big is not None:
        e = durable(big.select("p", "c").distinct())
        able = durable(e.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p", F.lit(2).alias("d")))
        e = durable(e.join(able, "p", "left_semi"))
        cases = durable(assign.open_cases(e, able, 1))
        left = durable(e.join(cases, "p", "left_semi"))
        sure = able.join(cases, "p", "left_anti").select(F.lit(None).cast("long").alias("part"), "p", F.lit(None).cast("long").alias("c"), F.lit(1).cast("long").alias("most"), F.lit(None).cast("long").alias("n_c"))
        one = F.lit(1).cast("long")
        late = assign.with_components(left.withColumn("cost", F.lit(0.0))).select(F.col("component").alias("part"), "p", "c", one.alias("most"), one.alias("n_c"))
        found = found.union(sure).union(late)
        rows = big.select("p").distinct()
        members = durable(members.join(rows, "p", "left_anti").union(rows.select("p", F.col("p").alias("first"))))
    found = durable(found)
    ranked = durable(members.join(ranks.select("p", F.col("rank").cast("double").alias("rank")), "p"))
    pieces = found.where("part is not null")
    own = pieces.select("part", F.col("p").alias("first"), "most").distinct().join(ranked, "first")
    own = durable(own.select("part", F.col("first").alias("p"), "most", "rank"))
    solved = pieces.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(solve, "first long, _n long")
    served = durable(found.where("part is null").select(F.col("p").alias("first"), F.col("most").alias("_n")).union(solved))
    place = F.row_number().over(Window.partitionBy("first").orderBy("rank", "p"))
    return ranked.withColumn("_k", place).join(served, "first").where(F.col("_k") <= F.col("_n")).select("p")
