"""Whitening, packing and the prefix trie against exact arithmetic, the tokenizer itself and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import licenses, packing, pii, prefix_trie, queries, whitening

# 11


def exact_moments(vectors):
    """(n, sums, covariance of fractions) of different whole vectors."""
    n, dims = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(dims)]
    about = [[n * v[i] - sums[i] for i in range(dims)] for v in vectors]
    return n, sums, [[Fraction(sum(a[i] * a[j] for a in about), n**3) for j in range(dims)] for i in range(dims)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, _x string, n string")


@pytest.mark.parametrize("scale", [0.02, 1.0, 1e6])
def test_whitening_is_exact(spark, scale):
    rng = np.random.default_rng(int(scale * 100))
    mixed = rng.normal(size=(400, 7)) @ rng.normal(size=(7, 7)) * scale
    rows = [(i, [float(np.float32(c)) for c in v], "kept", "own") for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[3][1], "kept", "own") for i in range(200)]  # a hot vector counts once
    rows += [(1, None, "x", "y"), (2, [1.0, None] * 3 + [1.0], "x", "y"), (3, [float("nan")] + [0.0] * 6, "x", "y"), (4, [float("inf")] + [0.0] * 6, "x", "y"), (5, [], "x", "y"), (6, [1.0, 2.0], "x", "y")]
    found = whitening.whiten(vectors(spark, rows).repartition(70), components=5)
    got = {r.vec_id: r for r in found.collect()}
    assert set(got) == set(range(400)) | set(range(1000, 1200)) and {r["_x"] for r in got.values()} == {"kept"}
    whole = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v, *_ in rows[:600]}
    n, sums, cov = exact_moments(sorted(set(whole.values())))
    assert {r.n for r in got.values()} == {n} and all(int(r.deviation) == sum((n * x - s) ** 2 for x, s in zip(whole[i], sums, strict=True)) for i, r in got.items())
    values, axes = np.linalg.eigh(np.array([[float(x) for x in row] for row in cov]))
    values, axes = values[::-1][:5], axes[:, ::-1][:, :5]
    trace = float(sum(cov[i][i] for i in range(7)))
    ids = sorted(got)
    about = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(whole[i], sums, strict=True)] for i in ids])
    want, white = about @ axes / np.sqrt(values), np.array([got[i].whitened for i in ids])
    signs = np.sign((want * white).sum(0))
    assert np.allclose(white * signs, want, atol=1e-9, rtol=1e-8)
    assert np.allclose(got[0].explained, values / trace, rtol=1e-10) and got[0].identity_error < 1e-9


def test_covariance_is_double_double():
    """Sums of outer products of entries with a common offset of 2^40 agree with fractions to 2^-90 of the largest."""
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (3000, 3)).astype(np.float64) + 2.0**40
    pair = None
    for at in range(0, len(x), whitening.BLOCK):
        own = whitening.outer((x[at : at + whitening.BLOCK], x[at : at + whitening.BLOCK] * 0.0 + 2.0**-30))
        pair = own if pair is None else whitening.added(pair, own)
    exact = [[sum((Fraction(a[i]) + Fraction(1, 2**30)) * (Fraction(a[j]) + Fraction(1, 2**30)) for a in x) for j in range(3)] for i in range(3)]
    for i in range(3):
        for j in range(3):
            assert abs(Fraction(pair[0][i, j]) + Fraction(pair[1][i, j]) - exact[i][j]) < exact[i][j] / 2**75


def test_whitening_edges(spark):
    empty = whitening.whiten(vectors(spark, []))
    assert empty.collect() == [] and {"whitened", "deviation", "explained", "vec_id"} <= set(empty.columns)
    assert whitening.whiten(vectors(spark, [(1, None, "", ""), (2, [], "", "")])).collect() == []
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0], "", "") for i in range(5)])).collect()
    assert len(same) == 5 and all(r.whitened == [] and r.deviation == 0 and r.n == 1 for r in same)
    far = whitening.whiten(vectors(spark, [(1, [3e38, 0.0], "", ""), (2, [-3e38, 1.0], "", ""), (3, [0.0, 5.0], "", "")])).collect()
    held = {1: (1 << 52) + 1_000_000, 2: 1_000_000 - (1 << 52), 3: 1_000_000}
    sums = (sum(held.values()), 3_000_000 + 64 + 320)
    second = {1: 1_000_000, 2: 1_000_064, 3: 1_000_320}
    assert {r.vec_id: int(r.deviation) for r in far} == {k: (3 * held[k] - sums[0]) ** 2 + (3 * second[k] - sums[1]) ** 2 for k in held}


# 12


def test_encoder_equals_tokenizer():
    rng, spec = random.Random(5), packing.default_tokenizer()
    parts = ["a", "B", "Ça", "é", "é", "Σ", "İ", "T̈", "'s", "'", "1", "²", "ß", "<|endoftext|>", "ﬀ", "中文", ".", ",", "...", "\t", "\n", " ", "\x0b", "\xa0", "ͅ", "👩"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", " \n ", "x" * 5000, "Ab. " * 3000, "." * 300]
    own, plain = packing.Encoder(spec, most=500, longest=20), Tokenizer.from_str(spec)
    for at in range(0, len(texts), 100):
        got = own.encode(pa.array(texts[at : at + 100], pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]


def test_bins():
    rng = random.Random(1)
    for most in (1, 2, 5, 1000):
        bins, free, open_ = packing.Bins(50, most), {}, set()
        for _ in range(3000):
            n = rng.randint(1, 50)
            fits = [b for b in open_ if free[b] >= n]
            number, offset = bins.place(n)
            if fits:
                assert number in fits and free[number] == min(free[b] for b in fits)
            else:
                assert number not in free
                if len(open_) == most:  # the fullest has been closed
                    least = min(free[b] for b in open_)
                    gone = [b for b in open_ if free[b] == least and b not in sum(bins.free, [])]
                    open_.discard(gone[0])
                free[number] = 50
            assert offset == 50 - free[number]
            free[number] -= n
            (open_.add if free[number] else open_.discard)(number)
            assert sorted(open_) == sorted(sum(bins.free, [])) and len(open_) <= most and bins.bits == sum(1 << f for f in {free[b] for b in open_})


@pytest.mark.parametrize("per_task", [64, 1 << 16])
def test_packing(spark, per_task):
    rng = random.Random(8)
    texts = [None, "", " \n", "word " * 20000, "Déjà vu, <|endoftext|>!"] + [" ".join(rng.choice(["able", "to", "Xylophone.", "été"]) for _ in range(rng.choice([3, 40, 400, 1500]))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, "s", 7) for i, t in enumerate(texts)] + [(5, texts[5], "s", 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, length int").repartition(5)
    cut = packing.pieces(docs)
    packed = packing.pack(cut, per_task=per_task)
    got = packed.collect()
    tok = Tokenizer.from_str(packing.default_tokenizer())
    want = Counter()
    for d, t, _, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            raw = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[(d, k // 2048, k, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want and got[0]["_row"] == "s"
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    free = []  # best fit by falling length over all pieces
    for n in sorted((r.length for r in got), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        best = min(fits, key=free.__getitem__) if fits else free.append(2048) or len(free) - 1
        free[best] -= n
    assert len(bins) <= len(free) + (0 if per_task > 1000 else 6)
    whole = {r.sequence_id: r.tokens for r in packing.sequences(packed).collect()}
    assert whole == {k: np.frombuffer(b"".join(x[2] for x in sorted(b)), "<u4").tolist() for k, b in bins.items()}
    assert packing.pack(packing.pieces(docs.limit(0))).collect() == []


def test_lengths_that_cannot_be_packed_stay(spark):
    rows = [(1, 0), (2, 2049), (3, None), (4, 2048), (5, 1), (6, -3)]
    got = {r.doc_id: (r.length, r.sequence_id, r.offset) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, length long")).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(rows)
    assert all((v[1] is None) == (v[2] is None) == (k not in (4, 5)) for k, v in got.items()) and got[4][1] != got[5][1]


# 13


def trie(turns):
    """The nodes of conversations given as (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [k[3] for k in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: tuple(own.get(c - c % 5, [])[: heads[c]] + v[heads[c] :]) for c, v in own.items()}
    members = defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].add(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if whole[c] == k).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], ends(k)) for k, m in members.items())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = c % 3 == 0  # a third share their turns
        for t in range(rng.choice([1, 2, 3, 12, 25])):
            rows.append((c, None if rng.random() < 0.03 else t, "u" if hot else rng.choice(["u", "é", None]), "same" if hot else rng.choice(["x", "yé", None, "", "z" * 30])))
    return [r for r in rows if rng.random() > 0.05] + rows[:3] + [(None, 1, "u", "q")]


@pytest.mark.parametrize("seed, n", [(1, 400), (2, 40), (3, 1), (4, 0)])
def test_trie(spark, seed, n):
    rows = conversations(seed, n) if n else []
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(1), "path": F.lit("own"), "_p": F.lit(2)})
        got = prefix_trie.nodes(prefix_trie.rebuilt(df.repartition(5))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == trie(rows)


def test_ranges_agree_wherever_they_are_cut():
    token, size = (lambda x: hashlib.md5(x.encode()).digest()), {x: 3 * i + 1 for i, x in enumerate("abcdef")}
    for seed in range(1500):
        rng = random.Random(seed)
        seqs = {tuple(rng.choice("ab" if rng.random() < 0.7 else "abcdef") for _ in range(rng.choice([0, 1, 2, 3, 5, 8]))) for _ in range(rng.randint(1, 14))}
        path = lambda q: b"".join(map(token, q))
        order, results = sorted(seqs, key=path), []
        for cuts in ([], sorted(rng.sample(range(1, len(order)), min(len(order) - 1, 4)))):
            ranges, done, waits, parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)], set(), [], defaultdict(list)
            for i, own in enumerate(ranges):
                before = prefix_trie.common_turns(path(ranges[i - 1][-1]), path(own[0])) if i else -1
                after = prefix_trie.common_turns(path(own[-1]), path(ranges[i + 1][0])) if i + 1 < len(ranges) else -1
                r = prefix_trie.Range(before, after)
                for q in own:
                    r.add(path(q), [size[x] for x in q], 2, order.index(q) * 7 % 15, "".join(q))
                r.finish()
                for kind, conv, depth, above, *counts, ends, key, parent in r.taken():
                    if kind == prefix_trie.DONE:
                        done.add((conv, depth, above, *counts, ends))
                    elif kind == prefix_trie.WAITS:
                        waits.append((conv, depth, parent, counts, ends))
                    else:
                        parts[key, depth].append((conv, counts, ends, parent))
            least = {key: min(x[0] for x in v) for (key, _), v in parts.items()}
            for (key, depth), v in parts.items():
                done.add((least[key], depth, least.get(v[0][3]), *map(sum, zip(*(x[1] for x in v), strict=True)), max((x[2] for x in v if x[2] is not None), default=None)))
            done |= {(conv, depth, least[parent], *counts, ends) for conv, depth, parent, counts, ends in waits}
            results.append(done)
        assert results[0] == results[1]


def test_query_columns(spark):
    path = "/root/testdata/sf0.001"
    assert queries.op11_whitening(spark, path).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert queries.op12_packing(spark, path).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert queries.op13_prefix_trie(spark, path).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# 3


def test_license_text_with_twenty_thousand_hits(spark):
    """A unit repeated has the unit's detections at every place; a megabyte of hits is scanned in linear time."""
    unit = "released under the mit license, or licensed under the Apache License, Version 2.0 word "
    df = spark.createDataFrame([(1, unit), (2, unit * 10_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).select("doc_id", "n_words", "base", "detections").collect()}
    one, many, width = got[1], got[2], got[1].n_words
    assert len(one.detections) >= 2 and many.n_words == 10_000 * width
    place = lambda d, k: (d.start + k * width, d.end + k * width, d.priority, d.label)
    assert [place(d, 0) for d in many.detections] == [place(d, k) for k in range(10_000) for d in one.detections]
    assert sorted(b.start for b in many.base) == sorted(b.start + k * width for k in range(10_000) for b in one.base)


# 7


def test_reach_of_an_entity(spark):
    """A term that discloses an address is found if it ends before the last of `reach` characters, and else not."""
    rows = [(i, "only@one.example " + "x" * 9 + " Zanzibar " + f"w{i}") for i in range(6)] + [(100 + i, f"other{i}@mail.example and words {i}") for i in range(40)]
    # Two plain texts with the term: enough to keep it from disclosing the kind, few enough not to hide the address.
    rows += [(200 + i, f"plain text {i} of no address" + " Zanzibar" * (i < 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    end = len(" " + "x" * 9 + " Zanzibar")
    for reach, found in ((end + 1, True), (end, False), (pii.REACH, True)):
        got = {r.doc_id: {r.text[s.start : s.end] for s in r.spans if s.kind == "term"} for r in pii.find(df, reach=reach).collect()}
        assert all(("Zanzibar" in got[i]) == found for i in range(6))
