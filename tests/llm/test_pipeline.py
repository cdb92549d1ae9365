"""The pipeline against a plain version of each stage, on a small table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import alike, quality, sentencepiece_codec
from cohortspark.operators import skew

from .test_operators import WORDS, plain_spans


def similar_groups(texts, least=0.8):
    """For each text the first of its group: texts connected by a Jaccard similarity of 5-word shingles, all pairs."""
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(rng.randint(20, 120)), "en", f"src{i % 12}") for i in range(80)]
    rows += [(200, rows[3][1], "en", "src0"), (201, rows[3][1] + " more", "en", "src0"), (202, "### $$$ " * 30, "en", "src1"), (203, "too short", "en", "src1"), (204, None, "en", "src2")]
    rows += [(205, prose(40) + " reach me at jo@example.org or 10.1.2.3 now", "de", "src3"), (205, rows[3][1], None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    rules = quality.default_rules()
    good = lambda t: not any(r.test(quality.Facts(t)) for r in rules)
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in docs.collect() if good(r.text))
    assert kept.columns == docs.columns

    one = corpus_pipeline.near_dedup(spark, kept, sf_dir).cache()
    rows = sorted(kept.collect(), key=lambda r: (r.doc_id, r.text))
    first = {g: min((rows[i].doc_id for i, r in enumerate(similar_groups([r.text for r in rows])) if r == g)) for g in set(similar_groups([r.text for r in rows]))}
    assert sorted(r.doc_id for r in one.collect()) == sorted(first.values())
    assert {r.text for r in one.collect()} <= {r.text for r in rows}

    clean = corpus_pipeline.personal_data(spark, one, sf_dir).cache()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert (r.text == before[r.doc_id]) == (not plain_spans(before[r.doc_id]))
        assert not plain_spans(r.text)

    mixed = corpus_pipeline.mixture(spark, clean, sf_dir).cache()
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(before) and len(ids) > 0.5 * len(before)

    last = corpus_pipeline.tokens(spark, mixed, sf_dir).collect()
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_model(), 1)
    assert {r.doc_id: r.ids for r in last} == {r.doc_id: codec.encode([r.text])[0].tolist() for r in mixed.collect()}


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"] and out.count() > 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_texts_that_share_an_id(spark):
    """Unrelated texts with one id stay, each group keeps one row, and no group loses its only row."""
    rng = random.Random(2)
    prose = [" ".join(f"v{rng.randrange(9999)}" for _ in range(60)) for _ in range(6)]
    given = [(7, prose[0]), (7, prose[1]), (205, prose[2]), (205, prose[3]), (3, prose[3]), (None, prose[4]), (None, prose[4]), (None, prose[5]), (8, prose[5]), (9, None), (10, ""), (9, None)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    want = [(7, prose[0]), (7, prose[1]), (205, prose[2]), (3, prose[3]), (None, prose[4]), (8, prose[5]), (9, None)]
    got = [(r.doc_id, r.text) for r in alike.keep_one(df.selectExpr("doc_id", "text", "1 AS fp", "map('a', 1) AS m")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert alike.keep_one(df.limit(0)).count() == 0


def test_near_dedup_links_copies_from_0_8(spark):
    """Copies with substituted words, 5-word similarities on both sides of 0.8, against all pairs; a chain; equal ids."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts = []
    for base in range(60):
        ws = [word() for _ in range(rng.randint(100, 400))]
        texts.append(ws)
        for _ in range(3):
            copy = list(ws)
            for at in rng.sample(range(len(ws)), max(1, round(len(ws) * rng.choice((0.003, 0.01, 0.018, 0.022, 0.03))))):
                copy[at] = word()
            texts.append(copy)
            if base % 4 == 0:
                ws = copy  # copies of copies: linked through one another only
    texts += [["one", "two"], ["One", "TWO"], ["one", "three"], [], []]
    ids = [1000 - i for i in range(len(texts))]
    ids[7] = ids[100]  # equal ids, different texts: both groups keep a row
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    sims = []
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            sims.append(s)
            if s >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    assert sum(0.8 <= s < 0.95 for s in sims) > 50 and sum(0.6 < s < 0.8 for s in sims) > 20
    want = sorted(min(ids[i] for i in range(len(texts)) if root[i] == r) for r in set(root))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want


def test_large_group_of_copies(spark):
    """300 copies of one text, each changed by itself, most just above or below 0.8 to the text and apart from one another,
    and some copies of those: the same groups as all pairs give, at 0.8 and where hot texts are sent apart."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(50_000)}"
    hub = [word() for _ in range(220)]

    def changed(ws, n):
        ws = list(ws)
        for at in rng.sample(range(len(ws)), n):
            ws[at] = word()
        return ws

    texts = [hub, *(changed(hub, rng.choice((1, 3, 4, 5, 6, 9))) for _ in range(300))]
    texts += [changed(texts[rng.randrange(1, 300)], 2) for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    root = similar_groups(texts)
    assert 20 < len(set(root)) < 250
    before = skew.LEAST_HOT
    skew.LEAST_HOT = 50  # so that the text that others were made from is a hot one here
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        assert sorted(r.doc_id for r in alike.keep_one(df).collect()) == sorted(set(root))
    finally:
        skew.LEAST_HOT = before


def test_parities_never_exclude_a_link(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(1500)]
    texts = []
    for n in (6, 40, 300, 1500):
        for _ in range(12):
            ws = base[:n]
            for at in rng.sample(range(n), max(1, n // rng.choice((20, 60, 200)))):
                ws[at] = f"w{rng.randrange(900)}"
            texts.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "i int, t string")
    got = {r.i: (r.n, r.bits) for r in df.select("i", alike.parities(F.col("t"), 5).alias("s")).select("i", "s.*").collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = alike.shingle_set(a.encode(), 5), alike.shingle_set(b.encode(), 5)
            differ = sum((p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) + (1 << 64)).bit_count() for p, q in zip(got[i][1], got[j][1], strict=True))
            assert got[i][0] == len(x) and differ <= len(x ^ y)


def test_memos_of_a_worker_are_bounded(monkeypatch):
    """Hashes start anew beyond their bound, with the same results, and one codec is held at a time."""
    from cohortspark.llm import alike, sentencepiece_codec

    text = b" ".join(b"w%d" % (i % 70) for i in range(300))
    whole = alike.shingle_hashes(text, 5, alike.Hashes())
    monkeypatch.setattr(alike.Hashes, "MOST", 20, raising=False)
    memo = alike.Hashes()
    assert alike.shingle_hashes(text, 5, memo).tolist() == whole.tolist() and len(memo) <= 20
    assert sentencepiece_codec.codec.cache_parameters()["maxsize"] == 1
