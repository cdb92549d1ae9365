"""Language-model scores: a log-bilinear model over word classes, trained by noise-contrastive estimation in numpy.

P(word | context) = P(class | classes of the two words before) * P(word | class). The number of classes grows with the
square root of the vocabulary. Frequent words have a class of their own; every other word, however rare or unknown, has
one by its last three bytes, so it is modelled by its ending as target and as context, and it shares its class's
probability with the others by smoothed counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

END = 0  # class of a text's end; 1 to S are classes of endings, words follow. Before a text's first word stands class K.
SMOOTH = 0.1
FLUSH = 200_000
TAIL = 3  # bytes of a word's ending
STEP_TOKENS = 1 << 16
# Classes: isqrt of the vocabulary within these; 2,048 keep the table of normalisers at 16 MB.
FEWEST, MOST = 64, 2048
# Tokens that one worker learns from, the most workers whose models are averaged, and the steps a worker takes, within
# these sizes of a step.
WORKER_TOKENS, MOST_WORKERS, STEPS, SMALLEST, LARGEST = 1_000_000, 4096, 256, 256, 8192


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token binary, c) over the texts (column text, binary); the end of a text is the empty token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"token": list(seen.keys()), "c": list(seen.values())})

        for b in batches:
            for t in b["text"]:
                seen.update(words_of(t))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInPandas(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Parameters: context vectors r (K + 1 rows), target vectors q, biases b, weights c of the two places before."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def start(share: np.ndarray, dim: int, seed: int) -> Model:
        """Small random vectors and the classes' log shares as biases: at first the model is the unigram model."""
        rng, k = np.random.default_rng(seed), len(share)
        return Model(rng.normal(0, 0.1, (k + 1, dim)).astype("f4"), rng.normal(0, 0.1, (k, dim)).astype("f4"), np.log(share).astype("f4"), np.ones((2, dim), "f4"))

    def rows(self) -> np.ndarray:
        """All parameters as rows of dim + 1 numbers, so that models can be averaged row by row."""
        pad = lambda m, last=0.0: np.concatenate([m, np.broadcast_to(np.reshape(last, (-1, 1)), (len(m), 1))], axis=1)
        return np.concatenate([pad(self.r), pad(self.q, self.b), pad(self.c)])

    @staticmethod
    def of_rows(rows: np.ndarray, k: int) -> Model:
        rows = rows.astype("f4")
        return Model(rows[: k + 1, :-1], rows[k + 1 : 2 * k + 1, :-1], rows[k + 1 : 2 * k + 1, -1], rows[2 * k + 1 :, :-1])

    def log_z_row(self, i: int) -> np.ndarray:
        """log of the normaliser after class i, for each class before that, by one matrix product over all classes."""
        s = (self.r[i] * self.c[0] + self.r * self.c[1]) @ self.q.T + self.b
        top = s.max(1)
        return top + np.log(np.exp(s - top[:, None]).sum(1))


def places(docs: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target, and the classes one and two places before, of every token; docs are classes of texts, END included."""
    target = np.concatenate(docs).astype(np.int64)
    size = np.array([len(d) for d in docs])
    starts = np.cumsum(size) - size
    one, two = np.full(len(target), k), np.full(len(target), k)
    one[1:], two[2:] = target[:-1], target[:-2]
    one[starts] = k
    two[starts] = k
    two[starts[size > 1] + 1] = k
    return target, one, two


class Trainer:
    """Noise-contrastive steps with AdaGrad on whole batches; the noise words of a batch are shared by its tokens."""

    def __init__(self, model: Model, share: np.ndarray, noise: int, rate: float, seed: int) -> None:
        self.m, self.noise, self.rate, self.rng = model, noise, rate, np.random.default_rng(seed)
        self.share, self.seen = share, 0
        self.at = (np.log(noise * share)).astype("f4")
        self.sums = [np.full(p.shape, 1e-2, "f4") for p in (model.r, model.q, model.b, model.c)]

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n, dim = self.m, len(target), self.m.r.shape[1]
        picked = self.rng.choice(len(self.share), self.noise, p=self.share)
        r1, r2 = m.r[one], m.r[two]
        h = r1 * m.c[0] + r2 * m.c[1]
        qt, qn = m.q[target], m.q[picked]
        gt = 1 / (1 + np.exp(np.clip((h * qt).sum(1) + m.b[target] - self.at[target], -30, 30)))
        gn = -1 / (1 + np.exp(-np.clip(h @ qn.T + m.b[picked] - self.at[picked], -30, 30)))
        dh = gt[:, None] * qt + gn @ qn

        def summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            flat = (rows[:, None] * dim + np.arange(dim)).ravel()
            return np.bincount(flat, values.ravel(), size * dim).reshape(size, dim)

        dr = summed(one, dh * m.c[0], len(m.r)) + summed(two, dh * m.c[1], len(m.r))
        dq = summed(target, gt[:, None] * h, len(m.q)) + summed(picked, gn.T @ h, len(m.q))
        db = np.bincount(target, gt, len(m.b)) + np.bincount(picked, gn.sum(0), len(m.b))
        dc = np.stack([(dh * r1).sum(0), (dh * r2).sum(0)])
        for p, g, s in zip((m.r, m.q, m.b, m.c), (dr, dq, db, dc), self.sums, strict=True):
            g = (g / n).astype("f4")
            s += g * g
            p += self.rate * g / np.sqrt(s)
        self.seen += n


@dataclass
class Fitted:
    """What scoring needs: the model, its normalisers, and how words go to classes and counts."""

    model: Model
    log_z: np.ndarray
    words: dict[bytes, int]  # place of a frequent word in the next two
    word_class: np.ndarray
    word_log: np.ndarray  # log10(c + SMOOTH)
    endings: int
    class_log: np.ndarray  # per class of endings, log10 of its smoothed tokens; 0 for all other classes
    end_count: int
    n: int
    v: int


def encoder(f: Fitted):
    """A function of texts: (classes of all tokens, bounds of the texts, base sum, share sum, rest) of each text. Sums are
    over frequent words; rest counts the others, whose counts are joined."""

    def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
        split = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(split))
        get = f.words.get
        at = np.fromiter((get(w, -1) for w in flat), dtype=np.int64, count=len(flat))
        cls, log = f.word_class[at], np.where(at >= 0, f.word_log[at], 0.0)
        for i in np.flatnonzero(at < 0).tolist():
            cls[i] = 1 + zlib.crc32(flat[i][-TAIL:]) % f.endings
        share = np.where((cls > 0) & (cls <= f.endings), log, 0.0) - f.class_log[cls]
        bounds = np.cumsum([0, *map(len, split)])
        per_text = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[bounds])
        rest = [[{"token": w, "tf": c} for w, c in Counter(ws[i] for i in np.flatnonzero(at[a:b] < 0).tolist()).items()] for ws, a, b in zip(split, bounds, bounds[1:], strict=False)]
        return cls, bounds, per_text(log), per_text(share), rest

    return encode


def train(codes: DataFrame, share: np.ndarray, tokens: int, dim: int, noise: int, rate: float, batch: int | None, rounds: int, seed: int, worker_tokens: int = WORKER_TOKENS) -> Model:
    """One model from all texts (columns h, codes). Texts go to workers by h, as many workers as the tokens ask for; each
    takes steps over its texts, in order of h, from the same start, and the models are averaged by tokens seen, row by
    row, on the executors. Neither files nor partitions change which worker learns what, nor in which order. The driver
    gets one model a round, whatever the input."""
    k = len(share)
    workers = int(min(MOST_WORKERS, max(1, -(-tokens // worker_tokens))))
    model = Model.start(share, dim, seed)
    batch = batch or min(LARGEST, max(SMALLEST, tokens // workers // STEPS))
    dealt = codes.select(F.pmod("h", F.lit(workers)).cast("int").alias("w"), "h", "codes").repartition(workers, "w").sortWithinPartitions("w", "h", F.size("codes")).select("w", "codes")
    for number in range(rounds):
        rows = model.rows()

        def fit(batches: Iterator[pd.DataFrame], rows: np.ndarray = rows, number: int = number) -> Iterator[pd.DataFrame]:
            own, at, held, size = None, None, [], 0

            def learn() -> None:
                t, one, two = places(held, k)
                order = own.rng.permutation(len(t))
                for i in range(0, len(t), batch):
                    some = order[i : i + batch]
                    own.step(t[some], one[some], two[some])

            def result() -> pd.DataFrame:
                if held:
                    learn()
                out = own.m.rows()
                return pd.DataFrame({"row": np.arange(len(out)), "seen": float(own.seen), "v": list(out.astype("f8"))})

            for b in batches:
                for w, x in zip(b["w"].tolist(), b["codes"], strict=True):
                    if w != at:
                        if own is not None:
                            yield result()
                        own, at, held, size = Trainer(Model.of_rows(rows.copy(), k), share, noise, rate / (1 + number), seed + 1000 * number + w), w, [], 0
                    held.append(x)
                    size += len(x)
                    if size >= STEP_TOKENS:
                        learn()
                        held, size = [], 0
            if own is not None:
                yield result()

        fitted = dealt.mapInPandas(fit, "row int, seen double, v array<double>")
        sums = [(F.sum(F.col("seen") * F.col("v")[i]) / F.sum("seen")).alias(f"v{i}") for i in range(dim + 1)]
        mean = fitted.groupBy("row").agg(*sums).toPandas().sort_values("row")
        if len(mean):
            model = Model.of_rows(mean[[f"v{i}" for i in range(dim + 1)]].to_numpy(), k)
    return model


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """Model.log_z_row for every class, worked out in tasks; classes squared numbers come back."""
    rows, k = model.rows(), len(model.b)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.of_rows(rows, k)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "z": [m.log_z_row(int(i)) for i in b["id"]]})

    found = spark.range(k + 1).repartition(min(k + 1, 64)).mapInPandas(work, "id long, z array<float>").toPandas().sort_values("id")
    return np.stack(found["z"].to_list()).astype("f4")


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most about `most` tokens with their counts, most frequent first: those above a count found from the counts'
    histogram, and of those that tie at the next count a share by hash."""
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))  # a row per different count
    steps = durable(counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto))
    cut = steps.where(F.col("upto") <= most).agg(F.min("c"), F.max("upto")).first()
    after = steps.where(F.lit(True) if cut[0] is None else F.col("c") < cut[0]).orderBy(F.desc("c")).first()
    wanted = F.col("c") >= F.lit(cut[0]) if cut[0] is not None else F.lit(False)
    if after is not None:
        left = 0.9 * (most - (cut[1] or 0)) / after["n"]
        wanted = wanted | ((F.col("c") == after["c"]) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(left * (1 << 20))))
    top = counts.where(wanted).toPandas().sort_values(["c", "token"], ascending=[False, True])
    return {bytes(t): int(c) for t, c in zip(top["token"], top["c"], strict=True)}


def class_of_ending(token: str, endings: int) -> Column:
    return 1 + F.crc32(F.substring(token, -TAIL, TAIL)) % endings


def prepared(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", text.alias("text"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64(F.lit(11), "doc_id", text).alias("h"))


def vocabulary(counts: DataFrame, n_classes: int | None, hot: int, dim: int, seed: int) -> tuple[Fitted, np.ndarray]:
    """The parts of Fitted that follow from counts, with the model at its start, and each class's share of the tokens."""
    ends = F.sum(F.when(F.octet_length("token") == 0, F.col("c")))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(ends, F.lit(0)).alias("ends")).first()
    n, v = facts["n"], facts["v"]
    k = n_classes or min(MOST, max(FEWEST, isqrt(v)))
    endings = max(1, k // 4)
    known = frequent(counts.where(F.octet_length("token") > 0), hot)
    own = list(known)[: max(0, k - 1 - endings)]
    apart = counts.sparkSession.createDataFrame([(bytearray(w),) for w in own], "token binary")
    other = counts.where(F.octet_length("token") > 0).join(F.broadcast(apart), "token", "left_anti")
    size, kinds = np.zeros(1 + endings + len(own)), np.zeros(1 + endings + len(own))
    for c, total, distinct in other.groupBy(class_of_ending("token", endings)).agg(F.sum("c"), F.count("*")).collect():
        size[c], kinds[c] = total, distinct
    size[0], size[1 + endings :] = facts["ends"], [known[w] for w in own]
    class_log = np.zeros(len(size))
    class_log[1 : 1 + endings] = np.log10(size[1 : 1 + endings] + SMOOTH * (kinds[1 : 1 + endings] + 1))
    place = {w: i for i, w in enumerate(own)}
    word_class = np.array([1 + endings + place[w] if w in place else 1 + zlib.crc32(w[-TAIL:]) % endings for w in known] + [0], dtype=np.int64)
    word_log = np.log10(np.array([*known.values(), 0]) + SMOOTH)
    share = (size + SMOOTH) / (size + SMOOTH).sum()
    start = Model.start(share, dim, seed)
    return Fitted(start, np.zeros((0, 0), "f4"), {w: i for i, w in enumerate(known)}, word_class, word_log, endings, class_log, facts["ends"], n, v), share


def encoded(rows: DataFrame, f: Fitted) -> DataFrame:
    """(doc_id, held_out, h, codes: classes of all tokens, base, share, rest) of each row, written with a number uid."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast(f)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                cls, bounds, base, share, rest = encode(part["text"].tolist())
                codes = [np.append(cls[x:y], END).astype(np.int16) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "h": part["h"].to_numpy(), "codes": codes, "base": base, "share": share, "rest": rest})

    schema = f"doc_id {kind}, held_out boolean, h long, codes array<short>, base double, share double, rest array<struct<token:binary,tf:long>>"
    return durable(rows.select("doc_id", "held_out", "h", "text").mapInPandas(work, schema).withColumn("uid", F.monotonically_increasing_id()))


def judged(codes: DataFrame, counts: DataFrame, f: Fitted) -> DataFrame:
    """The result's columns from encoded rows."""
    k, kind = len(f.model.b), dict(codes.dtypes)["doc_id"]
    shared = codes.sparkSession.sparkContext.broadcast((f.model.rows(), f.log_z))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, log_z = shared.value
        m = Model.of_rows(params, k)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                t, one, two = places(list(part["codes"]), k)
                s = np.empty(len(t))
                for i in range(0, len(t), 65536):
                    a, c, d = t[i : i + 65536], one[i : i + 65536], two[i : i + 65536]
                    s[i : i + 65536] = ((m.r[c] * m.c[0] + m.r[d] * m.c[1]) * m.q[a]).sum(1) + m.b[a] - log_z[c, d]
                firsts = np.cumsum([0, *map(len, part["codes"])])[:-1]
                yield pd.DataFrame({"uid": part["uid"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "n_tokens": part["codes"].map(len).to_numpy(), "base": part["base"].to_numpy(), "model": np.add.reduceat(s, firsts) / np.log(10) + part["share"].to_numpy()})

    scored = codes.select("uid", "doc_id", "held_out", "codes", "base", "share").mapInPandas(work, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, base double, model double")
    other = codes.select("uid", F.explode("rest").alias("r")).select("uid", "r.token", "r.tf").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    log = F.log10(c + F.lit(SMOOTH))
    sums = other.groupBy("uid").agg(F.sum(F.col("tf") * log).alias("s"), F.sum(F.when(c == 0, F.col("tf")).otherwise(0)).alias("unknown"))
    out = scored.join(sums, "uid", "left")
    s, unknown = F.coalesce("s", F.lit(0.0)), F.coalesce("unknown", F.lit(0))
    end = F.lit(float(np.log10(f.end_count + SMOOTH)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - unknown - int(f.end_count == 0)).alias("n_known"),
        F.lit(f.n).cast("long").alias("train_tokens"),
        (F.col("base") + s + end - F.col("n_tokens") * F.lit(float(np.log10(f.n + SMOOTH * (f.v + 1))))).alias("base_score"),
        (F.col("model") + s).alias("score"),
    )


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_classes: int | None = None, hot: int = 200_000, dim: int = 16, noise: int = 24, rate: float = 0.1, batch: int | None = None, rounds: int = 1, seed: int = 7) -> tuple[Fitted, DataFrame]:
    """What was fitted, and the rows of score."""
    rows = prepared(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    counts = durable(token_counts(rows.where(~F.col("held_out"))))
    f, share = vocabulary(counts, n_classes, hot, dim, seed)
    codes = encoded(rows, f)
    f.model = train(codes.where(~F.col("held_out")), share, f.n, dim, noise, rate, batch, rounds, seed)
    f.log_z = normalisers(docs.sparkSession, f.model)
    return f, judged(codes, counts, f)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    base_score is the add-0.1 unigram score. score is the model's log10 probability of the text: that of each token's
    class after the two classes before it, normalised over all classes, and for classes of endings times the word's
    smoothed share in its class (one share is kept for all unknown words). Counts and training take all texts that are
    not held out. Texts are turned into classes once; rounds and scoring read these. The `hot` most frequent tokens (a
    bound on the driver and on what is sent to tasks) are looked up in the tasks; other tokens, which no text or key
    holds many of, are joined to the counts by token. Null texts count as empty and have their end alone; null ids are
    held out; repeated rows are scored alike; with no text to learn from all counts are 0; an empty table gives an
    empty one. Other columns of docs are not read."""
    return fit_and_score(docs, doc_id, text, **how)[1]
