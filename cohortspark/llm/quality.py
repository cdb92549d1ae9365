"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space; bytes.split knows no other."""
    return text.encode("utf-8", "surrogatepass").split()


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACE))


def n_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def n_repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more; the first place counts too."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


class Facts:
    """Counts of one text, each worked out when a rule or the result first asks for it, and once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return word_chars(self.text)

    @cached_property
    def n_symbols(self) -> int:
        return n_symbols(self.text)

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.text.split("\n") if x.strip(SPACE))

    @cached_property
    def n_dup_lines(self) -> int:
        return n_dup_lines(self.text)

    @cached_property
    def n_repeat_words(self) -> int:
        return n_repeat_words(self.words)


@dataclass(frozen=True)
class Rule:
    """Rejects a text; `test` gets its facts."""

    name: str
    test: Callable[[Facts], bool]


def few_words(least: int) -> Rule:
    return Rule("few_words", lambda f: f.n_words < least)


def repeated_windows(percent: int) -> Rule:
    return Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > percent * f.n_words)


def symbol_share(percent: int) -> Rule:
    return Rule("symbol_share", lambda f: 100 * f.n_symbols > percent * f.n_words)


def word_length(low: float, high: float) -> Rule:
    return Rule("word_length", lambda f: not low * f.n_words <= f.word_chars <= high * f.n_words)


def repeated_lines(percent: int) -> Rule:
    return Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > percent * f.n_lines)


def marks(percent: int) -> Rule:
    return Rule("exclamations", lambda f: 100 * f.text.count("!") > percent * f.n_words)


def stutter(percent: int) -> Rule:
    return Rule("stutter", lambda f: 100 * sum(a == b for a, b in zip(f.words, f.words[1:], strict=False)) > percent * f.n_words)


def default_rules() -> list[Rule]:
    """Production thresholds; the first two are the base rules."""
    return [few_words(10), repeated_windows(20), symbol_share(30), word_length(2, 30), repeated_lines(50), marks(50), stutter(30)]


def ordered(docs: DataFrame, text: str, rules: list[Rule], sample_rows: int = 1000, seed: int = 5) -> list[Rule]:
    """The rules by rejections per second, most first, as measured on a seeded sample of about `sample_rows` rows (the
    only use of the sample). The order sets the cost alone: a text is kept if no rule rejects it, in any order.

    Sampled texts are measured where they are read, and only the measures are added up. Each rule is timed on facts of
    its own, as if it came first."""
    n = docs.count()
    seen = docs.select(text).sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=seed)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(rule.test(Facts(t)) for t in b[text])
                yield pd.DataFrame({"rule": [i], "rejected": [rejected], "seconds": [time.perf_counter() - began]})

    found = seen.mapInPandas(measure, "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()
    gain = {r[0]: r[1] / max(r[2], 1e-9) for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


@own_names
def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000, counts: bool = False) -> DataFrame:
    """Adds kept, and rejected_by: the rule of the cascade that rejected the text, null if kept. With `counts` also the
    five METRICS as longs: those that the cascade has worked out are taken over, the others worked out once.

    Null texts count as empty. Repeated rows are judged alike (rejected_by names the first rule in the measured
    order, so a text that fails several may name another in the next run; kept never changes). An empty table gives
    an empty one; columns with the added names are replaced, all others are carried along, whatever their names."""
    cascade = ordered(docs, text, rules or default_rules(), sample_rows)
    added = ["kept", "rejected_by", *(METRICS if counts else ())]

    @F.pandas_udf(", ".join(["rejected_by string", *(f"{m} long" for m in METRICS if counts)]))
    def judged(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple:
            f = Facts(t)
            why = next((r.name for r in cascade if r.test(f)), None)
            return (why, *(getattr(f, m) for m in METRICS)) if counts else (why,)

        out = pd.DataFrame([one(t) for t in texts], columns=["rejected_by", *(METRICS if counts else ())])
        return out.astype({"rejected_by": object, **({m: "int64" for m in METRICS} if counts else {})})

    out = docs.drop(*[c for c in added if c != text]).withColumn("_m", judged(F.col(text)))
    return out.withColumns({"rejected_by": F.col("_m.rejected_by"), "kept": F.col("_m.rejected_by").isNull(), **({m: F.col(f"_m.{m}") for m in METRICS} if counts else {})}).drop("_m")
