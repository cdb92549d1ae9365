"""Personal data: exact kinds by regex, and terms that disclose them by corpus co-occurrence.

DataFrame expressions only. Sanitisation is information-theoretic (after Sanchez and Batet): a term t discloses an
entity e as far as PMI(t; e) = log p(t, e) / (p(t) p(e)) comes up to IC(e) = -log p(e), probabilities over documents.
Entities are the single addresses and numbers (t, e: both, t within `reach` characters of e), and each kind as a whole
(t, e: a text with both). Terms whose share of IC(e) passes a threshold are generalised or removed in texts that hold e."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from .common import durable, fits_broadcast, let, own_names, running

# The kinds in order, with their patterns. Possessive forms of the contract's patterns, which match the
# same places but keep Java's matcher from recursing; each starts at a run's head or at the end of the last match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
# Cheap signs without which a text holds nothing of the kind.
SIGNS = {"email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]"}
LITERALS = {"email": "@", "phone": "+"}
SPAN = "struct<kind:string,start:int,end:int>"
TERM_CHAR = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Characters to either side of an entity in which its own terms are sought: about a paragraph. What stands farther away is
# rarely about the one address, and is still held against the entity's kind, over whole texts.
REACH = 200


def matches(text: Column, pattern: str | Column, reach: int = REACH) -> Column:
    """array<struct(start, end, found, around)> of all matches, places in code points, end exclusive; around: the text
    up to `reach` characters to either side, cut at the next match, without words that reach the cut."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def before(gap: Column) -> Column:
        return F.when(F.length(gap) > reach, F.regexp_replace(F.right(gap, F.lit(reach)), f"^{TERM_CHAR}+", "")).otherwise(gap)

    def after(gap: Column) -> Column:
        return F.when(F.length(gap) > reach, F.regexp_replace(F.left(gap, F.lit(reach)), f"{TERM_CHAR}+$", "")).otherwise(gap)

    def placed(s: Column) -> Column:
        # A match ends where the gaps and matches up to it end.
        ends = running(F.transform(s["found"], lambda m, i: F.length(m) + F.length(F.get(s["gaps"], i))), lambda a, b: a + b)
        around = lambda i: F.concat(before(F.get(s["gaps"], i)), F.lit(" "), after(F.get(s["gaps"], i + 1)))
        one = lambda m, i, e: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("found"), around(i).alias("around"))
        return let(ends, lambda e: F.transform(s["found"], lambda m, i: one(m, i, e)))

    return let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass Luhn; zeros in front change nothing."""
    total = F.lit(0)
    padded = F.lpad(digits, 20, "0")
    for i in range(20):
        d = F.substring(padded, 20 - i, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def entities(text: Column, reach: int = REACH) -> Column:
    """array<struct(kind, start, end, found, around)> of the base kinds, in the order of KINDS, then by start."""
    kind = "array<struct<kind:string,start:int,end:int,found:string,around:string>>"

    def of(name: str) -> Column:
        found = F.filter(matches(text, PATTERNS[name], reach), lambda m: valid(name, m["found"]))
        spans = F.transform(found, lambda m: F.struct(F.lit(name).alias("kind"), m["start"], m["end"], m["found"], m["around"]))
        seen = (text.contains(LITERALS[name]) if name in LITERALS else text.rlike("[0-9]")) & text.rlike(SIGNS[name])
        return F.when(seen, spans).otherwise(F.array().cast(kind)).cast(kind)

    return F.concat(*map(of, KINDS))


def terms(text: Column) -> Column:
    """Distinct terms of a text: runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(text, TERM_GAP)), lambda t: t != "")


def disclosure(docs: DataFrame, text: str, held: DataFrame, share: float = 0.9, support: int = 5) -> DataFrame:
    """(e, term, strength): terms in `support` rows or more whose PMI with an entity is `share` or more of its IC. e is
    kind:value of an entity that stands in `support` rows or more, or a kind.

    held has each row with entities (_uid, _bare: its text with entities blanked, _found). Counts are over all rows of
    docs and are added up before they are shuffled. Of a term's n rows, n (of / all) ** (1 - share) or more are e's, so
    pairs in fewer rows are left out early. Terms are counted alike at every size."""
    rows = docs.count()
    kinds = held.select("_bare", F.explode(F.array_distinct(F.transform("_found", lambda s: s["kind"]))).alias("e"))
    values = held.select("_uid", F.explode("_found").alias("x")).select("_uid", F.concat_ws(":", "x.kind", "x.found").alias("e"), "x.around")
    of_value = values.groupBy("e").agg(F.count_distinct("_uid").alias("of")).where(F.col("of") >= support)
    of = durable(kinds.groupBy("e").agg(F.count("*").alias("of")).union(of_value).where(F.col("of") < rows))
    by_value = split_join(durable(values.select("_uid", "e", "around")), of.select("e"), "e")
    by_value = by_value.select("_uid", "e", F.explode(terms(F.col("around"))).alias("term")).distinct().groupBy("e", "term").agg(F.count("*").alias("both"))
    by_kind = kinds.select("e", F.explode(terms(F.col("_bare"))).alias("term")).groupBy("e", "term").agg(F.count("*").alias("both"))
    least = F.lit(float(support)) * F.pow(F.col("of") / rows, F.lit(1 - share)) * (1 - 1e-9)
    near = durable(by_kind.union(by_value).join(of, "e").where(F.col("both") >= least))
    n = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    ic = F.log(rows / F.col("of"))
    pmi = F.log(F.col("both") * F.lit(float(rows)) / (F.col("n") * F.col("of")))
    return near.join(n, "term").select("e", "term", (pmi / ic).alias("strength")).where(F.col("strength") >= share)


def replaced(text: Column, edits: Column, many: int = 32) -> Column:
    """text with each edit (start, end, by) made, in their order; a null `by` stands for as many spaces. Of an edit that
    begins inside an earlier one the rest goes, and its `by` is left out. Texts of more than `many` edits are cut from an
    array of their characters: to find a place in a string takes a walk from its beginning."""

    def made(s: Column, cut: Callable[[Column, Column], Column]) -> Column:
        def piece(e: Column, i: Column) -> Column:
            at = F.coalesce(F.get(s["ends"], i - 1), F.lit(0))
            spaces = F.repeat(F.lit(" "), F.greatest(F.lit(0), e["end"] - F.greatest(at, e["start"])))
            by = F.coalesce(F.when(e["start"] >= at, e["by"]).when(e["by"].isNotNull(), F.lit("")), spaces)
            return F.concat(cut(at, F.greatest(F.lit(0), e["start"] - at)), by)

        last = F.coalesce(F.get(s["ends"], F.size(s["ends"]) - 1), F.lit(0))
        return F.concat(F.array_join(F.transform(s["edits"], piece), ""), cut(last, F.greatest(F.lit(0), F.length(text) - last)))

    def long(s: Column) -> Column:
        return let(F.struct(s["edits"].alias("edits"), s["ends"].alias("ends"), F.split(text, "").alias("chars")), lambda x: made(x, lambda at, n: F.array_join(F.slice(x["chars"], at + 1, n), "")))

    def either(s: Column) -> Column:
        return F.when(F.size(s["edits"]) > many, long(s)).otherwise(made(s, lambda at, n: F.substring(text, at + 1, n)))

    return let(F.array_sort(edits), lambda e: let(F.struct(e.alias("edits"), running(F.transform(e, lambda x: x["end"]), F.greatest).alias("ends")), either))


def blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of the spans; all else keeps its place."""
    return replaced(text, F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(None).cast("string").alias("by"))))


@own_names
def find(docs: DataFrame, text: str = "text", share: float = 0.9, support: int = 5, reach: int = REACH) -> DataFrame:
    """Adds base (array of struct kind, start, end) and spans, the same with the disclosing terms (kind "term").

    Terms are sought in texts that hold the entity, or an entity of the kind, that they disclose, outside of entities: those of
    a single entity within `reach` characters of it, up to the next entity of its kind, those of a kind in whole texts.
    Rows with entities are written with a number of their own, by which terms come back to them, so equal texts are
    no hot key; all other rows pass through. Null texts count as empty; repeated rows get the same spans; an empty
    table gives an empty one; columns base and spans of the input are replaced, all others are carried along."""
    kind = f"array<{SPAN}>"
    whole = docs.drop(*[c for c in ("base", "spans") if c != text]).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    whole = whole.withColumn("_found", entities(F.col("_t"), reach))
    held = whole.where("size(_found) > 0").withColumns({"base": F.transform("_found", lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(kind), "_uid": F.monotonically_increasing_id()})
    held = durable(held.withColumn("_bare", blanked(F.col("_t"), F.col("base"))))
    told = durable(disclosure(whole.select("_t"), "_t", held.select("_uid", "_bare", "_found"), share, support))
    told = F.broadcast(told) if fits_broadcast(told.count(), 256) else told
    by_kind = held.select("_uid", F.explode(terms(F.col("_bare"))).alias("term"), F.transform("_found", lambda s: s["kind"]).alias("_kinds")).join(told, "term").where(F.array_contains("_kinds", F.col("e")))
    values = held.select("_uid", F.explode(F.array_distinct(F.transform("_found", lambda s: F.concat_ws(":", s["kind"], s["found"])))).alias("e"))
    by_value = values.join(told, "e")
    hits = by_kind.select("_uid", "term").union(by_value.select("_uid", "term")).groupBy("_uid").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    regex = F.concat(F.lit(f"(?<!{TERM_CHAR})(?:"), F.array_join("_terms", "|"), F.lit(f")(?!{TERM_CHAR})"))
    extra = F.when(F.size("_terms") > 0, F.transform(matches(F.col("_bare"), regex), lambda m: F.struct(F.lit("term").alias("kind"), m["start"], m["end"]))).cast(kind)
    spans = F.concat("base", F.coalesce(extra, F.array().cast(kind)))
    names = [c for c in whole.columns if c not in ("_t", "_found")]
    out = held.join(hits, "_uid", "left").select(*names, "base", spans.alias("spans"))
    none = F.array().cast(kind)
    return whole.where("size(_found) = 0").select(*names, none.alias("base"), none.alias("spans")).unionByName(out)


@own_names
def redact(docs: DataFrame, text: str = "text", **how: float) -> DataFrame:
    """docs with personal data replaced: entities by a tag of their kind, disclosing terms generalised to what they
    look like (number, name) or, in lower case, removed. Texts without spans, null ones too, stay as they are."""
    found = find(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c in ("base", "spans") and c != text}), text, **how)

    def by(s: Column) -> Column:
        word = F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])
        general = F.when(word.rlike("^[0-9]+$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(s["kind"] == "term", general).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    edits = F.transform("spans", lambda s: F.struct(s["start"], s["end"], by(s).alias("by")))
    out = found.withColumn(text, F.when(F.size("spans") > 0, replaced(F.col(text), edits)).otherwise(F.col(text))).drop("base", "spans")
    return out.withColumnsRenamed({f"_{c}": c for c in ("base", "spans")}).select(docs.columns)
