"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, fits_broadcast, own_names

# The rules of the contract; each fits a host with its subdomains and a prefix of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Sites whose pages the default list names, and the languages and page numbers it spans.
LISTED_SITES, LISTED_TOPS, LISTED_LANGS, LISTED_PAGES = ("spam-farm", "cheap-pills"), ("com", "net", "org"), ("de", "en", "es", "fr"), 1000
WORDS, WORD_BITS, ROW_BYTES = 8, 64, 96


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties to the smaller text; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def canonical(url: Column) -> Column:
    """host + path + query without scheme, leading www., default port, fragment, utm_ parameters, index page and final
    slashes; null where a URL has no ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def default_list(spark: SparkSession) -> DataFrame:
    """URLs of the listed sites, made from the ranges above."""
    sites, tops, langs = (F.explode(F.array(*map(F.lit, x))) for x in (LISTED_SITES, LISTED_TOPS, LISTED_LANGS))
    pages = spark.range(LISTED_PAGES).select("id", sites.alias("site")).select("*", tops.alias("top")).select("*", langs.alias("lang"))
    return pages.select(F.concat(F.lit("http://"), "site", F.lit(".example."), "top", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string")).alias("url"))


def _block_and_bits(c: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL by one hash, and one bit in each of its words by slices of another."""
    other = F.xxhash64(F.lit(1), c)  # the literal first: else the second hash would follow from the first
    return F.pmod(F.xxhash64(c), F.lit(blocks)), [F.shiftrightunsigned(other, 6 * i).bitwiseAND(WORD_BITS - 1).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocks of 512 bits (_block, _w0.._w7) of the canonical URLs in column `_name`; unset blocks have no row."""
    block, bits = _block_and_bits(F.col("_name"), blocks)
    marks = listed.select(block.alias("_block"), *[F.call_function("shiftleft", F.lit(1).cast("long"), b).alias(f"b{i}") for i, b in enumerate(bits)])
    return marks.groupBy("_block").agg(*[F.bit_or(f"b{i}").alias(f"_w{i}") for i in range(WORDS)])


@own_names
def filter_urls(pages: DataFrame, url: str, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bits_per_url: int = 16) -> DataFrame:
    """Adds host, path, rule, verdict, listed and bloom_hit to pages.

    The longest fitting rule decides. Other pages are blocked if their canonical URL is among those of `listed`
    (column url): the Bloom filter lets through every listed URL and few others, and only these go on to the exact
    hash join. Null URLs and such without :// have empty host and path, fit no rule and are allowed. Repeated pages
    are judged alike, nulls in `listed` are passed over, an empty list blocks nothing, an empty table gives an empty
    one; columns of pages with one of the added names are replaced, all others are carried along, whatever their names.

    Filter and list are broadcast where their sizes, which follow from the list's count, are within the limit; pages are
    then read once and not shuffled. Beyond it only pages with something to look up are shuffled."""
    added = ["host", "path", "rule", "verdict", "listed", "bloom_hit"]
    names = durable(listed.select(canonical(F.col("url")).alias("_name")).where("_name is not null").distinct())
    n, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_name") + 64), F.lit(0))).first()
    blocks = max(1, -(-n * bits_per_url // (WORDS * WORD_BITS)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    df = pages.drop(*[c for c in added if c != url])
    df = df.withColumns({"_canonical": canonical(F.col(url)), "_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    df = df.drop(*added).withColumnsRenamed({"_host": "host", "_path": "path"}).withColumns({"rule": rule, "_said": verdict})
    block, bits = _block_and_bits(F.col("_canonical"), blocks)
    asked = df.withColumns({"_block": F.when(F.col("rule").isNull() & F.col("_canonical").isNotNull(), block), **{f"_b{i}": b for i, b in enumerate(bits)}})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.expr(f"shiftrightunsigned(_w{i}, _b{i}) & 1") == 1)
    table = bloom_blocks(names, blocks)
    names = names.withColumn("listed", F.lit(True))

    def tested(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(table, "_block", "left").withColumn("bloom_hit", F.coalesce(hit, F.lit(False)))

    if fits_broadcast(blocks, ROW_BYTES) and fits_broadcast(size, 1):
        told = tested(asked, F.broadcast(table))
        out = told.join(F.broadcast(names), F.when(F.col("bloom_hit"), F.col("_canonical")) == F.col("_name"), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        told = tested(asked.where("_block is not null"), F.broadcast(table) if fits_broadcast(blocks, ROW_BYTES) else table)
        idle = asked.where("_block is null").withColumns({"bloom_hit": F.lit(False), "listed": F.lit(False)})
        missed = told.where(~F.col("bloom_hit")).withColumn("listed", F.lit(False))
        found = told.where("bloom_hit").join(names, F.col("_canonical") == F.col("_name"), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
        out = idle.unionByName(missed, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    out = out.withColumn("verdict", F.coalesce("_said", F.when(F.col("listed"), "block").otherwise("allow")))
    kept = [c for c in pages.columns if c not in added]
    return out.select(*kept, *added)
