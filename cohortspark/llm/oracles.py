"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .sharding import MULTIPLIER, WORD
from .urls import LISTED_LANGS, LISTED_PAGES, LISTED_SITES, LISTED_TOPS, RULES

SHARDS = 24
CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1]))"""
OP1 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
jumps(doc_id, b, j, k) AS (
  SELECT DISTINCT doc_id, -1::BIGINT, 0::BIGINT, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + {WORD} ELSE coalesce(doc_id, 0)::HUGEINT END FROM documents
  UNION ALL
  SELECT doc_id, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((((k::HUGEINT * {MULTIPLIER}) + 1) % {WORD}) >> 33) + 1)::DOUBLE))::BIGINT, ((k * {MULTIPLIER}) + 1) % {WORD}
  FROM jumps WHERE j <= {SHARDS}),
placed AS (SELECT doc_id, max(b) FILTER (b < {SHARDS}) AS shard, max(b) AS grown_shard FROM jumps GROUP BY doc_id),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor({CRC}, 4294967295) AS text_crc32 FROM documents, crc)
SELECT d.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size), d.doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM docs d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
"""


def _rule(value: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = []
    for rule in ordered:
        site, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[value]}'")
    return "CASE " + " ".join(cases) + " END"


def _values(items: tuple[str, ...], name: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(x) for x in items)}]) AS {name})"


OP4 = rf"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
canon AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS kept,
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') AS stem
  FROM parts),
named AS (SELECT *, stem || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM canon),
listed AS (
  SELECT site || '.example.' || top || '/' || lang || '/' || n AS canonical
  FROM {_values(LISTED_SITES, 'site')}, {_values(LISTED_TOPS, 'top')}, {_values(LISTED_LANGS, 'lang')}, (SELECT unnest(range({LISTED_PAGES})) AS n))
SELECT page_id, host, path, {_rule(1)} AS rule,
  coalesce({_rule(0)}, CASE WHEN contains(url, '://') AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named
"""
OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT uid, i, words[i:i+4] AS g FROM w, unnest(range(1, greatest(len(words) - 3, 1))) AS t(i)),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM rep, unnest(range(5)) AS t(k) GROUP BY uid),
m AS (
  SELECT w.uid, doc_id, text, words, lines, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter, length(text) - length(replace(text, '!', '')) AS n_marks
  FROM w LEFT JOIN cov ON w.uid = cov.uid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 30 * n_words
    OR 100 * n_dup_lines > 50 * len(lines) OR 100 * n_marks > 50 * n_words OR 100 * n_stutter > 30 * n_words) AS kept
FROM m
"""
OP9 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, conv_id::VARCHAR AS name, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS t
  FROM turns GROUP BY conv_id),
heads AS (SELECT own.*, (xor({CRC.replace("coalesce(text, '')", "name")}, 4294967295) % 9)::BIGINT AS h FROM own, crc),
whole AS (
  SELECT o.conv_id, list_concat(CASE WHEN o.h = 0 THEN [] ELSE coalesce(b.t[1:o.h], []) END, o.t[o.h + 1:]) AS t FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
spots AS (SELECT conv_id, t, len(t) AS n, d, t[1:d] AS head, CASE WHEN d > 0 THEN octet_length(encode(t[d].text)) ELSE 0 END AS size FROM whole, unnest(range(len(t) + 1)) AS x(d)),
node AS (
  SELECT head, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM spots GROUP BY head, d),
kids AS (SELECT head[1:d - 1] AS head, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (head, d)),
below AS (
  SELECT head[1:e] AS head, e AS d, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM full_node, unnest(range(d + 1)) AS x(e) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b ON f.head = b.head AND f.d = b.d LEFT JOIN full_node p ON f.d > 0 AND p.d = f.d - 1 AND p.head = f.head[1:f.d - 1]
"""
ORACLES = {"op1_sharding": OP1, "op4_urls": OP4, "op8_quality": OP8, "op9_topk": OP9, "op13_prefix_trie": OP13}
