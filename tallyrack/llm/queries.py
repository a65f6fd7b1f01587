"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module; the function has the query's name.
QUERIES = {
    "op1_langid": "langid",
    "op2_mixture": "mixture",
    "op3_tokencount": "tokencount",
    "op4_media": "media",
    "op5_packing": "packing",
    "op6_secrets": "secrets",
    "op7_covertree": "covertree",
    "op8_lmscore": "lmscore",
    "op9_simhash": "simhash",
    "op10_quality": "quality",
    "op11_alignment": "alignment",
    "op12_prefixtrie": "prefixtrie",
    "op13_repeats": "repeats",
}


#: What SQL can say of operators that it can't express as a whole: the query's own result, these columns of it.
PARTS = {
    "mixture_targets": ("op2_mixture", ["doc_id", "size", "source_size", "round(target, 3) AS target", "taken % greatest(size, 1) = 0 AND taken <= 3 * size AS whole"]),
    "media_payloads": ("op4_media", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256"]),
    "secrets_base": ("op6_secrets", ["doc_id", "n_assign", "n_access", "n_hex"]),
    "lmscore_base": ("op8_lmscore", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) AS base_score"]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    found = {name: of(name, module) for name, module in QUERIES.items()}
    found["media_formats"] = of("media_formats", "media")
    part = lambda whole, columns: lambda spark, sf_dir: found[whole](spark, sf_dir).selectExpr(*columns)
    return found | {name: part(whole, columns) for name, (whole, columns) in PARTS.items()}


#: Links by all pairs of a label, components by reachability: for small tables.
LINKED_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Targets stop at three times their source's size; the level at which the rest meets is found over the sorted sources.
TARGETS_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size FROM documents),
t AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM t),
k AS (SELECT *, (SELECT sum(source_size) FROM w) AS total, 3.0 * source_size / weight AS brim FROM w),
l AS (SELECT a.source, (any_value(a.total) - coalesce(sum(3.0 * b.source_size) FILTER (b.brim < a.brim), 0)) / sum(b.weight) FILTER (b.brim >= a.brim) AS level, any_value(a.brim) AS brim FROM k a CROSS JOIN k b GROUP BY a.source),
v AS (SELECT max(level) FILTER (level < brim) AS level FROM l)
SELECT d.doc_id, d.size, CAST(k.source_size AS BIGINT) AS source_size, round(CASE WHEN v.level IS NULL THEN 3.0 * k.source_size ELSE least(3.0 * k.source_size, v.level * k.weight) END, 3) AS target, true AS whole
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source CROSS JOIN v
"""
PAYLOADS_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS size, raw FROM b),
m AS (SELECT *, raw || repeat('\x00'::BLOB, size - n) AS payload, encode('P5' || chr(10) || '64 ' || (size // 64) || chr(10) || '255' || chr(10)) AS head FROM p)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(head) + size AS media_bytes, sha256(head || payload) AS media_sha256 FROM m
"""
FORMATS_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
f AS (SELECT *, octet_length(raw) AS n, CASE octet_length(raw) % 3 WHEN 0 THEN 64 ELSE 192 END AS unit FROM b),
p AS (SELECT *, greatest(unit, (n + unit - 1) // unit * unit) AS size FROM f)
SELECT doc_id, CASE n % 3 WHEN 0 THEN 'pgm' WHEN 1 THEN 'ppm' ELSE 'bmp' END AS format, CAST(size // unit AS INTEGER) AS height, true AS dhash_there, size AS payload_bytes, sha256(raw || repeat('\x00'::BLOB, size - n)) AS payload_sha256 FROM p
"""
SECRETS_SQL = r"""
SELECT doc_id,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2), lambda v: len(v) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: len(v) >= 20)) AS n_access,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: len(v) >= 24)) AS n_hex
FROM documents
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {byte}))"


LMSCORE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 2, false) AS held_out, list_append({WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS words FROM documents),
t AS (SELECT rid, held_out, unnest(words) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
a AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT t.rid, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (a.n + 1 * (a.v + 1)))) AS base_score FROM t LEFT JOIN c USING (w) CROSS JOIN a GROUP BY t.rid)
SELECT d.doc_id, d.held_out, s.n_tokens, s.n_known, CAST(a.n AS BIGINT) AS train_tokens, round(s.base_score, 4) AS base_score FROM d JOIN s USING (rid) CROSS JOIN a
"""

#: Prefixes as joined digests of their turns; subtrees by comparing all prefixes.
PREFIXES_SQL = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, md5(length(role) || ':' || role || text) AS digest, length(text) AS size, turn FROM o),
r AS (SELECT c, digest, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS i FROM t),
n AS (SELECT c, count(*) AS n FROM r GROUP BY c),
h AS (SELECT a.c, a.c - a.c % 100 AS base, {crc32_sql("CAST(a.c AS VARCHAR)")} % 6 AS h, coalesce(b.n, 0) AS base_n FROM n a LEFT JOIN n b ON b.c = a.c - a.c % 100),
p AS (SELECT h.c, i + 1 AS d, digest, size FROM h JOIN r ON r.c = h.base AND i < h UNION ALL SELECT c, least(h, base_n) + i - h + 1, digest, size FROM h JOIN r USING (c) WHERE i >= h),
k AS (SELECT c, d, size, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM p UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT key, sha256(string_agg(c, ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(key, d) AS key FROM k GROUP BY c) GROUP BY key),
v AS (SELECT key, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM k GROUP BY key),
u AS (SELECT key[: 32 * (d - 1)] AS up, count(*) AS n FROM v WHERE d > 0 GROUP BY up),
x AS (SELECT a.key, count(*) FILTER (u.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved FROM v a JOIN v b ON starts_with(b.key, a.key) LEFT JOIN u ON u.up = b.key GROUP BY a.key)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, w.conv_id AS parent_conv_id, v.n_convs, coalesce(u.n, 0) AS n_children, x.n_leaves, CAST(x.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM v JOIN x USING (key) LEFT JOIN e USING (key) LEFT JOIN u ON u.up = v.key LEFT JOIN v w ON v.d > 0 AND w.key = v.key[: 32 * (v.d - 1)]
"""


#: Every string of fifty bytes (a hundred hexadecimal digits) beside the least document that has it; runs by their gaps.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d),
k AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM w),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
r AS (SELECT k.rid, k.i, lag(k.i) OVER (PARTITION BY k.rid ORDER BY k.i) AS p FROM k JOIN m USING (g) WHERE m.least < k.doc_id),
t AS (SELECT rid, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS n FROM r),
u AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM t GROUP BY rid, n),
v AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM u GROUP BY rid),
p AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS lo, a AS hi FROM u UNION ALL SELECT rid, last, NULL FROM v),
q AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' ORDER BY lo, hi) AS kept FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN v USING (rid) LEFT JOIN q USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_prefixtrie": PREFIXES_SQL, "op13_repeats": REPEATS_SQL, "op7_covertree": LINKED_SQL, "mixture_targets": TARGETS_SQL, "media_payloads": PAYLOADS_SQL, "media_formats": FORMATS_SQL, "secrets_base": SECRETS_SQL, "lmscore_base": LMSCORE_SQL}
