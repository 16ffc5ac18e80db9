"""DuckDB SQL for the numbered queries that SQL can express."""

OP1 = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT doc_id, n_bytes, depth, (h >> (60 - depth)) AS prefix FROM d, (SELECT unnest(range(0, 61))::INT AS depth)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
c AS (SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, s.shard_bytes, s.shard_docs,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
      WHERE s.shard_bytes <= {1 << 20} OR p.depth = 60)
SELECT doc_id, n_bytes, depth,
       CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
       shard_bytes, shard_docs, shard_bytes > {1 << 20} AS oversized
FROM c WHERE k = 1
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents),
g AS (
  SELECT doc_id, normal, count(*) OVER (PARTITION BY normal) AS group_size,
         first_value(doc_id) OVER (PARTITION BY normal ORDER BY n_points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""

_FORMS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
    ("opaque", r"[A-Za-z0-9+/_-]{32,}", 32),
]


def _spans(rank: int, kind: str, pattern: str, least: int) -> str:
    value = r"""regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)""" if kind == "assign" else "m"
    mixed = "AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')" if kind == "opaque" else ""
    return f"""
SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, start_at, start_at + length(m) AS end_at, value FROM (
  SELECT doc_id, owner, m, {value} AS value,
         sum(length(gap) + coalesce(length(prior), 0)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS start_at
  FROM (
    SELECT doc_id, owner, i, whole[i] AS m, gaps[i] AS gap, CASE WHEN i > 1 THEN whole[i - 1] END AS prior FROM (
      SELECT doc_id, source AS owner, regexp_extract_all(text, '{pattern}') AS whole,
             regexp_split_to_array(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL
    ), LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS i)))
WHERE length(value) >= {least} {mixed}"""


OP8 = f"""
WITH found AS ({" UNION ALL ".join(_spans(i, *x) for i, x in enumerate(_FORMS))}),
stats AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS n_owners, count(DISTINCT coalesce(doc_id::VARCHAR, chr(0))) AS n_repos FROM found GROUP BY value),
judged AS (
  SELECT f.*, CASE WHEN n_owners > 2 OR n_repos > 20 THEN 'copied'
                   WHEN len(list_distinct(string_split(value, ''))) < 8 THEN 'placeholder' ELSE 'live' END AS verdict
  FROM found f JOIN stats USING (value)),
kept AS (SELECT *, kind || ':' || start_at || ':' || end_at AS span FROM judged WHERE kind != 'opaque' OR verdict = 'live'),
one AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY start_at, rank) FILTER (WHERE kind != 'opaque'), '') AS base,
         string_agg(span, ',' ORDER BY start_at, rank) AS spans,
         count(*) FILTER (WHERE verdict = 'copied') AS n_copied, count(*) FILTER (WHERE verdict = 'live') AS n_live
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN one USING (doc_id)
"""

OP2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body
  FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id != keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id != keeper THEN keeper END AS refers_to,
       CASE WHEN payload_bytes >= 1000 AND page_id != keeper THEN NULL ELSE true END AS verified
FROM k
"""

#: One row, crcs: what a zero byte makes of each low byte of a CRC-32.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, beside crc_table."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


_LOWER_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP12 = f"""
WITH words AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row_no, {_LOWER_WORDS} AS w FROM documents
  UNION ALL
  SELECT 't', NULL, row_number() OVER (), {_LOWER_WORDS} FROM benchmark),
grams AS (
  SELECT side, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words),
features AS (SELECT side, row_no, g, count(*) AS n FROM grams GROUP BY ALL),
{_CRC_TABLE},
strings AS (SELECT DISTINCT g FROM features),
hashed AS (SELECT g, {_crc32("g")} % 10000 AS bucket FROM strings, crc_table),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM features JOIN hashed USING (g) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets, totals),
sums AS (SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_no),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN sums USING (row_no) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""

OP13 = rf"""
WITH {_CRC_TABLE},
split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("doc_id::VARCHAR")} AS h
  FROM documents, crc_table),
tails AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM split),
texts AS (
  SELECT doc_id, r, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM tails),
places AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs)
  GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
stays AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN stays USING (r)
"""

ORACLE_SQL = {"op2_warc_normaliser": OP2, "op1_sharding": OP1, "op8_secret_scan": OP8, "op10_exact_dedup": OP10, "op12_importance": OP12, "op13_periodic_runs": OP13}
