"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"

OP1 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(action, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT q.page_id, q.host, q.path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM q LEFT JOIN r ON (q.host = rh OR ends_with(q.host, '.' || rh)) AND starts_with(q.path, rp)
  GROUP BY ALL
)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM q LEFT JOIN m ON q.page_id IS NOT DISTINCT FROM m.page_id AND q.host = m.host AND q.path = m.path
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.keep, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

#: CRC-32 by its table of 256 remainders, byte by byte, over distinct words; then gains, weights and the draw.
OP11 = r"""
WITH crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), source AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS words FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+')) AS word FROM benchmark
), held AS (
  SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM source) x GROUP BY ALL
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM held UNION SELECT word FROM target) w) y, crcs
), s AS (
  SELECT bucket, sum(n)::BIGINT AS s FROM held JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT row, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM held JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM source LEFT JOIN weights USING (row)
), drawn AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS wanted
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM drawn
"""


def _lloyd() -> str:
    """Four rounds of assignments and means, one after the other, then the last assignment."""
    parts = range(4)
    sql = """WITH v0 AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, label, part, v[part * 16 + 1 : part * 16 + 16] AS v FROM v0, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v0 ORDER BY vec_id LIMIT 256))"""
    near = "SELECT vec_id, part, min(d * 256 + entry) AS best FROM (SELECT vec_id, p.part, entry, " + " + ".join(f"(v[{k}] - c[{k}]) * (v[{k}] - c[{k}])" for k in range(1, 17)) + " AS d FROM p JOIN {b} b ON b.part = p.part) x GROUP BY ALL"
    for n in parts:
        sql += f""",
a{n} AS MATERIALIZED ({near.format(b=f"b{n}")}),
m{n} AS (SELECT p.part, best % 256 AS entry, [{", ".join(f"floor(sum(v[{k}])::DOUBLE / count(*)::DOUBLE)::BIGINT" for k in range(1, 17))}] AS c FROM p JOIN a{n} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)"""
    return sql + f""",
a4 AS MATERIALIZED ({near.format(b="b4")}),
coded AS (SELECT vec_id, string_agg(lower(lpad(hex(best % 256), 2, '0')), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM coded JOIN v0 USING (vec_id)
"""


ORACLES: dict[str, str] = {"op1_url_filter": OP1, "op3_exact_dedup": OP3, "op7_line_dedup": OP7, "op11_importance": OP11, "op12_vector_codes": _lloyd()}
