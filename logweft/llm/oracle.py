"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from logweft.llm import quality_rules, source_divergence

_DECONTAMINATE = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM folded, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit h ON f.doc_id = h.doc_id LEFT JOIN named n ON f.doc_id = n.doc_id
"""

_SUBSTRINGS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), recurring AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN recurring USING (h))
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)
"""

_FIXITY = r"""
WITH paged AS (
  SELECT page_id, coalesce(CAST(floor(page_id / 256) AS BIGINT) || '.warc', 'null.warc') AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages
), placed AS (
  SELECT *, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS key,
    CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, payload
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM paged
), replicas AS (
  SELECT 'left' AS side, file, "offset", payload FROM placed
  UNION ALL
  SELECT 'right', file, "offset", CASE key WHEN '00' THEN substr(payload, 1, length(payload) - 1)
    WHEN '01' THEN payload || '#' ELSE payload END
  FROM placed WHERE key <> '02'
), leaves AS (
  SELECT side, file, "offset", CAST(strlen(payload) AS BIGINT) AS length, sha256(payload) AS leaf FROM replicas
), n0 AS (
  SELECT side, file, "offset" // 65536 AS place, sha256(string_agg("offset" || ':' || leaf, ';' ORDER BY "offset")) AS h
  FROM leaves GROUP BY ALL
), n1 AS (
  SELECT side, file, place // 16 AS place, sha256(string_agg(place || ':' || h, ';' ORDER BY place)) AS h
  FROM n0 GROUP BY side, file, place // 16
), n2 AS (
  SELECT side, file, place // 16 AS place, sha256(string_agg(place || ':' || h, ';' ORDER BY place)) AS h
  FROM n1 GROUP BY side, file, place // 16
), n3 AS (
  SELECT side, file, place // 16 AS place, sha256(string_agg(place || ':' || h, ';' ORDER BY place)) AS h
  FROM n2 GROUP BY side, file, place // 16
), n4 AS (
  SELECT side, file, place // 16 AS place, sha256(string_agg(place || ':' || h, ';' ORDER BY place)) AS h
  FROM n3 GROUP BY side, file, place // 16
), roots AS (
  SELECT side, file, sha256(string_agg(place || ':' || h, ';' ORDER BY place)) AS h FROM n4 GROUP BY side, file
), a AS (SELECT * FROM leaves WHERE side = 'left'), b AS (SELECT * FROM leaves WHERE side = 'right')
SELECT file, "offset", coalesce(a.length, 0) AS left_length, a.leaf AS left_leaf, coalesce(b.length, 0) AS right_length, b.leaf AS right_leaf,
  CASE WHEN a.leaf IS NULL THEN 'left' WHEN b.leaf IS NULL THEN 'right' ELSE 'changed' END AS state,
  l.h AS left_root, r.h AS right_root
FROM a FULL JOIN b USING (file, "offset")
LEFT JOIN (SELECT * FROM roots WHERE side = 'left') l USING (file)
LEFT JOIN (SELECT * FROM roots WHERE side = 'right') r USING (file)
WHERE a.leaf IS DISTINCT FROM b.leaf
"""

_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place, md5(coalesce(text, '')) AS digest
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][kind + 1] AS weight, source_size * 2 AS most FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, kind, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels
), started AS (
  SELECT s.*, t.source_size, t.kind, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id NULLS FIRST, s.size, s.digest
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), used AS (
  SELECT *, least(greatest(goal - start, 0), size) AS u0, least(greatest(goal - source_size - start, 0), size) AS u1 FROM started
), demand AS (
  SELECT *, (start + u0 / 2.0::DOUBLE) / goal AS d0, (source_size + start + u1 / 2.0::DOUBLE) / goal AS d1 FROM used
)
SELECT doc_id, size, source_size, target, CAST(u0 + u1 AS BIGINT) AS taken,
  CASE WHEN u0 > 0 THEN round(least(greatest(CASE kind
    WHEN 0 THEN (sqrt(36.0::DOUBLE - 4.0::DOUBLE * (d0 * 5.0::DOUBLE)) - 6.0::DOUBLE) / -2.0::DOUBLE
    WHEN 1 THEN d0
    ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * d0) - 0.5::DOUBLE) END, 0), 1), 9) END AS position,
  CASE WHEN u1 > 0 THEN round(least(greatest(CASE kind
    WHEN 0 THEN (sqrt(36.0::DOUBLE - 4.0::DOUBLE * (d1 * 5.0::DOUBLE)) - 6.0::DOUBLE) / -2.0::DOUBLE
    WHEN 1 THEN d1
    ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * d1) - 0.5::DOUBLE) END, 0), 1), 9) END AS again
FROM demand
"""

ORACLE = {
    "op1_decontaminate": _DECONTAMINATE,
    "op5_substring_dedup": _SUBSTRINGS,
    "op7_fixity": _FIXITY,
    "op10_mixing": _MIXING,
    "op11_quality_rules": quality_rules.sql(),
    "op13_source_divergence": source_divergence.SQL,
}
