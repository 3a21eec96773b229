"""DuckDB SQL that the native queries are compared with."""

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM sources WINDOW b AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(total - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE) AS lam
  FROM ranked
  WHERE w * (CAST(total - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE)) <= 3 * source_size
  ORDER BY w_before LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN w * lam > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE w * lam END AS target
  FROM sources, level
), budgets AS (
  SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS budget FROM targets
), run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), '-')), s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(budget - whole * source_size - before, size)) AS BIGINT) AS taken
FROM run
"""

BM25 = r"""
WITH words AS (
  SELECT doc_id, trim(w, '.,;:!?"''()[]') AS t FROM (
    SELECT doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) AS w FROM documents)
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM words WHERE t <> '' GROUP BY doc_id, t
), len AS (
  SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id
), total AS (
  SELECT count(*) AS n, sum(dl) / count(*) AS average FROM len
), idf AS (
  SELECT t, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, total GROUP BY t, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))), 6) AS score
  FROM (SELECT doc_id, t FROM tf WHERE doc_id % 20 = 0) q JOIN tf d USING (t) JOIN idf USING (t) JOIN len ON len.doc_id = d.doc_id, total
  GROUP BY q.doc_id, d.doc_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""

MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM documents d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUBSTRINGS = r"""
WITH hx AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), grams AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p - 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM hx)
), firsts AS (
  SELECT g, min(doc_id) AS d0 FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM grams JOIN firsts USING (g) WHERE d0 < doc_id
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hits
), spans AS (
  SELECT doc_id, min(p) - 1 AS a, max(p) + 49 AS b FROM runs GROUP BY doc_id, r
), lists AS (
  SELECT doc_id, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e, sum(b - a) AS n_removed FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(len(s), 0) AS n_spans,
         CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda i:
           substr(h, CAST(2 * CASE WHEN i = 0 THEN 0 ELSE e[i] END + 1 AS BIGINT), CAST(2 * (CASE WHEN i = len(s) THEN length(h) // 2 ELSE s[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE e[i] END) AS BIGINT))), '') END AS k
  FROM hx LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM kept
"""

FILTER_AUDIT = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), judged AS (
  SELECT doc_id, part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM worded
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5
), steps AS (
  SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS prior
  FROM orders, range(1, 6) r(i)
), shares AS (
  SELECT part, b, sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & b <> 0) AS shapley FROM cells, f GROUP BY part, b
)
SELECT c.part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(sum(n) FILTER (mask & (own | prior) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(any_value(shapley), 0) AS BIGINT) AS shapley
FROM cells c, steps JOIN shares s ON s.part = c.part AND s.b = own
GROUP BY c.part, filter_order, step
"""
