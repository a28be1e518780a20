"""DuckDB SQL of the training-data queries that SQL can express.

Fixed values in the SQL (word rules, windows, thresholds, URL rules) are those of the query contracts.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LETTER = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, {_WORD}) END AS ws FROM documents),
w AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h),
gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 50))))) AS cutpos
  FROM w JOIN f USING (h) WHERE w.doc_id > f.first_doc GROUP BY doc_id),
marked AS (
  SELECT doc_id, p, ws[p] AS word, len(ws) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
cut AS (SELECT doc_id, unnest(cutpos) AS p FROM gone),
kept AS (
  SELECT m.doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n_kept
  FROM marked m ANTI JOIN cut c ON m.doc_id = c.doc_id AND m.p = c.p GROUP BY m.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
fit AS (
  SELECT p.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  GROUP BY p.r)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (r)
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format('text')}, {_LETTER}) END AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format('text')}, {_LETTER}) AS ws FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM items),
w AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN lens ON len(ws) >= n)),
m AS (SELECT doc_id, item_id, i, w.n FROM w JOIN items ON w.win = items.win AND w.n = items.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format('text')}, {_WORD}) END AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hashed AS (SELECT doc_id, g, hash(g) AS h, n FROM s JOIN n USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, h, g) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM hashed)),
pre AS (SELECT doc_id, g, n FROM ranked WHERE k <= n - (9 * n + 9) // 10 + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
  FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
links AS (
  SELECT x, y FROM cand JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y AND sx.g = sy.g
  GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 90 * (nx + ny - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON r.c = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

OP7 = r"""
WITH p AS (SELECT page_id AS i, url, md5(coalesce(html, '')) AS dig, strlen(coalesce(html, '')) AS len FROM pages),
t AS (SELECT *, CASE WHEN i % 5 <> 0 THEN '"' || substr(dig, 1, 12) || '"' END AS tag, CASE WHEN i % 7 <> 0 THEN 'day ' || (i % 28) END AS day,
        CASE WHEN i % 13 = 0 THEN i * 10 - 5 ELSE i * 10 + 1000000 END AS later,
        regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
          lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))), '&') AS query FROM t),
k AS (SELECT *, CASE WHEN contains(url, '://') AND host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key FROM u),
v AS (SELECT i * 4 + 1 AS record_id, url_key, later AS ts, CASE WHEN i % 11 = 0 THEN '"changed"' WHEN i % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag, day FROM k),
r AS (SELECT i * 4 AS record_id, url_key, i * 10 AS ts, tag AS etag, day, dig, len FROM k),
j AS (SELECT v.record_id, v.url_key, v.ts, v.etag, v.day, r.record_id AS response_id, r.etag AS r_etag, r.day AS r_day, r.ts AS r_ts, r.dig, r.len
      FROM v LEFT JOIN r ON v.url_key = r.url_key AND r.ts < v.ts
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
        WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
        WHEN day IS NOT NULL AND r_day IS NOT NULL THEN CASE WHEN day = r_day THEN 'resolved' ELSE 'changed' END
        ELSE 'no_validator' END AS status FROM j)
SELECT record_id, url_key, ts, response_id, status, CASE WHEN status = 'resolved' THEN dig END AS payload_digest,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || len || chr(10) || 'content-type: text/html'
         || chr(10) || 'date: ' || ts || chr(10) || 'expires: ' || (ts + 600) END AS headers
FROM s
"""

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, {_TERM}) AS ws
  FROM documents WHERE regexp_matches(text, {_TERM})),
size AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS l FROM d),
q AS (
  SELECT item_id, t, count(*) AS k FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_TERM})) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))
  GROUP BY item_id, t),
p AS (
  SELECT r, doc_id, t, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
  FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) SEMI JOIN q USING (t) GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, size GROUP BY t),
s AS (
  SELECT item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM p JOIN w USING (t) JOIN q USING (t), size GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, {_WORD}) END AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM d LEFT JOIN rep USING (r)),
v AS (
  SELECT *, 1000 * n_symbols // n_words AS symbols, 1000 * n_dup_lines // n_lines AS dup_lines,
         1000 * n_repeat_words // n_words AS repeats, 1000 * word_chars // n_words AS word_len FROM m WHERE n_words > 0),
long AS (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_len FROM v) ON symbols, dup_lines, repeats, word_len INTO NAME measure VALUE x),
sk AS (
  SELECT lang, source, measure, (x >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(x::BIGINT)) - 6, 0)::BIGINT AS s FROM (SELECT * REPLACE (x::BIGINT AS x) FROM long)) GROUP BY ALL),
lv AS (
  SELECT 1 AS level, lang, source, measure, bucket, n FROM sk
  UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM sk GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM sk GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM lv),
q AS (
  SELECT level, lang, source, measure, total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
  FROM cum GROUP BY ALL),
pick AS (
  SELECT o.lang, o.source, o.measure,
         CASE WHEN o.total >= 200 THEN o.q1 WHEN l.total >= 200 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.total >= 200 THEN o.q3 WHEN l.total >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM q o JOIN q l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
  JOIN q a ON a.level = 3 AND a.measure = o.measure WHERE o.level = 1),
each AS (UNPIVOT (SELECT r, lang, source, n_words, symbols, dup_lines, repeats, word_len FROM v) ON symbols, dup_lines, repeats, word_len INTO NAME measure VALUE x),
bad AS (
  SELECT r, bool_or(CASE each.measure
      WHEN 'symbols' THEN x > q3 + 3 * (q3 - q1) + 100
      WHEN 'dup_lines' THEN x > q3 + 3 * (q3 - q1) + 400
      WHEN 'repeats' THEN x > q3 + 3 * (q3 - q1) + 150
      ELSE x > q3 + (3 * (q3 - q1) + 500 + 10000e0 / sqrt(n_words::DOUBLE)) OR x < q1 - (3 * (q3 - q1) + 500 + 10000e0 / sqrt(n_words::DOUBLE)) END) AS out
  FROM each JOIN pick ON each.measure = pick.measure AND each.lang IS NOT DISTINCT FROM pick.lang AND each.source IS NOT DISTINCT FROM pick.source
  GROUP BY r)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words,
       (m.n_words < 10 OR 100 * m.n_repeat_words > 20 * m.n_words) AS base_failed,
       NOT (m.n_words < 10 OR 100 * m.n_repeat_words > 20 * m.n_words) AND NOT coalesce(bad.out, false) AS kept
FROM m LEFT JOIN bad USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_remove_repeats": OP1,
    "op6_judge_urls": OP6,
    "op7_resolve_revisits": OP7,
    "op9_decontaminate": OP9,
    "op10_jaccard_join": OP10,
    "op11_ranked_search": OP11,
    "op12_quality_rules": OP12,
}
