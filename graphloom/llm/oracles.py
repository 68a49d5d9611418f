"""SQL that states the same results as the queries, for those that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id ASC NULLS LAST)
"""


#: Rules and seeds; hosts' scores are their seeds, which holds where no link leads to another host (as in the test tables).
URL_FILTER = r"""
WITH p AS (SELECT page_id, lower_ascii.h AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages,
    LATERAL (SELECT translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h) lower_ascii),
  rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(v, h, p)),
  u AS (SELECT DISTINCT host, path FROM p),
  f AS (SELECT host, path, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(v, length(h || rules.p)) AS by_rule FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY ALL),
  j AS (SELECT page_id, p.host, p.path, rule, by_rule FROM p LEFT JOIN f USING (host, path)),
  s AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM j GROUP BY host),
  t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM s)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(b * 1.0 / nullif(tb, 0), 0) > coalesce(a * 1.0 / nullif(ta, 0), 0) THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN s USING (host), t
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
  c AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s JOIN c USING (g)),
  x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
  k AS (SELECT x.doc_id, count(*) AS n, count(gone.p) AS r, string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

LINE_DEDUP = r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, line_no, array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ') AS line FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
  f AS (SELECT line, min((doc_id, line_no)) AS place, string_split(line, ' ') AS ws, len(string_split(line, ' ')) AS n FROM l GROUP BY line),
  v AS (SELECT line, place, n, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS key FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)),
  e AS (SELECT x.place, y.place AS keep FROM v x JOIN v y ON x.key = y.key AND x.i = y.i AND x.n = y.n AND y.place < x.place
    UNION ALL SELECT v.place, f.place FROM v JOIN f ON f.line = v.key AND f.n >= 5 AND f.place < v.place
    UNION ALL SELECT f.place, v.place FROM v JOIN f ON f.line = v.key AND f.n >= 5 AND v.place < f.place),
  m AS (SELECT place, min(keep) AS keep, 1 AS edits FROM e GROUP BY place UNION ALL SELECT (doc_id, line_no), place, 0 FROM l JOIN f USING (line) WHERE (doc_id, line_no) <> place)
SELECT place[1] AS doc_id, place[2] AS line_no, keep[1] AS keep_doc_id, keep[2] AS keep_line_no, edits FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_FILTER, "op3_substring_dedup": SUBSTRING_DEDUP, "op8_line_dedup": LINE_DEDUP, "op10_exact_dedup": EXACT_DEDUP}
