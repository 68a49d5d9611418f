"""SQL that states the results of the registered queries."""

DOCS = r"""
m AS (SELECT doc_id AS ord, 'mod:' || doc_id AS id, 'm' || doc_id AS minified_name,
  CASE WHEN doc_id % 3 = 0 THEN lang || '_' || source END AS semantic_name, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS semantic_confidence,
  CASE WHEN doc_id % 3 = 0 THEN 'given' END AS semantic_source, CASE WHEN doc_id % 3 = 0 THEN source END AS source_file,
  lang AS "wrapKind", source, n_chars AS bytes, len(string_split(text, chr(10))) AS "stmtCount",
  list_sort(list_distinct(list_filter(string_split(text, chr(10)), lambda s: length(s) BETWEEN 2 AND 200))) AS strings,
  array_to_string(list_transform(string_split(text, chr(10)), lambda s: CAST(length(s) // 100 AS VARCHAR)), ':') AS ast_fingerprint
  FROM documents)"""

SEEDS = DOCS + r""",
t AS (SELECT * FROM m WHERE ord % 2 = 0), r AS (SELECT * FROM m WHERE ord % 2 = 1),
te AS (SELECT id, ord, len(strings) AS n, unnest(strings) AS s FROM t WHERE len(strings) >= 2),
re AS (SELECT id, ord, len(strings) AS n, unnest(strings) AS s FROM r WHERE len(strings) >= 2),
ov AS (SELECT te.id AS t_id, te.ord AS t_ord, re.id AS r_id, re.ord AS r_ord, te.n AS tn, re.n AS rn, count(*) AS c FROM te JOIN re USING (s) GROUP BY ALL),
sc AS (SELECT *, c / (tn + rn - c) AS score FROM ov),
rk AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY t_id ORDER BY score DESC, r_ord)),
best AS (SELECT * FROM rk WHERE k = 1 AND score >= 0.15::DOUBLE AND (second IS NULL OR score >= second * 1.3::DOUBLE)),
held AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY score DESC, t_ord) AS w,
  max(score) OVER (PARTITION BY r_id ORDER BY t_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best),
seeds AS (SELECT t_id, t_ord, r_id, r_ord, score AS confidence FROM held WHERE w = 1)"""

VERSIONS = DOCS + r""",
base AS (SELECT *, ['mod:' || (ord + 1), 'mod:' || (ord * 2)] AS deps_out FROM m),
a AS (SELECT * FROM base WHERE ord % 5 <> 0),
b AS (SELECT id, ord, CASE WHEN ord % 4 = 1 THEN 'new_' || "wrapKind" ELSE semantic_name END AS semantic_name, CASE WHEN ord % 4 = 1 THEN 0.5::DOUBLE ELSE semantic_confidence END AS semantic_confidence, source_file,
  CASE WHEN ord % 6 = 1 THEN bytes * 2 ELSE bytes END AS bytes, CASE WHEN ord % 8 = 1 THEN list_reverse(deps_out) ELSE deps_out END AS deps_out, list_append(strings, "wrapKind") AS strings FROM base WHERE ord % 7 <> 0 OR ord % 5 = 0)"""

DIFF = VERSIONS + r""",
d AS (SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'shared' END AS status,
  a.id IS NOT NULL AND b.id IS NOT NULL AND a.semantic_name IS DISTINCT FROM b.semantic_name AS name_changed,
  a.id IS NOT NULL AND b.id IS NOT NULL AND a.deps_out IS DISTINCT FROM b.deps_out AS deps_changed,
  coalesce(abs(a.bytes - b.bytes) > a.bytes * 0.1::DOUBLE, false) AS bytes_changed FROM a FULL JOIN b USING (id))"""

EVOLVE = DOCS + r""",
k AS (SELECT *, (strings, ast_fingerprint, bytes // 256) AS key FROM m),
noise AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) >= 2),
fresh AS (SELECT * FROM k WHERE key NOT IN (SELECT key FROM noise))"""

EDGES = r"""
e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
deg AS (SELECT id, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id)"""

CUSTOMERS = r"""
c AS (SELECT c_custkey AS id, c_name AS name FROM customer),
e AS (SELECT x.src, x.dst FROM (SELECT id AS src, unnest([id * 2, id * 3 + 1]) AS dst FROM c) x JOIN c ON c.id = x.dst)"""

TURNS = r"""
s AS (SELECT conv_id AS bundle_id, turn AS ord, string_split(text, ' ')[1] AS name, list_distinct(string_split(text, ' ')) AS refs, length(text) AS bytes, string_split(text, ' ') AS words,
  CASE WHEN role = 'user' THEN CASE WHEN length(text) % 3 = 0 THEN 'CJS' ELSE 'None' END ELSE CASE WHEN length(text) % 5 = 0 THEN 'ESM' ELSE 'None' END END AS kind FROM conversations),
defs AS (SELECT bundle_id, name, max(ord) AS ord FROM s GROUP BY ALL),
uses AS (SELECT bundle_id, ord AS src, unnest(list_filter(refs, lambda x: x <> name)) AS name FROM s),
edges AS (SELECT DISTINCT bundle_id, src, defs.ord AS dst FROM uses JOIN defs USING (bundle_id, name) WHERE src <> defs.ord)"""

RANGES = r"""
rg AS (SELECT doc_id % 64 AS k, doc_id AS range_id, n_chars, sum(n_chars) OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) AS upto FROM documents),
ev AS (SELECT event_id % 64 AS k, event_id, event_type, event_id * 7919 % total AS o FROM events JOIN (SELECT doc_id % 64 AS k, sum(n_chars) AS total FROM documents GROUP BY 1) n ON n.k = event_id % 64),
hit AS (SELECT event_id, range_id, event_type FROM ev JOIN rg USING (k) WHERE o >= upto - n_chars AND o < upto)"""

COUNTS = r"""
x AS (SELECT *, source || '-' || (doc_id % 60) AS name, doc_id % 60 AS k FROM documents),
tg AS (SELECT DISTINCT name, k FROM x),
t AS (SELECT name, count(*) AS total, count(*) FILTER (lang = 'de') AS runtime, count(*) FILTER (lang = 'es') AS imports FROM x WHERE k % 10 <> 1 GROUP BY 1),
mp AS (SELECT name, count(*) + k % 4 - 1 AS n_sources FROM x WHERE lang IN ('en', 'fr') AND k % 7 <> 0 GROUP BY name, k),
st AS (SELECT name, total - runtime - imports AS countable, n_sources, total - runtime - imports - n_sources AS diff,
  CASE WHEN k % 11 = 0 THEN 'SKIP' WHEN k % 12 = 1 THEN 'NO_BUNDLE' WHEN n_sources IS NULL THEN 'NO_MAP' WHEN total IS NULL THEN 'NO_TRACE' WHEN k % 6 = 2 THEN 'KNOWN_LIMITATION'
    WHEN total - runtime - imports = n_sources THEN 'EXACT' WHEN abs(total - runtime - imports - n_sources) = 1 THEN 'OFF_BY_ONE' ELSE 'MISMATCH' END AS status FROM tg LEFT JOIN mp USING (name) LEFT JOIN t USING (name))"""

FP = "len(list_intersect(list_distinct(string_split({0}, ':')), list_distinct(string_split({1}, ':')))) / greatest(len(list_distinct(string_split({0}, ':'))), len(list_distinct(string_split({1}, ':')))) * (least(len(string_split({0}, ':')), len(string_split({1}, ':'))) / greatest(len(string_split({0}, ':')), len(string_split({1}, ':'))))"

LIST5 = "CASE WHEN len({0}) = 0 THEN 'none' ELSE array_to_string({0}[1:{1}], ', ') || CASE WHEN len({0}) > {1} THEN ' (+' || (len({0}) - {1}) || ' more)' ELSE '' END END"

PAYLOADS = r"""
w AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN '// @bun @bun-cjs' || chr(10) || '(function(exports, require, module) {function  a(){} var' || chr(9) || 'x; require(''y'')' || chr(10) WHEN 1 THEN repeat('-', 201) ELSE '' END
  || CASE WHEN doc_id % 5 < 2 THEN '@bytecode function' || chr(9) || 'f function( var, var' || chr(10) || 'g require (' ELSE '' END || text AS t FROM documents),
p AS (SELECT doc_id, source, CASE WHEN strlen(t) < 1024 THEN 0 ELSE round(log10(strlen(t)) * 100 + CASE WHEN regexp_matches(substring(t, 1, 4096), '\(function\s*\(exports\s*,\s*require\s*,\s*module') THEN 500 ELSE 0 END
  + CASE WHEN regexp_matches(substring(t, 1, 200), '@bytecode|@bun-cjs') THEN 200 ELSE 0 END
  + least(len(regexp_extract_all(substring(t, 1, 200000), '\bfunction\s')), 1000) * 0.5::DOUBLE + least(len(regexp_extract_all(substring(t, 1, 200000), '\bvar\s')), 1000) * 0.3::DOUBLE
  + least(len(regexp_extract_all(substring(t, 1, 200000), '\brequire\(')), 500) * 0.4::DOUBLE, 6) END AS score FROM w)"""

SCRIPT = r"""sc AS (SELECT page_id AS bundle_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS code FROM pages)"""

#: Statements of the bundles made of conversations, and their modules.
CODE = r"""
c0 AS (SELECT conv_id AS b, turn AS o, role AS r, substring(regexp_replace(text, '[^a-z]', '', 'g'), 1, 12) AS w FROM conversations),
s0 AS (SELECT b, o, r, w, CASE r WHEN 'user' THEN 'm' || o WHEN 'assistant' THEN 'f' || o END AS nm,
    CASE r WHEN 'user' THEN 'var m' || o || '=y((e,m)=>{var s="' || w || '";m.exports=s});' WHEN 'assistant' THEN 'function f' || o || '(a){return m' || (o - 1) || '&&a?new Map:"' || w || '"}' ELSE 'init' || o || '("' || w || '");' END AS s FROM c0
  UNION ALL SELECT DISTINCT b, -3, 'y', '', 'y', 'var y=(a,b)=>()=>(b||a((b={exports:{}}).exports,b),b.exports);' FROM c0 WHERE b % 4 <> 3
  UNION ALL SELECT DISTINCT b, -2, 'u', '', 'u', 'var u=(a,b)=>()=>(a&&(b=a(a=0)),b);' FROM c0 WHERE b % 4 < 2
  UNION ALL SELECT DISTINCT b, -1, 'p', '', 'p0', 'var p0=Object.create;' FROM c0),
s1 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o) - 1 AS ord, r = 'user' AND b % 4 <> 3 AS cjs, min(CASE WHEN r = 'user' AND b % 4 <> 3 THEN o END) OVER (PARTITION BY b) AS first_cjs FROM s0),
st AS (SELECT *, CASE WHEN r = 'y' THEN 'RUNTIME_HELPER.__commonJS' WHEN r = 'u' THEN 'RUNTIME_HELPER.__esm' WHEN r = 'p' THEN 'RUNTIME_HELPER.preamble' WHEN cjs THEN 'MODULE_FACTORY.__commonJS' WHEN r = 'user' THEN 'VAR_DECL' WHEN r = 'assistant' THEN 'FUNCTION_DECL' ELSE 'EXPRESSION' END AS category,
    CASE WHEN o < 0 THEN 'RUNTIME' WHEN cjs THEN 'CJS' ELSE 'None' END AS wrap_kind,
    CASE WHEN r = 'y' THEN 'y → __commonJS' WHEN r = 'u' THEN 'u → __esm' WHEN cjs THEN nm || ' (via __commonJS)' ELSE coalesce(nm, '-') END AS name,
    CASE WHEN first_cjs IS NULL OR o < first_cjs THEN 'RUNTIME' WHEN cjs THEN 'CJS' ELSE 'None' END AS kind FROM s1),
pl AS (SELECT *, dense_rank() OVER (PARTITION BY b ORDER BY CASE WHEN kind = 'RUNTIME' THEN -9 ELSE o END) - 1 AS module_id, length(s) AS len FROM st),
mo AS (SELECT b, module_id, any_value(kind) AS kind, arg_min(nm, o) FILTER (nm IS NOT NULL) AS first_name, string_agg(s, chr(10) ORDER BY o) AS t, CASE WHEN count(*) FILTER (r = 'user') > 0 THEN 2 * count(*) FILTER (r = 'user') + count(*) - 1 ELSE count(*) END AS n,
    coalesce(array_to_string(list_sort(list_distinct(list(w) FILTER (length(w) >= 2))), '|'), '') AS strings, coalesce(string_agg(CASE r WHEN 'y' THEN 'AF:AF' WHEN 'u' THEN 'AF:AF' WHEN 'user' THEN 'AF' WHEN 'assistant' THEN 'NEW:RET:FD' END, ':' ORDER BY o), '') AS fp, max(o) AS o FROM pl GROUP BY b, module_id),
co AS (SELECT b, string_agg(s, chr(10) ORDER BY o) AS code FROM st GROUP BY b)"""
MODULE_FILE = "'mod_' || printf('%04d', module_id) || '_' || CASE kind WHEN 'RUNTIME' THEN 'RUNTIME' ELSE first_name END || '.js'"
DECLARED = "FROM st WHERE b % 7 <> 0 AND r IN ('user', 'assistant')"
LONGER = "CASE r WHEN 'user' THEN 'mod_' || o ELSE 'fun_' || o END"



def _round_two() -> str:
    """Two synchronous rounds of name propagation, unrolled."""
    out = [CUSTOMERS, "near AS (SELECT src AS id, dst AS near, 0 AS side FROM e UNION ALL SELECT dst, src, 1 FROM e)", "deg AS (SELECT id, count(*) AS deg FROM near GROUP BY id)", "fan AS (SELECT dst AS near, count(*) AS fan FROM e GROUP BY dst)", "n0 AS (SELECT id, CASE WHEN id % 3 = 0 THEN name END AS nm, CAST(NULL AS DOUBLE) AS conf, CAST(NULL AS VARCHAR) AS how FROM c)"]
    for k in range(2):
        out.append(f"v{k} AS (SELECT near.id, count(*) AS votes, min((-coalesce(fan, 0), side, near.near, n{k}.nm)) AS b FROM near JOIN n{k} ON n{k}.id = near.near AND n{k}.nm IS NOT NULL LEFT JOIN fan ON fan.near = near.near GROUP BY near.id)")
        hit = f"(n{k}.nm IS NULL AND v{k}.votes IS NOT NULL AND v{k}.votes / deg >= 0.4::DOUBLE)"
        out.append(f"n{k + 1} AS (SELECT n{k}.id, CASE WHEN {hit} THEN 'near_' || regexp_replace(b[4], '^near_', '') ELSE nm END AS nm, CASE WHEN {hit} THEN least(0.6::DOUBLE, votes / deg * 0.7::DOUBLE) ELSE conf END AS conf, CASE WHEN {hit} THEN 'propagation' ELSE how END AS how FROM n{k} LEFT JOIN v{k} USING (id) LEFT JOIN deg USING (id))")
    return "WITH " + ",\n".join(out) + " SELECT id, nm AS semantic_name, round(conf, 9) AS semantic_confidence, how AS semantic_source FROM n2"


ORACLES = {
    "seed_match": f"WITH {SEEDS} SELECT t_id, r_id, confidence, 'string_seed' AS technique FROM seeds",
    "seed_acceptances": f"WITH {SEEDS} SELECT count(*) FILTER (before IS NULL OR score > before) AS accepted, count(*) FILTER (w = 1) AS kept FROM held",
    "seed_transfer": f"""WITH {SEEDS} SELECT t.id, CASE WHEN r.id IS NULL THEN t.semantic_name WHEN coalesce(r.semantic_name, '') <> '' THEN r.semantic_name ELSE r.minified_name END AS semantic_name,
        round(CASE WHEN r.id IS NULL THEN t.semantic_confidence ELSE confidence END, 9) AS semantic_confidence, CASE WHEN r.id IS NULL THEN t.semantic_source ELSE 'cross_version_match:string_seed' END AS semantic_source, coalesce(r.source_file, t.source_file) AS source_file
        FROM t LEFT JOIN seeds ON seeds.t_id = t.id LEFT JOIN r ON r.id = seeds.r_id""",
    "string_inventory": f"WITH {DOCS} SELECT id, len(strings) AS n_strings, coalesce(array_to_string(strings[1:3], '|'), '') AS first_strings, least(len(strings), 50) AS n_kept FROM m",
    "kind_profile": f"""WITH {DOCS}, g AS (SELECT source, "wrapKind", count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM m GROUP BY ALL) SELECT *, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (PARTITION BY source), 6) AS pct FROM g""",
    "vlq_decode": r"""WITH d AS (SELECT doc_id, translate(md5(text), '0123456789', 'ABCDEFGHIJ') AS h, unnest(range(6)) AS k FROM documents), v AS (SELECT doc_id, k, list_transform(range(5), lambda j: instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef', substring(h, 5 * k + j + 1, 1)) - 1) AS c FROM d),
        n AS (SELECT doc_id, k, list_transform(c, lambda x: CASE WHEN x % 2 = 1 THEN -(x // 2) ELSE x // 2 END) AS f FROM v)
        SELECT doc_id AS map_id, k // 2 AS gen_line, k % 2 AS seg, CAST(sum(f[1]) OVER (PARTITION BY doc_id, k // 2 ORDER BY k) AS BIGINT) AS gen_col, CAST(sum(f[2]) OVER w AS BIGINT) AS source_idx, CAST(sum(f[3]) OVER w AS BIGINT) AS source_line, CAST(sum(f[4]) OVER w AS BIGINT) AS source_col, CAST(sum(f[5]) OVER w AS BIGINT) AS name_idx FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY k)""",
    "payload_scores": f"WITH {PAYLOADS} SELECT doc_id, score FROM p",
    "best_payload": f"WITH {PAYLOADS} SELECT source AS path, doc_id AS payload_ix, score FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1",
    "graph_stats": f"WITH {DOCS} SELECT source, count(*) AS modules, count(semantic_name) AS named, CAST(sum(len(strings)) AS BIGINT) AS strings, count(*) FILTER (ast_fingerprint <> '') AS fingerprints, CAST(sum(bytes) AS BIGINT) AS bytes, round(count(semantic_name) / count(*), 6) AS named_ratio FROM m GROUP BY source",
    "largest_modules": f"WITH {DOCS} SELECT id, ord, bytes FROM m ORDER BY bytes DESC, ord LIMIT 15",
    "largest_per_source": f"WITH {DOCS} SELECT source, id, ord, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bytes DESC, ord) AS rank FROM m) WHERE rank <= 5",
    "string_search": f"WITH {DOCS} SELECT DISTINCT id FROM (SELECT id, unnest(strings) AS s FROM m) WHERE regexp_matches(s, '(?i)th.*nd|que l|der ')",
    "string_samples": f"WITH {DOCS} SELECT id, coalesce(array_to_string(list_filter(strings, lambda s: length(s) > 4 AND s NOT IN ('__esModule', 'default', 'function', 'object', 'string', 'number', 'undefined', 'null', 'true', 'false'))[1:6], '|'), '') AS sample FROM m",
    "edge_degrees": f"WITH {EDGES} SELECT * FROM deg",
    "edge_hubs": f"WITH {EDGES} SELECT id, fan_in, row_number() OVER (ORDER BY fan_in DESC, id) AS rank FROM deg QUALIFY rank <= 10",
    "bounded_closure": f"""WITH {CUSTOMERS}, d0 AS (SELECT DISTINCT src AS start, src AS id, 0 AS depth FROM e), d1 AS (SELECT start, dst AS id, 1 AS depth FROM d0 JOIN e ON e.src = d0.id), d2 AS (SELECT start, dst AS id, 2 AS depth FROM d1 JOIN e ON e.src = d1.id), d3 AS (SELECT start, dst AS id, 3 AS depth FROM d2 JOIN e ON e.src = d2.id)
        SELECT start, id, min(depth) AS depth FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2 UNION ALL FROM d3) GROUP BY ALL""",
    "propagate_two_rounds": _round_two(),
    "merge_graphs": f"""WITH {VERSIONS} SELECT id, CASE WHEN a.id IS NULL OR win THEN b_name ELSE a.semantic_name END AS semantic_name, CASE WHEN a.id IS NULL OR win THEN b_conf ELSE a.semantic_confidence END AS semantic_confidence,
        CASE WHEN a.id IS NULL THEN b_file ELSE coalesce(a.source_file, b_file) END AS source_file, CASE WHEN a.id IS NULL THEN b_bytes ELSE a.bytes END AS bytes,
        CASE WHEN a.id IS NULL THEN len(b_strings) WHEN b_strings IS NULL THEN len(a.strings) ELSE least(50, len(list_distinct(list_concat(a.strings, b_strings)))) END AS n_strings, coalesce(win AND a.semantic_name <> '' AND a.semantic_name <> b_name, false) AS conflict
        FROM (SELECT id, x.semantic_name AS b_name, x.semantic_confidence AS b_conf, x.source_file AS b_file, x.bytes AS b_bytes, x.strings AS b_strings, y.id IS NOT NULL AND coalesce(x.semantic_confidence, 0) > coalesce(y.semantic_confidence, 0) AND x.semantic_name IS NOT NULL AS win FROM b x LEFT JOIN a y USING (id)) FULL JOIN a USING (id)""",
    "merge_identifiers": """WITH x AS (SELECT doc_id AS id, lang AS semantic, (doc_id % 7) / 7.0::DOUBLE AS confidence FROM documents), y AS (SELECT doc_id + 5 AS id, source AS semantic, (doc_id % 5) / 5.0::DOUBLE AS confidence FROM documents)
        SELECT id, CASE WHEN x.id IS NULL OR (y.id IS NOT NULL AND y.confidence > x.confidence) THEN y.semantic ELSE x.semantic END AS semantic, CASE WHEN x.id IS NULL OR (y.id IS NOT NULL AND y.confidence > x.confidence) THEN y.confidence ELSE x.confidence END AS confidence FROM x FULL JOIN y USING (id)""",
    "diff_graphs": f"WITH {DIFF} SELECT * FROM d",
    "diff_counts": f"WITH {DIFF} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'shared') AS shared, count(*) FILTER (name_changed) AS name_changed, count(*) FILTER (deps_changed) AS deps_changed, count(*) FILTER (bytes_changed) AS bytes_changed FROM d",
    "evolve_new": f"WITH {EVOLVE} SELECT source, id, bytes, row_number() OVER (PARTITION BY source ORDER BY bytes DESC, ord) AS rank FROM fresh",
    "evolve_report": f"""WITH {EVOLVE}, kinds AS (SELECT source, "wrapKind" AS w, count(*) AS n FROM fresh GROUP BY ALL), kk AS (SELECT source, string_agg(w || '=' || n, ',' ORDER BY w) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM kinds GROUP BY source)
        SELECT source, r.n AS unmatched_raw, coalesce(kk.n, 0) AS real_new, r.n - coalesce(kk.n, 0) AS noise_filtered, kinds FROM (SELECT source, count(*) AS n FROM m GROUP BY source) r LEFT JOIN kk USING (source)""",
    "pair_votes": """WITH n AS (SELECT 'p' || (l_partkey % 500) AS minified, 's' || least(l_suppkey % 7, 1) AS semantic, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS kinds, row_number() OVER (PARTITION BY minified ORDER BY n DESC, semantic) AS r FROM n WINDOW w AS (PARTITION BY minified))
        SELECT minified, semantic, n, round(n / total, 9) AS confidence FROM k WHERE r = 1 AND (kinds = 1 OR n / total > 0.7::DOUBLE)""",
    "rename_claims": "WITH p AS (SELECT source AS module, doc_id % 20 AS module_ord, doc_id AS ord, string_split(text, ' ')[1] AS semantic FROM documents) SELECT module, module_ord, ord, semantic FROM p WHERE semantic NOT IN (SELECT string_split(text, ' ')[1] FROM benchmark) QUALIFY row_number() OVER (PARTITION BY semantic ORDER BY module_ord, ord) = 1",
    "first_pairs": "SELECT o_custkey AS module, o_orderpriority AS minified, arg_min(o_orderstatus, o_orderkey) AS semantic, min(o_orderkey) AS ord FROM orders GROUP BY ALL",
    "offset_ranges": f"WITH {RANGES} SELECT event_id, range_id FROM hit",
    "range_mode": f"WITH {RANGES}, n AS (SELECT range_id, event_type AS source, count(*) AS n, min(event_id) AS f FROM hit GROUP BY ALL) SELECT range_id, arg_max(source, (n, -f)) AS source, CAST(sum(n) AS BIGINT) AS votes FROM n GROUP BY range_id",
    "line_offsets": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents) SELECT doc_id AS map_id, k AS gen_line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM l",
    "identifier_at": "SELECT doc_id, regexp_extract(substring(text, doc_id % 50 + 1, 100), '^[a-zA-Z_$][a-zA-Z0-9_$]*', 0) AS name FROM documents",
    "url_names": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\.[^.]*$', '') AS name FROM pages",
    "definitions": f"WITH {TURNS} SELECT bundle_id, name, ord FROM defs",
    "statement_edges": f"WITH {TURNS} SELECT bundle_id, src, dst FROM edges",
    "module_edges": f"WITH {TURNS} SELECT DISTINCT bundle_id, src // 2 AS src, dst // 2 AS dst FROM edges WHERE src // 2 <> dst // 2",
    "free_runs": f"WITH {TURNS}, g AS (SELECT *, sum(CASE WHEN kind = 'None' THEN 0 ELSE 1 END) OVER (PARTITION BY bundle_id ORDER BY ord) AS run FROM s) SELECT bundle_id, min(ord) AS first, max(ord) AS last, count(*) AS n FROM g WHERE kind = 'None' GROUP BY bundle_id, run",
    "backtrace": f"""WITH {TURNS}, f AS (SELECT *, min(CASE WHEN kind <> 'None' THEN ord END) OVER (PARTITION BY bundle_id) AS fst FROM s), g AS (SELECT bundle_id, ord, name, words[-1] AS last, CASE WHEN kind = 'None' AND (fst IS NULL OR ord < fst) THEN 'RUNTIME' ELSE kind END AS kind FROM f),
        nx AS (SELECT *, min(CASE WHEN kind <> 'None' THEN ord END) OVER (PARTITION BY bundle_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nord FROM g), h AS (SELECT nx.*, k.kind AS nkind FROM nx LEFT JOIN g k ON k.bundle_id = nx.bundle_id AND k.ord = nx.nord),
        j AS (SELECT bundle_id, ord, name, last, CASE WHEN kind = 'None' AND nkind = 'ESM' THEN 'ESM' ELSE kind END AS kind, CASE WHEN kind = 'RUNTIME' THEN -2 WHEN kind IN ('CJS', 'ESM') THEN ord WHEN kind = 'None' AND nkind = 'ESM' THEN nord END AS module FROM h)
        SELECT bundle_id, ord, CASE WHEN kind = 'None' AND EXISTS (SELECT 1 FROM j q WHERE q.bundle_id = j.bundle_id AND q.kind IN ('CJS', 'ESM') AND q.name = j.last) THEN 'IMPORT' ELSE kind END AS kind, module FROM j""",
    "module_rollup": f"WITH {TURNS} SELECT bundle_id, ord // 3 AS module_id, min(ord * 2) AS line_start, max(ord * 2 + 1) AS line_end, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS stmt_count, arg_min(name, ord) AS first_name FROM s GROUP BY ALL",
    "structure_scores": f"""WITH {SEEDS}, ft AS (SELECT *, list_distinct(list_transform(list_filter(strings, lambda s: length(s) >= 6), lambda s: substring(s, 1, 30))) AS f FROM m), ta AS (SELECT * FROM ft WHERE ord % 2 = 0 AND len(f) >= 3), ra AS (SELECT * FROM ft WHERE ord % 2 = 1 AND len(f) >= 3),
        q AS (SELECT ta.id AS t_id, ra.id AS r_id, ra.ord AS r_ord, len(list_intersect(ta.f, ra.f)) AS c, len(ta.f) AS a, len(ra.f) AS b, (CASE WHEN ta."stmtCount" = ra."stmtCount" THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN ta."wrapKind" = ra."wrapKind" THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN ta.bytes > 0 AND ra.bytes > 0 AND abs(ta.bytes - ra.bytes) / greatest(ta.bytes, ra.bytes) < 0.3::DOUBLE THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM ta, ra),
        z AS (SELECT *, c / (a + b - c) + boost AS score FROM q), y AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM z WINDOW w AS (PARTITION BY t_id ORDER BY score DESC, r_ord))
        SELECT t_id, r_id, round(score, 9) AS score FROM y WHERE k = 1 AND score >= 0.10::DOUBLE AND (second = 0 OR score >= second * 1.3::DOUBLE)""",
    "fingerprint_match": f"""WITH {SEEDS}, lt AS (SELECT * FROM t WHERE id NOT IN (SELECT t_id FROM seeds) AND 'mod:' || (ord + 2) IN (SELECT t_id FROM seeds) AND len(string_split(ast_fingerprint, ':')) >= 5), fr AS (SELECT * FROM r WHERE id NOT IN (SELECT r_id FROM seeds)),
        z AS (SELECT lt.id AS t_id, lt.ord AS t_ord, fr.id AS r_id, fr.ord AS r_ord, {FP.format("lt.ast_fingerprint", "fr.ast_fingerprint")} AS score FROM lt, fr), y AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM z WINDOW w AS (PARTITION BY t_id ORDER BY score DESC, r_ord))
        SELECT t_id, r_id, round(score * 0.8::DOUBLE, 9) AS confidence FROM y WHERE k = 1 AND score >= 0.7::DOUBLE AND (second = 0 OR score >= second * 1.2::DOUBLE) QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY t_ord) = 1""",
    "fingerprint_similarity": f"WITH {DOCS} SELECT a.id, CASE WHEN a.ast_fingerprint <> '' AND b.ast_fingerprint <> '' THEN round({FP.format('a.ast_fingerprint', 'b.ast_fingerprint')}, 9) ELSE 0 END AS similarity FROM m a JOIN m b ON b.ord = a.ord + 1",
    "neighbour_round": f"""WITH {DOCS}, t AS (SELECT * FROM m WHERE ord % 2 = 0), r AS (SELECT * FROM m WHERE ord % 2 = 1), seeds AS (SELECT t.id AS t_id, r.id AS r_id FROM t JOIN r ON r.ord = t.ord + 1 WHERE (t.ord // 2) % 3 <> 0), ring AS (SELECT id, 'mod:' || (ord + unnest([2, 4, 6])) AS near, true AS o, ord FROM m), ed AS (SELECT id, near, o, ord % 2 AS side FROM ring UNION ALL SELECT near, id, false, ord % 2 FROM ring),
        seen AS (SELECT ed.id, seeds.r_id AS rn, o FROM ed JOIN seeds ON seeds.t_id = ed.near WHERE side = 0 AND ed.id NOT IN (SELECT t_id FROM seeds)), tot AS (SELECT id, count(*) AS n FROM seen GROUP BY id),
        v AS (SELECT seen.id, b.near AS r_id, count(*) AS score FROM seen JOIN ed b ON b.side = 1 AND b.id = seen.rn AND b.o <> seen.o WHERE b.near NOT IN (SELECT r_id FROM seeds) GROUP BY ALL),
        w AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY id ORDER BY score DESC, r_id))
        SELECT w.id AS t_id, w.r_id, round(least(0.95::DOUBLE, 0.5::DOUBLE + score / n * 0.3::DOUBLE + CASE WHEN x.ast_fingerprint <> '' AND y.ast_fingerprint <> '' THEN {FP.format("x.ast_fingerprint", "y.ast_fingerprint")} ELSE 0 END * 0.3::DOUBLE), 9) AS confidence
        FROM w JOIN tot USING (id) JOIN t x ON x.id = w.id JOIN r y ON y.id = w.r_id WHERE k = 1 AND score >= 2 AND score > second QUALIFY row_number() OVER (PARTITION BY w.r_id ORDER BY x.ord) = 1""",
    "set_operations": f"WITH {DOCS} SELECT a.id, len(list_distinct(list_concat(a.strings, b.strings))) AS n_union, len(list_intersect(a.strings, b.strings)) AS n_both, len(a.strings) - len(list_intersect(a.strings, b.strings)) AS n_only, least(50, len(list_distinct(list_concat(a.strings, b.strings)))) AS n_kept FROM m a JOIN m b ON b.ord = a.ord + 1",
    "statement_comments": f"""WITH {DOCS} SELECT id AS name, '/* === [' || printf('%04d', ord * 101) || '] TYPE: VAR_DECL.' || "wrapKind" || ' | WRAPKIND: ' || "wrapKind" || ' | NAME: ' || id || ' | LINES: ' || ord || '-' || (ord + 1) || ' | BYTES: ' || bytes || ' === */' AS comment FROM m""",
    "name_headers": f"""WITH {VERSIONS}, h AS (SELECT id, '// name: ' || CASE WHEN semantic_name IS NOT NULL THEN semantic_name || ' (' || CAST(round(semantic_confidence * 100) AS INT) || '%)' ELSE 'unnamed' END || chr(10) || '// source: ' || coalesce(semantic_source, 'none') || chr(10) || '// depends on: ' || {LIST5.format("deps_out", 5)} || chr(10) || '// used by: ' || id || chr(10) || '// strings: ' || coalesce(array_to_string(list_transform(strings[1:3], lambda s: substring(s, 1, 30)), ' | '), '') || chr(10) AS h FROM a) SELECT id, md5(h) AS header_md5, length(h) AS header_length FROM h""",
    "doc_headers": f"""WITH {VERSIONS}, nm AS (SELECT id, coalesce(semantic_name, minified_name) AS n FROM a), dp AS (SELECT a.id, coalesce(x.n, deps_out[1]) || ', ' || coalesce(y.n, deps_out[2]) AS l FROM a LEFT JOIN nm x ON x.id = deps_out[1] LEFT JOIN nm y ON y.id = deps_out[2])
        SELECT id, md5('/**' || chr(10) || ' * @module ' || id || chr(10) || ' * @name ' || n || chr(10) || ' * @source ' || coalesce(source_file, 'unknown') || chr(10) || ' * @matched ' || coalesce(semantic_source, 'none') || chr(10) || ' * @wrap ' || "wrapKind" || chr(10) || ' * @imports ' || l || chr(10) || ' * @importedBy 1' || chr(10) || ' * @stats ' || "stmtCount" || ' statements, ' || bytes || ' bytes' || chr(10) || ' */' || chr(10)) AS header_md5 FROM a JOIN nm USING (id) JOIN dp USING (id)""",
    "find_modules": f"""WITH {DOCS}, f AS (SELECT doc_id * 134 AS num, doc_id * 3 AS n FROM documents)
        SELECT 'mod_' || printf('%04d', num) || '_m' || n || '.js' AS filename, coalesce(x.i, y.i) AS id FROM f LEFT JOIN (SELECT 'mod:' || ord * 67 AS i, minified_name FROM m) x ON x.minified_name = 'm' || n LEFT JOIN (SELECT 'mod:' || ord * 67 AS i, ord * 67 AS o FROM m) y ON y.o = num""",
    "reassembled": "WITH t AS (SELECT source AS bkg_id, '#!/usr/bin/env node' || chr(10) || string_agg('// --- d' || doc_id || ' ---' || chr(10) || text, chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source) SELECT bkg_id, sha256(t) AS sha256, length(t) AS length FROM t",
    "file_names": "WITH p AS (SELECT p_partkey, p_name, 'mod_' || printf('%04d', p_partkey * 37) || '_' || p_name || '.js' AS f FROM part) SELECT p_partkey, p_name AS name, p_name AS bare, sha256(f) AS sha256 FROM p",
    "runs_next": "SELECT o_orderstatus, max(o_orderkey % 120) + 1 AS next_run FROM orders GROUP BY 1",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "ground_truth": "SELECT d.doc_id::VARCHAR AS minified, CASE WHEN length(text) > 800 THEN '1' ELSE '0' END AS semantic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = CASE WHEN length(text) > 800 THEN 1 ELSE 0 END",
    "module_counts": f"WITH {COUNTS} SELECT * FROM st",
    "count_status": f"WITH {COUNTS} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "identifier_coverage": "WITH d AS (SELECT source, doc_id % 3 AS k FROM documents) SELECT source, count(*) FILTER (k = 0) AS identifiers_semantic, count(*) FILTER (k = 1) AS identifiers_placeholder, count(*) FILTER (k = 2) AS identifiers_raw, round(count(*) FILTER (k = 0) / count(*), 6) AS coverage_semantic, round((count(*) FILTER (k = 0) + count(*) FILTER (k = 1)) / count(*), 6) AS coverage_touched FROM d GROUP BY 1",
    "positional_zip": "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents) SELECT a.doc_id, count(*) FILTER (a.x = b.x) AS identity, count(*) FILTER (a.x <> b.x AND length(b.x) >= 2) AS renamed, count(*) FILTER (a.x <> b.x AND length(b.x) < 2) AS short FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND b.k = a.k GROUP BY 1",
    "script_statements": f"WITH {CODE} SELECT b AS bundle_id, ord, category, wrap_kind, name, length(s) AS bytes FROM st",
    "script_bundlers": f"WITH {CODE} SELECT b AS bundle_id, CASE WHEN b % 4 = 3 THEN 'unknown' ELSE 'esbuild' END AS bundler, CASE WHEN b % 4 < 2 THEN 'high' WHEN b % 4 = 2 THEN 'medium' ELSE 'low' END AS confidence FROM co",
    "script_bytes": f"WITH {CODE} SELECT b AS bundle_id, CAST(sum(length(s)) AS BIGINT) AS statement_bytes, count(*) - 1 AS gap_bytes, CAST(sum(length(s)) + count(*) - 1 AS BIGINT) AS total, true AS balanced FROM st GROUP BY b",
    "script_graph": f"""WITH {CODE} SELECT b AS bkg_id, 'mod:' || first_name AS id, kind AS "wrapKind", n AS "stmtCount", strings, fp AS ast_fingerprint, CASE kind WHEN 'CJS' THEN 'mod:y' WHEN 'None' THEN 'mod:m' || (o - 1) ELSE '' END AS deps_out FROM mo""",
    "beautified_scripts": f"""WITH {SCRIPT} SELECT bundle_id, regexp_replace(code, ';', ';' || chr(10), 'g') AS text, round((length(code) + 2) / length(code), 2) AS ratio FROM sc""",
    "split_modules": f"WITH {CODE} SELECT b AS bundle_id, {MODULE_FILE} AS filename, n AS stmt_count, md5(t) AS text_md5, true AS parseable FROM mo",
    "annotated_scripts": f"""WITH {CODE} SELECT b AS bundle_id, md5(string_agg('/* === [' || printf('%04d', ord) || '] TYPE: ' || category || ' | WRAPKIND: ' || wrap_kind || ' | NAME: ' || name || ' | LINES: ' || (ord + 1) || '-' || (ord + 1) || ' | BYTES: ' || length(s) || ' === */' || chr(10) || s, chr(10) ORDER BY o)) AS text_md5 FROM st GROUP BY b""",
    "traced_scripts": f"""WITH {CODE}, f AS (SELECT *, row_number() OVER (PARTITION BY b, module_id ORDER BY o) AS k FROM pl) SELECT b AS bundle_id, md5(string_agg(CASE WHEN k = 1 THEN '/* --- module ' || module_id || ' (' || kind || ') --- */' || chr(10) ELSE '' END || s, chr(10) ORDER BY o)) AS text_md5 FROM f GROUP BY b""",
    "split_totals": f"""WITH {CODE} SELECT b AS bundle_id, kind AS "wrapKind", count(*) AS modules, CAST(sum(length(t)) AS BIGINT) AS bytes, count(*) AS parseable, printf('%.1f', CAST(sum(length(t)) * 100.0 / any_value(length(code)) AS DOUBLE)) AS coverage FROM mo JOIN co USING (b) GROUP BY b, kind""",
    "aligned_declarations": f"WITH {CODE} SELECT b AS pair, nm AS minified, {LONGER} AS semantic {DECLARED}",
    "aligned_scopes": f"WITH {CODE} SELECT b AS pair, nm AS minified, {LONGER} AS semantic {DECLARED} AND nm <> 'm2'",
    "declaration_counts": f"WITH {CODE}, n AS (SELECT b, count(nm) + count(*) FILTER (r = 'user') AS t FROM st GROUP BY b) SELECT b AS pair, t, t + CASE WHEN b % 7 = 0 THEN 1 ELSE 0 END AS r, CASE WHEN b % 7 = 0 THEN 'close' ELSE 'exact' END AS status FROM n",
    "names_in_use": f"WITH {CODE}, n AS (SELECT b, unnest(CASE r WHEN 'user' THEN [nm] WHEN 'assistant' THEN [nm, 'm' || (o - 1)] WHEN 'p' THEN ['p0'] WHEN 'system' THEN ['init' || o] ELSE [] END) AS name FROM st) SELECT DISTINCT b AS bundle_id, name FROM n",
    "script_renames": f"""WITH {CODE}, x AS (SELECT b, string_agg(CASE r WHEN 'user' THEN replace(s, 'var m', 'var renamed_') WHEN 'assistant' THEN replace(s, 'return m', 'return renamed_') ELSE s END, chr(10) ORDER BY o) AS t, count(*) FILTER (r IN ('user', 'assistant')) AS k FROM st GROUP BY b)
        SELECT b::VARCHAR AS module, md5(CASE WHEN b % 5 = 0 THEN code ELSE t END) AS renamed_md5, CASE WHEN b % 5 = 0 THEN 0 ELSE k END AS replaced, b % 5 = 0 AS reverted FROM x JOIN co USING (b)""",
    "source_map_modules": """WITH d AS (SELECT *, doc_id % 3 = 0 AS given, unnest(['mod:a', 'mod:b']) AS id FROM documents), e AS (SELECT *, CASE WHEN id = 'mod:a' THEN 'src/' || lang || '.ts' WHEN length(text) > 16 THEN 'lib/' || source || '.js' END AS f FROM d)
        SELECT doc_id::VARCHAR AS bkg_id, id, CASE WHEN f IS NOT NULL AND (NOT given OR doc_id % 2 = 0) THEN CASE WHEN id = 'mod:a' THEN lang ELSE source END WHEN given THEN 'given' END AS semantic_name, CASE WHEN f IS NOT NULL AND (NOT given OR doc_id % 2 = 0) THEN 0.95::DOUBLE WHEN given THEN 0.7::DOUBLE END AS semantic_confidence,
        CASE WHEN f IS NOT NULL AND (NOT given OR doc_id % 2 = 0) THEN 'source_map_file' WHEN given THEN CASE WHEN doc_id % 2 = 0 THEN 'propagation' ELSE 'manual' END END AS semantic_source, f AS source_file FROM e""",
    "source_map_identifiers": """WITH d AS (SELECT doc_id, unnest(['mod:a', 'mod:b']) AS module, unnest(['firstName', 'otherName']) AS semantic, unnest([substring(text, 1, 100), CASE WHEN length(text) > 16 THEN substring(text, 17, 100) ELSE '' END]) AS t FROM documents), x AS (SELECT *, regexp_extract(t, '^[a-zA-Z_$][a-zA-Z0-9_$]*', 0) AS minified FROM d)
        SELECT doc_id::VARCHAR AS bkg_id, 'var:' || module || ':' || minified AS id, minified, semantic, 'semantic' AS state, 'source_map' AS source FROM x WHERE minified <> ''""",
    "unwrapped": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '// c' || chr(10) || text ELSE '(function (exports) {' || text || '})' END) AS body_md5 FROM documents",
    "inferred_names": rf"WITH {CODE}, f AS (SELECT b, list_filter(regexp_extract_all(code, '[a-zA-Z_$][a-zA-Z0-9_$]*'), lambda x: length(x) <= 3 AND x NOT IN ('var', 'new'))[1] AS m FROM co) SELECT b::VARCHAR AS module, 0::BIGINT AS ord, m AS minified, 'named_' || m AS semantic FROM f",
    "edge_totals": f"WITH {TURNS}, n AS (SELECT bundle_id, count(*) AS top_level_names FROM defs GROUP BY 1), x AS (SELECT bundle_id, count(*) AS total_edges FROM edges GROUP BY 1) SELECT bundle_id, coalesce(total_edges, 0) AS total_edges, top_level_names FROM n LEFT JOIN x USING (bundle_id)",
    "kinds_by_count": f"""WITH {DOCS}, n AS (SELECT source, "wrapKind", count(*) AS n, min(ord) AS f FROM m GROUP BY ALL) SELECT source, "wrapKind", n, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS rank FROM n""",
    "full_closure": f"WITH RECURSIVE {CUSTOMERS}, reach AS (SELECT DISTINCT src AS start, src AS id FROM e UNION SELECT reach.start, e.dst FROM reach JOIN e ON e.src = reach.id) SELECT * FROM reach",
    "merged_documents": f"""WITH {VERSIONS}, va AS (SELECT *, ord // 20 AS g FROM a), vb AS (SELECT *, ord // 20 AS g FROM b), ga AS (SELECT DISTINCT g FROM va), gb AS (SELECT DISTINCT g FROM vb),
        j AS (SELECT coalesce(va.g, vb.g) AS g, id, coalesce(va.ord, vb.ord) AS ord, va.id IS NULL AS late, va.id IS NOT NULL AND vb.semantic_name <> '' AND coalesce(vb.semantic_confidence, 0) > coalesce(va.semantic_confidence, 0) AS won, va.id IS NULL AS new, va.semantic_name AS na, vb.semantic_name AS nb FROM va FULL JOIN vb USING (id)),
        mo AS (SELECT g, string_agg(id, ',' ORDER BY late, ord) AS ids, count(*) FILTER (CASE WHEN won OR new THEN nb ELSE na END <> '') AS named, count(*) FILTER (won AND na <> '' AND na <> nb) AS conflicts FROM j GROUP BY g),
        sh AS (SELECT unnest([0, 1]) AS s), idt AS (SELECT doc_id, doc_id // 20 AS g, s, CASE WHEN doc_id % 3 = s THEN 'semantic' WHEN doc_id % 3 = 2 THEN 'placeholder' ELSE 'raw' END AS state, (doc_id * (3 + s)) % 7 AS c, doc_id % 4 = s AS note FROM documents, sh WHERE doc_id % (5 + s) <> 0),
        kept AS (SELECT g, 'var:' || doc_id AS id, arg_max(state, (c, -s)) AS state, min(s) AS s FROM idt GROUP BY g, doc_id),
        ids AS (SELECT g, string_agg(id || '=' || state, ',' ORDER BY s, id) AS identifiers, count(*) FILTER (state = 'semantic') AS semantic FROM kept GROUP BY g), nt AS (SELECT g, count(*) FILTER (note) AS n FROM idt GROUP BY g)
        SELECT 'g' || g AS bkg_id, mo.ids, named, coalesce(identifiers, '') AS identifiers, coalesce(semantic, 0) AS semantic, coalesce(nt.n, 0) AS n_annotations, 'side0,side1,merge' AS techniques, 'merge: ' || conflicts || ' conflicts resolved by confidence' AS provenance FROM ga JOIN gb USING (g) JOIN mo USING (g) LEFT JOIN ids USING (g) LEFT JOIN nt USING (g)""",
    "graph_errors": f"""WITH {VERSIONS}, p AS (SELECT ord // 20 AS g, row_number() OVER (PARTITION BY ord // 20 ORDER BY ord) - 1 AS i FROM a), gs AS (SELECT DISTINCT g FROM p)
        SELECT 'g' || g AS bkg_id, CASE WHEN g % 5 = 0 THEN 'version is 2.0' ELSE 'version is missing' END AS error FROM gs WHERE g % 5 < 2 UNION ALL SELECT 'g' || g, 'bundle is missing' FROM gs WHERE g % 6 = 2
        UNION ALL SELECT 'g' || g, 'module 1 has no id' FROM p WHERE g % 3 = 0 AND i = 1 UNION ALL SELECT 'g' || g, 'id used twice: same' FROM p WHERE g % 4 = 1 AND i > 13 GROUP BY g HAVING count(*) > 1""",
    "paired_files": """WITH p AS (SELECT doc_id, doc_id * 2 AS r, text FROM documents WHERE doc_id % 3 <> 1) SELECT 'm' || p.doc_id AS minified_name, 'm' || p.r AS ref_name, md5(p.text) AS target_md5, md5(d.text) AS ref_md5 FROM p JOIN documents d ON d.doc_id = p.r""",
    "statement_kinds": f"WITH {CODE} SELECT b AS bundle_id, ord, kind FROM st",
    "runtime_names": f"WITH {CODE}, n AS (SELECT b, unnest(CASE r WHEN 'user' THEN [nm] WHEN 'assistant' THEN [nm, 'm' || (o - 1)] WHEN 'p' THEN ['p0'] WHEN 'system' THEN ['init' || o] ELSE [] END) AS name FROM st WHERE kind = 'RUNTIME') SELECT DISTINCT b AS bundle_id, name FROM n",
    "run_folders": """WITH o AS (SELECT o_orderkey, '/d' || (o_custkey % 50) AS base, o_custkey % 50 < 40 AS has FROM orders), n AS (SELECT base, max(o_orderkey % 97) + 1 AS nx FROM o WHERE has GROUP BY 1)
        SELECT o_orderkey, base || '/RUN_' || printf('%02d', CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 30 ELSE coalesce(nx, 0) END) AS folder, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 30 ELSE coalesce(nx, 0) END AS run, o_orderkey % 3 = 0 AS existing FROM o LEFT JOIN n USING (base)""",
    "provenance": """WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN event_id ELSE -(event_id // 7) - 1 END AS run, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, event_id, event_type FROM events),
        d AS (SELECT run, ts, event_id, '{"timestamp":"' || ts || '","stage":' || event_id || ',"tool":"' || event_type || '"}' AS j FROM e)
        SELECT run, CASE WHEN count(*) = 1 THEN any_value(j) ELSE '{"stages":[' || string_agg(j, ',' ORDER BY ts, event_id) || '],"last_updated":"' || max(ts) || '"}' END AS document FROM d GROUP BY run""",
}
