"""DuckDB SQL of the queries that SQL can express."""

from bundlelens.plans.queries import _RANK, _SEVERITY, LOG_RULES, PRODUCTS
from bundlelens.functions.text import STOP_WORDS

_LINES = "(SELECT doc_id, source, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS x FROM documents))"
_FULL = f"(SELECT * FROM {_LINES} WHERE trim(line, ' ') <> '')"
_MATCH = " UNION ALL ".join(f"SELECT doc_id, source, line_no, line, '{r['id']}' AS rule_id FROM l WHERE regexp_matches(line, '{'(?i)' if 'i' in r['flags'] else ''}{r['regex']}')" for r in LOG_RULES)
_RULES = ", ".join(f"('{r['id']}', '{r['severity']}', '{r['category']}', '{r['title']}')" for r in LOG_RULES)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9._-]*'), lambda t: length(t) > 1 AND t NOT IN (" + _STOP + "))"
_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&rsquo;", "''"), ("&lsquo;", "''"), ("&rdquo;", '"'), ("&ldquo;", '"'), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&")]


def _decoded(x: str) -> str:
    for a, b in _ENT:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _collapsed(x: str) -> str:
    return _replaced(x, ("\\r", ""), ("[ \\t\\f\\v]+", " "), ("\\n[ \\t]+", "\n"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", ""))


_ARTICLE = "regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"
_BODY = _collapsed(_decoded(_replaced(_ARTICLE, *[(f"(?is)<{t}\\b.*?</{t}>", " ") for t in ("script", "style", "nav", "footer")], ("(?i)<pre\\b[^>]*>", "\n"), ("(?i)</pre>", "\n"), ("(?i)<br\\s*/?>", "\n"), ("(?i)</(p|div|section|article|h[1-6]|li|ol|ul|tr)>", "\n"), ("(?i)<li\\b[^>]*>", "- "), ("<[^>]+>", " "))))
_TITLE = _collapsed(_decoded(_replaced("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)", ("<[^>]+>", " "))))
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PLAIN_TITLE = f"coalesce(trim(regexp_replace(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '' AND length(x) <= 120 AND NOT regexp_matches(x, '[.!?]$'))[1], '^#{{1,6}}\\s+', '')), '')"
_PRODUCT = "CASE lang WHEN 'fr' THEN 'harvester' WHEN 'de' THEN 'longhorn' ELSE {0} END"
_OPEN = "regexp_extract(acc, '[^' || chr(2) || ']*$')"
_SHUT = f"substr(acc, 1, length(acc) - length({_OPEN}))"
_TAIL = _STRIP.format(f"right({_OPEN}, 180)")
#: Documents (d), their chunks (c: doc_id, id, title, product, chunk_index, content): paragraphs are folded
#: into one text, closed chunks with a mark behind each.
_CHUNKS = f"""d AS (SELECT doc_id, printf('kb_%012d', doc_id) AS id, {_PLAIN_TITLE} AS title, {_PRODUCT.format("'unknown'")} AS product, {_collapsed('text')} AS body FROM documents),
  p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '\\n{{2,}}', chr(1), 'g'), '\\n(#{{1,6}}\\s|- )', chr(1) || '\\1', 'g'), '\\n([A-Z][^.\\n' || chr(1) || ']{{2,80}})$', chr(1) || '\\1'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS paras FROM d),
  f AS (SELECT *, list_reduce(list_prepend('', paras), lambda acc, p: CASE
      WHEN length(p) > 1800 THEN {_SHUT} || CASE WHEN {_OPEN} <> '' THEN {_OPEN} || chr(2) ELSE '' END || array_to_string(list_transform(range(0, greatest(1, length(p) - 180), 1620), lambda s: {_STRIP.format('substr(p, CAST(s AS BIGINT) + 1, 1800)')} || chr(2)), '')
      WHEN {_OPEN} = '' THEN acc || p
      WHEN length({_OPEN}) + 2 + length(p) <= 1800 THEN acc || chr(10) || chr(10) || p
      ELSE acc || chr(2) || CASE WHEN {_TAIL} <> '' THEN {_TAIL} || chr(10) || chr(10) || p ELSE p END END) AS acc FROM p),
  u AS (SELECT doc_id, id, title, product, unnest(x) AS content, unnest(range(1, len(x) + 1)) AS chunk_index FROM (SELECT *, list_filter(string_split(acc, chr(2)), lambda x: x <> '') AS x FROM f)),
  c AS (SELECT * FROM u WHERE length({_STRIP.format('content')}) >= 40)"""


def _hashed(words: str, owner: str, dimensions: int = 256) -> str:
    """CTEs from a table {words}(owner, w) to {words}_v(owner, bucket, x)."""
    return f"""{words}_t AS (SELECT {owner}, unnest(w) AS t, 1.0::DOUBLE AS x FROM {words} UNION ALL SELECT {owner}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1.35::DOUBLE FROM {words}),
      {words}_h AS (SELECT t, {_FNV} % {dimensions} AS bucket FROM (SELECT DISTINCT t FROM {words}_t)),
      {words}_b AS (SELECT {owner}, bucket, sum(x) AS x FROM {words}_t JOIN {words}_h USING (t) GROUP BY {owner}, bucket),
      {words}_n AS (SELECT {owner}, sqrt(sum(x * x)) AS norm FROM {words}_b GROUP BY {owner}),
      {words}_v AS (SELECT {owner}, bucket, round(x / norm, 6) AS x FROM {words}_b JOIN {words}_n USING ({owner}))"""


_QUERIES = f"q AS (SELECT query_id, asked, qp, {_TOKENS.format('asked')} AS words, list_distinct({_TOKENS.format('asked')}) AS tokens FROM (SELECT doc_id AS query_id, text AS asked, {_PRODUCT.format('NULL')} AS qp FROM documents WHERE doc_id % 20 = 0))"
_OVERLAP = "CASE WHEN len(tokens) = 0 THEN 0.0 ELSE len(list_filter(tokens, lambda t: contains({0}, t)))::DOUBLE / sqrt(len(tokens) * greatest(len(tokens), 3)) END"
_FLAT = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
_ORDER = """(SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS st, o_orderpriority AS pr,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' THEN 1
       WHEN o_orderstatus = 'O' AND regexp_matches(o_orderpriority, '(?i)low|not') THEN 2
       WHEN o_orderstatus NOT IN ('F', 'O') THEN 3 END AS r FROM orders)"""

SQL = {
    "file_index_summary": "SELECT source, count(*) AS files, CAST(0 AS BIGINT) AS directories, CAST(0 AS BIGINT) AS symlinks, CAST(sum(n_chars) AS BIGINT) AS total_bytes, count(*) > 5000 AS truncated FROM documents GROUP BY source",
    "top_level_entries": "SELECT * FROM (SELECT lang, source AS entry, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY lang, source) WHERE place <= 20",
    "largest_files": "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 10",
    "directory_tree": "SELECT directory, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_bytes FROM (SELECT n, array_to_string(p[1:unnest(range(1, len(p)))], '/') AS directory FROM (SELECT length(html) AS n, list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)) GROUP BY directory",
    "bundle_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)",
    "bundle_duplicates": "SELECT doc_id, f AS first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents) WHERE doc_id > f",
    "log_lines": f"SELECT doc_id, line_no, sha256(line) AS line_sha256 FROM {_FULL}",
    "log_rule_matches": f"WITH l AS {_FULL}, m AS ({_MATCH}) SELECT doc_id, line_no, rule_id FROM m",
    "log_rule_findings": f"""WITH l AS {_FULL}, m AS ({_MATCH}), r(id, severity, category, title) AS (VALUES {_RULES}),
      k AS (SELECT *, row_number() OVER (PARTITION BY source, rule_id ORDER BY doc_id, line_no) AS k FROM m)
      SELECT source, id, any_value(severity) AS severity, any_value(category) AS category, any_value(title) AS title, count(*) AS count, min(doc_id) AS first_doc,
        string_agg(CASE WHEN k <= 4 THEN CASE WHEN length(trim(line, ' ')) > 220 THEN substr(trim(line, ' '), 1, 219) || '...' ELSE trim(line, ' ') END END, ' | ' ORDER BY k) AS evidence
      FROM k JOIN r ON r.id = k.rule_id GROUP BY source, id""",
    "line_search": "SELECT conv_id, min(turn) AS turn FROM conversations WHERE contains(lower(text), 'onth') GROUP BY conv_id",
    "line_window": f"WITH l AS {_FULL}, h AS (SELECT doc_id, min(line_no) AS hit FROM l WHERE regexp_matches(line, '[0-9]{{16}}') GROUP BY doc_id) SELECT doc_id, line_no, length(line) AS chars FROM (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS k FROM l JOIN h ON l.doc_id = h.doc_id AND l.line_no BETWEEN hit - 2 AND hit + 2) WHERE k <= 5",
    "condition_findings": f"""SELECT o_orderkey, 'order-' || k || CASE r WHEN 1 THEN '-urgent' WHEN 2 THEN '-late' ELSE '-any' END AS id,
      CASE WHEN r = 1 THEN CASE WHEN st = 'P' THEN 'critical' ELSE 'warning' END ELSE 'info' END AS severity,
      CASE r WHEN 1 THEN 'Order ' || k || ' is ' || pr WHEN 2 THEN 'Order ' || k || ' is open' ELSE k END AS title,
      CASE WHEN r = 1 THEN st || ' of ' || k ELSE '' END AS description,
      CASE r WHEN 1 THEN 'Status: ' || st || '; Priority: ' || pr WHEN 2 THEN 'Priority: ' || pr ELSE '' END AS evidence FROM {_ORDER} WHERE r IS NOT NULL""",
    "first_rule_wins": f"SELECT CASE WHEN r = 3 THEN 'Rest' ELSE 'Order' END AS category, CASE WHEN r = 1 THEN CASE WHEN st = 'P' THEN 'critical' ELSE 'warning' END ELSE 'info' END AS severity, count(*) AS n FROM {_ORDER} WHERE r IS NOT NULL GROUP BY 1, 2",
    "null_safe_predicate": "SELECT o_orderstatus, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey WHERE coalesce(trim(c_mktsegment), '') <> 'BUILDING' GROUP BY o_orderstatus",
    "alert_filter": "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type IN ('signup', 'purchase') THEN 'warning' ELSE 'info' END AS severity FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') <> '0'",
    "restart_rollup": "SELECT CASE WHEN m >= 5 THEN 'warning' ELSE 'info' END AS severity, count(*) AS pods, CAST(sum(m) AS BIGINT) AS restarts FROM (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) WHERE m > 0 GROUP BY 1",
    "event_warnings": "SELECT user_id, count(*) AS warnings, string_agg(CASE WHEN k <= 3 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') GROUP BY user_id",
    "node_health_rollup": "SELECT n_name, count(DISTINCT s_suppkey) AS total, count(DISTINCT CASE WHEN s_acctbal < 0 THEN s_suppkey END) AS problematic FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "version_pick": "SELECT p_brand, first(p_name ORDER BY p_size, p_partkey) AS component, first(p_type ORDER BY p_size, p_partkey) AS version, count(DISTINCT p_name || '|' || p_type) AS components FROM part GROUP BY p_brand",
    "chart_version_extract": "SELECT p_partkey, 'v' || regexp_extract(lower(p_brand) || '-' || p_size || '.' || (p_partkey % 7) || '.3-rc1', '-v?([0-9]+\\.[0-9]+\\.[0-9]+(-rc1)?)$', 1) AS version FROM part",
    "slug_truncate": "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '...' ELSE text END AS short FROM documents",
    "workload_full_outer": "SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, coalesce(n, 0) AS migrations, evidence FROM customer FULL OUTER JOIN (SELECT o_custkey, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey) o ON c_custkey = o_custkey",
    "mention_join": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "correlation_topk": "SELECT c_custkey, order_signals, event_signals, order_signals + event_signals AS signal_count, round(top_value, 4) AS top_value FROM customer JOIN (SELECT o_custkey, count(*) AS order_signals FROM orders GROUP BY 1) ON c_custkey = o_custkey JOIN (SELECT user_id, count(*) AS event_signals, max(value) AS top_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE event_type = 'error') WHERE k <= 3 GROUP BY 1) ON c_custkey = user_id",
    "severity_summary": f"SELECT event_type, count(*) AS total, count(*) FILTER (WHERE s = 'critical') AS critical, count(*) FILTER (WHERE s = 'warning') AS warning, count(*) FILTER (WHERE s = 'info') AS info FROM (SELECT event_type, {_SEVERITY} AS s FROM events) GROUP BY event_type",
    "highest_severity": f"SELECT user_id, CASE min({_RANK}) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM events GROUP BY user_id",
    "finding_dedup": f"SELECT user_id, event_type, event_id, severity FROM (SELECT *, {_SEVERITY} AS severity, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "finding_groups": f"WITH m(event_type, group_id) AS (VALUES ('click', 'interaction'), ('view', 'interaction'), ('signup', 'accounts'), ('purchase', 'accounts'), ('purchase', 'revenue'), ('error', 'health')) SELECT user_id, group_id, count(*) AS findings, CASE min({_RANK}) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM events JOIN m USING (event_type) GROUP BY user_id, group_id",
    "merge_evidence": """WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seq FROM events GROUP BY 1, 2),
      x AS (SELECT user_id, seq, 0 AS p, event_type || ': ' || n || ' matches' AS t FROM e WHERE n > 1 UNION ALL SELECT user_id, seq, 1, CASE WHEN event_type = 'view' THEN event_type || ': /' || event_type ELSE 'first ' || seq END FROM e),
      k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq, p) AS k FROM x) SELECT user_id, string_agg(t, '; ' ORDER BY k) AS evidence FROM k WHERE k <= 8 GROUP BY user_id""",
    "ungrouped_findings": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "latest_job": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "retention": "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS retention_until FROM orders",
    "kb_html_text": f"SELECT url AS source_uri, title, sha256(body) AS body_sha256, length(body) AS chars FROM (SELECT url, {_TITLE} AS title, {_BODY} AS body FROM pages)",
    "kb_links": """SELECT DISTINCT url, link FROM (SELECT url, origin, path, origin || split_part(split_part(h, '?', 1), '#', 1) AS link, split_part(split_part(h, '?', 1), '#', 1) AS p
      FROM (SELECT url, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href="([^"]+)"', 1)) AS h FROM pages) WHERE h LIKE '/%')
      WHERE p <> path AND NOT regexp_matches(p, '(?i)\\.(css|js|mjs|map|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|eot|zip|tar|gz|tgz|pdf)$')""",
    "kb_quality": "SELECT status, count(*) AS n, count(*) FILTER (WHERE status <> 'blocked') AS importable FROM (SELECT CASE WHEN length(trim(text, ' ')) < 120 THEN 'blocked' WHEN length(trim(text, ' ')) < 500 THEN 'warning' ELSE 'ready' END AS status FROM documents) GROUP BY status",
    "kb_product": f"SELECT doc_id, CASE WHEN contains(lower(text), '{PRODUCTS[0]}') THEN '{PRODUCTS[0]}' WHEN contains(lower(text), '{PRODUCTS[1]}') THEN '{PRODUCTS[1]}' ELSE 'unknown' END AS product FROM documents",
    "kb_chunks_fixed": "SELECT doc_id, chunk, sha256(trim(substr(text, 1 + chunk * 1620, 1800), ' ')) AS content_sha256 FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 1800) / 1620.0)) AS BIGINT))) AS chunk FROM documents)",
    "kb_tokens": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token",
    "kb_chunks": f"WITH {_CHUNKS} SELECT id AS document_id, chunk_index, length(content) AS char_count, sha256(content) AS content_sha256 FROM c",
    "kb_hash_embedding": f"WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), {_hashed('w', 'doc_id')} SELECT doc_id, bucket, x FROM w_v WHERE x <> 0",
    "cosine_topk": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM
      (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)) WHERE place <= 10""",
    "keyword_overlap": f"WITH {_QUERIES}, s AS (SELECT query_id, doc_id, round({_OVERLAP.format('lower(text)')}, 6) AS score FROM q, documents) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 10",
    "hybrid_search": f"""WITH {_CHUNKS}, {_QUERIES},
      k AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_index) AS cid, *, lower(title || chr(10) || content) AS search FROM c),
      cw AS (SELECT cid, {_TOKENS.format('title || chr(10) || content')} AS w FROM k), {_hashed('cw', 'cid')},
      qw AS (SELECT query_id, {_TOKENS.format('asked')} AS w FROM q), {_hashed('qw', 'query_id')},
      cn AS (SELECT cid, sqrt(sum(x * x)) AS n FROM cw_v GROUP BY cid), qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qw_v GROUP BY query_id),
      dot AS (SELECT query_id, cid, sum(a.x * b.x) AS x FROM qw_v a JOIN cw_v b USING (bucket) GROUP BY query_id, cid),
      s AS (SELECT q.query_id, q.tokens, q.words, k.*, 0.72 * coalesce(dot.x / (cn.n * qn.n), 0) + 0.28 * {_OVERLAP.format('search')} AS raw
            FROM q JOIN k ON qp IS NULL OR product = 'unknown' OR product = qp LEFT JOIN dot ON dot.query_id = q.query_id AND dot.cid = k.cid LEFT JOIN cn ON cn.cid = k.cid LEFT JOIN qn ON qn.query_id = q.query_id),
      b AS (SELECT *, round(raw, 3) AS score FROM s WHERE raw >= 0.07 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(raw, 3) DESC, chunk_index) = 1),
      e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) AS place, {_FLAT} AS t FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) <= 5),
      x AS (SELECT *, coalesce(greatest(instr(lower(t), list_filter(words, lambda w: contains(lower(t), w))[1]) - 91, 0), 0) AS start FROM e)
      SELECT query_id, place, id, score, CASE WHEN start > 0 THEN '...' ELSE '' END || substr(t, start + 1, 260) || CASE WHEN start + length(substr(t, start + 1, 260)) < length(t) THEN '...' ELSE '' END AS excerpt, chunk_index FROM x""",
    "kb_upsert": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, 's' || (doc_id % 701) AS source_uri, text, doc_id AS seq FROM documents), n AS (SELECT * FROM d WHERE seq % 3 = 0 AND trim(text) <> '')
      SELECT id, source_uri, length(text) AS chars FROM d WHERE seq % 3 <> 0 AND source_uri NOT IN (SELECT source_uri FROM n) UNION ALL SELECT id, source_uri, length(text) FROM n""",
    "kb_delete": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "context_fingerprint": """SELECT doc_id, sha256('{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint FROM documents""",
    "stream_intake": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)",
}
