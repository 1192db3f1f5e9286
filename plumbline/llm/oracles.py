"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from plumbline.llm import chat

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM doc_words, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item FROM doc_windows JOIN windows USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) t(j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc_words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT b, r FROM reached JOIN both_ways ON id = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reached GROUP BY id) USING (doc_id)
"""


def _escaped(value: str) -> str:
    for pattern in (chat.CONTROLS, chat.BRACKETS):
        value = f"regexp_replace({value}, '{pattern.format(m=chat.MARK)}', '\\1{chat.MARK}\\2\\3', 'g')"
    return value


OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         string_agg('{chat.TURN}' || {_escaped("role")} || '{chat.TEXT}' || {_escaped("text")} || '{chat.END}', '' ORDER BY turn, role, text) AS formatted
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(length(formatted) AS BIGINT) AS formatted_chars
FROM whole
"""

#: A number below 2**32 from a string, the same in both engines.
_NUMBER = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

OP3 = f"""
WITH captures AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 7919) % 8760 AS INTEGER)) AS fetched_at FROM pages),
hosts AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE {_HOST} <> ''),
named AS (
  SELECT 'block' AS list, 'host' AS kind, host AS value FROM hosts WHERE {_NUMBER.format("'h' || host")} % 3 = 0
  UNION SELECT 'block', 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) FROM hosts WHERE regexp_matches(host, '[.]') AND {_NUMBER.format("'d' || regexp_extract(host, '([^.]+[.][^.]+)$', 1)")} % 5 = 0
  UNION SELECT 'allow', 'prefix', host || '/en' FROM hosts WHERE {_NUMBER.format("'p' || host")} % 2 = 0),
numbered AS (SELECT *, {_NUMBER.format("list || kind || value")} AS k FROM named),
events AS (
  SELECT list, kind, value, 'add' AS action, TIMESTAMP '2023-12-01' + to_days(CAST(k % 300 AS INTEGER)) AS moment FROM numbered
  UNION ALL SELECT list, kind, value, 'remove', TIMESTAMP '2023-12-01' + to_days(CAST(k % 300 + 20 + k % 97 AS INTEGER)) FROM numbered WHERE k % 4 <> 0
  UNION ALL SELECT list, kind, value, 'add', TIMESTAMP '2023-12-01' + to_days(CAST(k % 300 + 150 AS INTEGER)) FROM numbered WHERE k % 8 = 1),
parsed AS (SELECT *, {_HOST} AS host, string_split({_HOST}, '.') AS labels, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS steps FROM captures),
keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS value FROM parsed WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(labels[i:], '.') FROM parsed, unnest(range(1, len(labels))) t(i) WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(steps[1:i], '/') FROM parsed, unnest(range(1, len(steps) + 1)) t(i) WHERE host <> ''),
latest AS (
  SELECT page_id, list, kind, value, arg_max(action, CAST(moment AS VARCHAR) || action) AS action
  FROM keys JOIN events USING (kind, value) WHERE moment <= fetched_at GROUP BY ALL),
ranked AS (
  SELECT page_id, list, list || ':' || kind || ':' || value AS name, count(*) OVER (PARTITION BY page_id) AS n,
         row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, length(value) DESC, list, list || ':' || kind || ':' || value DESC) AS r
  FROM latest WHERE action = 'add')
SELECT page_id, url, fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, name AS matched, coalesce(list = 'block', false) AS blocked
FROM captures LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (page_id)
"""

OP11 = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT d.doc_id, part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
counts AS (SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) t(step)),
each AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS failed, fails = x AS alone,
         len(list_filter(string_split(earlier, ''), lambda c: c <> '' AND contains(fails, c))) > 0 AS gone
  FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failed), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failed), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failed AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND failed AND toxic), 0) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM summed
"""


def _round(k: int) -> str:
    """Round k of the clustering: the nearest centroid of every vector, then the floor of each cluster's mean."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT r, arg_min(j, [d, j]) AS j, min(d) AS d FROM (
    SELECT r, j, sum((v - c) * (v - c)) AS d FROM vectors JOIN c{k} USING (i) GROUP BY r, j) GROUP BY r),
sums{k} AS MATERIALIZED (SELECT j, i, sum(v) AS s, count(*) AS n FROM vectors JOIN near{k} USING (r) GROUP BY j, i),
c{k + 1} AS MATERIALIZED (
  SELECT j, i, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n + n) % n)) / n AS BIGINT) END AS c FROM c{k} LEFT JOIN sums{k} USING (j, i))"""


OP13 = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
vectors AS MATERIALIZED (SELECT r, i, v[i] AS v FROM kept, range(1, 65) t(i)),
first_rows AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS j FROM kept QUALIFY j < 8),
c0 AS MATERIALIZED (SELECT j, i, v AS c FROM vectors JOIN first_rows USING (r)),{",".join(_round(k) for k in range(11))},
digests AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near10 JOIN kept USING (r) JOIN digests USING (j)
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op2_jaccard_join": OP2,
    "op3_url_lists": OP3,
    "op7_chat": OP7,
    "op11_filter_audit": OP11,
    "op13_centroids": OP13,
}
