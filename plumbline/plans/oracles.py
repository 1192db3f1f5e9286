"""DuckDB SQL with the same results as ``plans.queries``, on views of the same tables."""

from __future__ import annotations

from plumbline.functions import text as X
from plumbline.plans.queries import IDS, LISTED, REPLIES, SPEC_FILES
from plumbline.schemas import CATEGORIES

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_MODALS = ", ".join(f"'{w}'" for w in X.MODALS)


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + f") v({columns})"


def _tokens(text: str) -> str:
    """Camel-case borders become spaces, as there is no look-ahead."""
    split = f"regexp_replace(regexp_replace({text}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    parts = f"list_transform(regexp_extract_all({split}, '[A-Za-z]+|[0-9]+(?:[.][0-9]+)?'), lambda t: lower(t))"
    return f"list_filter({parts}, lambda t: regexp_matches(t, '^[0-9]') OR (length(t) > 1 AND t NOT IN ({_STOP})))"


def _ratio(a: str, b: str, decimals: int = 4) -> str:
    return f"round_even(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), {decimals})"


def _cases() -> str:
    return """cases AS (
  SELECT 'c' || doc_id AS case_id, source AS project, CASE WHEN toxic = 1 THEN 'D' || (1 + doc_id % 9) ELSE 'N' || (1 + doc_id % 3) END AS category,
         CASE WHEN toxic = 1 THEN 'drift' ELSE 'no_drift' END AS label, CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['R' || doc_id % 5, 'R' || doc_id % 7] END AS targets,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'f' || doc_id % 6 END AS gold, 'm' || doc_id % 4 || '.py' AS base, 'note ' || doc_id % 10 AS note,
         CASE WHEN doc_id % 11 = 0 THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS escapes, doc_id AS i
  FROM documents JOIN labels USING (doc_id))"""


def _verdicts(run: str = "1", name: str = "verdicts") -> str:
    return f"""{name} AS (
  SELECT 'c' || doc_id AS case_id, {run} AS run, 'R' || (doc_id * 3 + k) % 7 AS rule_id, CASE WHEN k = 3 THEN 'reverse' ELSE 'forward' END AS direction,
         CASE WHEN (doc_id * 7 + k * 5 + ({run} - 1) * (doc_id % 3)) % 6 <= 1 THEN 'DRIFT' WHEN (doc_id * 7 + k * 5 + ({run} - 1) * (doc_id % 3)) % 6 = 2 THEN 'UNCERTAIN' ELSE 'COMPLIANT' END AS verdict,
         ((doc_id + k) % 10) / 10 AS confidence, CASE WHEN (doc_id + k) % 5 = 0 THEN '' ELSE 'm' || (doc_id + k) % 4 || '.py' END AS cited,
         CASE WHEN k % 2 = 0 THEN ['f' || (doc_id + k) % 6, 'g'] ELSE [] END AS shown, k
  FROM labels, unnest(range(0, 4)) t(k) WHERE doc_id % 13 <> 0)"""


_SCORED = """scored AS (
  WITH joined AS (
    SELECT c.*, v.*  EXCLUDE (case_id), coalesce(v.verdict = 'DRIFT', false) AS flag, coalesce(list_contains(targets, rule_id), false) AS target,
           category LIKE 'D8' AND coalesce(direction = 'reverse', false) AS back, coalesce(len(shown) > 0, false) AS has, coalesce(list_contains(shown, gold) AND gold <> '', false) AS saw
    FROM cases c LEFT JOIN verdicts v USING (case_id) WHERE status = 'valid'),
  placed AS (SELECT *, CASE WHEN has AND gold <> '' THEN saw WHEN coalesce(cited, '') <> '' THEN base = cited ELSE true END AS here FROM joined),
  rated AS (SELECT *, label = 'drift' AND flag AND CASE WHEN len(targets) > 0 THEN target ELSE here END AS hit, label = 'drift' AND flag AND len(targets) > 0 AND NOT target AND back AND here AS more,
            len(targets) = 0 OR target OR back AS relevant FROM placed),
  summed AS (
    SELECT case_id, run, any_value(project) AS project, any_value(category) AS category, any_value(label) AS label, any_value(gold) AS gold,
           bool_or(hit OR more) AS caught, bool_or(flag) AS flagged, bool_or(relevant AND has) AS shown_any, bool_or(relevant AND saw) AS saw_any,
           coalesce(list(rule_id ORDER BY more, k) FILTER (hit OR more), []) AS on_rules, coalesce(list(rule_id ORDER BY k) FILTER (flag), []) AS flag_rules,
           coalesce(list(rule_id ORDER BY k) FILTER (flag AND NOT hit AND NOT more), []) AS off_rules, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain,
           coalesce(max(confidence) FILTER (hit OR more), 0) AS on_confidence, coalesce(max(confidence) FILTER (flag), 0) AS flag_confidence
    FROM rated GROUP BY case_id, run)
  SELECT case_id, coalesce(run, 1) AS run, project, category, label, CASE WHEN label = 'drift' THEN CASE WHEN caught THEN 'TP' ELSE 'FN' END WHEN flagged THEN 'FP' ELSE 'TN' END AS outcome,
         CASE WHEN label = 'drift' THEN on_rules ELSE flag_rules END AS flagged_rules, CASE WHEN label = 'drift' THEN off_rules ELSE [] END AS spurious_rules,
         CASE WHEN label = 'drift' AND NOT caught THEN CASE WHEN NOT shown_any THEN 'n/a' WHEN gold = '' THEN 'reasoning' WHEN saw_any THEN 'reasoning' ELSE 'retrieval' END ELSE '' END AS attribution,
         CAST(uncertain AS BIGINT) AS uncertain, CAST(CASE WHEN label = 'drift' THEN on_confidence ELSE flag_confidence END AS DOUBLE) AS confidence
  FROM summed)"""
_BASE = f"WITH {_cases()}, {_verdicts()}, {_SCORED}"
_TALLY = ", ".join(f"CAST(count(*) FILTER (outcome = '{k}') AS BIGINT) AS {k.lower()}" for k in ("TP", "FN", "FP", "TN"))
_DIMENSION = "dimension AS (SELECT * FROM " + _values([(c, k, n, 1 if x else 0) for k, (c, n, x) in enumerate(CATEGORIES)], "category, ord, name, is_drift") + ")"
_CATEGORY = f"""counted AS (SELECT category, run, count(*) AS n, CAST(sum(uncertain) AS BIGINT) AS uncertain, {_TALLY} FROM scored GROUP BY category, run),
categories AS (
  SELECT category, run, CAST(ord AS BIGINT) AS ord, name, CAST(n AS BIGINT) AS n, CASE WHEN is_drift = 1 THEN 'recall' ELSE 'false_alarm_rate' END AS metric,
         CASE WHEN is_drift = 1 THEN {_ratio("tp", "tp + fn")} ELSE {_ratio("fp", "fp + tn")} END AS value, uncertain
  FROM counted JOIN dimension USING (category))"""
_RATES = f"""{_ratio("tp", "tp + fp")} AS precision, {_ratio("tp", "tp + fn")} AS recall, {_ratio("fp", "fp + tn")} AS false_alarm_rate"""
_F1 = _ratio("2 * precision * recall", "precision + recall")
#: All three runs, a case without verdicts being in each.
_RUNS = f"""WITH {_cases()}, {_verdicts("r", "verdicts").replace("FROM labels,", "FROM labels, unnest([1, 2, 3]) u(r),")}, {_SCORED.replace("FROM cases c LEFT JOIN verdicts v USING (case_id)", "FROM (SELECT cases.*, wanted FROM cases, unnest([1, 2, 3]) w(wanted)) c LEFT JOIN verdicts v ON v.case_id = c.case_id AND v.run = wanted").replace("SELECT c.*, v.*  EXCLUDE (case_id)", "SELECT c.* EXCLUDE (wanted), v.* EXCLUDE (case_id, run), wanted AS run")}"""
_EVENTS = "said AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'DRIFT' WHEN event_type = 'click' THEN 'UNCERTAIN' ELSE 'COMPLIANT' END AS verdict FROM events)"


def _vectors(k: int, decimals: int = 4) -> str:
    return f"""docs AS (SELECT 'r' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'c', doc_id, text FROM documents),
terms AS (SELECT side, id, token, count(*) AS n FROM (SELECT side, id, unnest({_tokens("text")}) AS token FROM docs) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM terms GROUP BY token),
raw AS (SELECT side, id, token, (1 + ln(n)) * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1) AS w FROM terms JOIN df USING (token)),
unit AS (SELECT side, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM raw),
scores AS (
  SELECT r.id AS rule_id, c.id AS chunk_id, round_even(sum(r.w * c.w), 6) AS score FROM unit r JOIN unit c ON r.side = 'r' AND c.side = 'c' AND r.token = c.token GROUP BY ALL),
every AS (SELECT item_id AS rule_id, doc_id AS chunk_id, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN scores ON rule_id = item_id AND chunk_id = doc_id),
hits AS (SELECT rule_id, chunk_id, score, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, chunk_id) AS rank FROM every QUALIFY rank <= {k})"""


def _reply(field: str) -> str:
    return f"json_extract_string(j, '$.{field}')"


def _patterned(rows, columns: str) -> str:
    """Documents with the pattern of their number."""
    return f"documents JOIN {_values([(n, *r) for n, r in enumerate(rows)], 'n, ' + columns)} ON n = doc_id % {len(rows)}"


_REPLIES = f"""given AS (
  SELECT doc_id + 1 AS k, coalesce(replace(pattern, '"c"', '"' || md5(text) || '"'), '') AS reply FROM {_patterned([r[1:] for r in REPLIES], "rule_id, pattern")}),
bare AS (SELECT k, trim(regexp_replace(reply, '(?m)^\\s*```(?:json)?\\s*|\\s*```\\s*$', '', 'g')) AS b FROM given),
found AS (SELECT k, CASE WHEN json_valid(b) THEN b WHEN json_valid(regexp_extract(b, '(?s)\\{{.*\\}}', 0)) THEN regexp_extract(b, '(?s)\\{{.*\\}}', 0) END AS f FROM bare),
parsed AS (SELECT k, CASE WHEN f IS NOT NULL AND json_type(CAST(f AS JSON)) = 'OBJECT' THEN CAST(f AS JSON) END AS j FROM found)"""
_SAID = f"CASE WHEN upper(trim(coalesce({_reply('verdict')}, ''))) IN ('COMPLIANT', 'DRIFT', 'UNCERTAIN') THEN upper(trim({_reply('verdict')})) ELSE 'UNCERTAIN' END"


def _clamp(value: str) -> str:
    return f"CASE WHEN TRY_CAST({value} AS DOUBLE) IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, TRY_CAST({value} AS DOUBLE))) END"


def _line(value: str) -> str:
    return f"CAST(CASE WHEN TRY_CAST({value} AS DOUBLE) IS NOT NULL THEN greatest(0, trunc(TRY_CAST({value} AS DOUBLE))) ELSE coalesce(TRY_CAST(regexp_extract(coalesce({value}, ''), '[0-9]+', 0) AS BIGINT), 0) END AS BIGINT)"


def _strip(value: str) -> str:
    ids = r"R[0-9][0-9](?:\s*(?:/|,\s*and|,|and|to)\s*R[0-9][0-9])*"
    steps = [
        (rf"(?m)[ \t]+#\s*{ids}[ \t]*$", ""), (rf"(?m)\s*Enforces\s+{ids}(?:\s+on\s+[^.\n]*)?\.", ""), (rf"{ids}\s+[-–—]\s+", ""), (rf"\s+from\s+{ids}", ""), (rf"\b{ids}\b", ""),
        ('""" +', '"""'), (r"(?m)^[ \t]*#[ \t]*$", ""), (r"\n{3,}", "\n\n"),
    ]
    for pattern, new in steps:
        value = f"regexp_replace({value}, {_q(pattern)}, {_q(new)}, 'g')"
    return value


def _judged(rule: str, code: str, source: str) -> str:
    """CTEs that end in ``judged``: all columns of ``source`` with verdict, confidence and reason."""
    numbers = r"list_transform(regexp_extract_all({0}, '\b([0-9]+(?:\.[0-9]+)?)\b', 1), lambda x: CAST(x AS DOUBLE))"
    return rf"""cut AS (SELECT *, CASE WHEN contains({code}, '|') THEN array_to_string(list_transform(list_filter(string_split({code}, chr(10)), lambda x: contains(x, '|')), lambda x: regexp_replace(x, '^[^|]*\|', '')), chr(10)) ELSE {code} END AS bare FROM {source}),
        plain AS (SELECT *, regexp_replace(regexp_replace(bare, '#[^\n]*', '', 'g'), '(?s)""" + '"""' + r""".*?""" + '"""' + rf"""', '', 'g') AS p FROM cut),
        sets AS (SELECT *, list_filter({numbers.format(rule)}, lambda x: x NOT IN (0, 1, 2)) AS wanted, {numbers.format('p')} AS there, regexp_extract_all({rule}, '`([A-Z][A-Za-z]+)`', 1) AS named, contains(p, 'raise ') AS raises FROM plain),
        gaps AS (SELECT *, CASE WHEN len(there) > 0 THEN list_filter(wanted, lambda x: NOT list_contains(there, x)) ELSE [] END AS missing,
                 CASE WHEN raises THEN list_filter(named, lambda x: NOT contains(p, 'raise ' || x)) ELSE [] END AS unraised FROM sets),
        judged AS (SELECT *, CASE WHEN len(missing) > 0 OR len(unraised) > 0 THEN 'DRIFT' WHEN (len(wanted) > 0 AND len(there) = 0) OR (len(named) > 0 AND NOT raises) THEN 'UNCERTAIN' ELSE 'COMPLIANT' END AS verdict,
                 CAST(CASE WHEN len(missing) > 0 THEN 0.72 WHEN len(unraised) > 0 THEN 0.68 WHEN (len(wanted) > 0 AND len(there) = 0) OR (len(named) > 0 AND NOT raises) THEN 0.3 ELSE 0.6 END AS DOUBLE) AS confidence FROM gaps)"""


_WORKSPACES = r"""chunks AS (SELECT 'w' || doc_id // 20 AS workspace, doc_id // 20 AS num, 'd' || doc_id AS chunk_id, source || '.py' AS file,
        CASE WHEN doc_id % 7 = 0 THEN '<module>' ELSE 'Box._' || regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z]+', '_', 'g') END AS qualname, doc_id % 7 = 0 AS module,
        text || chr(10) || 'LIMIT_' || doc_id % 5 || CASE WHEN doc_id % 7 = 0 THEN ' = 1' ELSE ' used' END || chr(10) || 'limit = ' || doc_id % 13 || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'raise LimitError' || chr(10) ELSE chr(10) END AS s FROM documents),
    rules AS (SELECT workspace, 'R' || item_id AS rule_id, text || ' at least ' || (item_id % 9 + 3) || CASE WHEN item_id % 3 = 0 THEN ' or raise `LimitError`' ELSE '' END AS rule
        FROM (SELECT DISTINCT workspace, num FROM chunks) JOIN benchmark ON item_id % 40 = num % 40)"""
_RANKED = rf"""docs AS (SELECT workspace, 'r' AS side, rule_id AS id, rule AS text FROM rules UNION ALL SELECT workspace, 'c', chunk_id, regexp_replace(file, '[/.]', ' ', 'g') || ' ' || qualname || ' ' || s FROM chunks),
    totals AS (SELECT workspace, count(*) AS total FROM docs GROUP BY 1),
    terms AS (SELECT workspace, side, id, token, count(*) AS n FROM (SELECT workspace, side, id, unnest({_tokens('text')}) AS token FROM docs) GROUP BY ALL),
    df AS (SELECT workspace, token, count(*) AS df FROM terms GROUP BY ALL),
    raw AS (SELECT workspace, side, id, token, (1 + ln(n)) * (ln((total + 1) / (df + 1)) + 1) AS w FROM terms JOIN df USING (workspace, token) JOIN totals USING (workspace)),
    unit AS (SELECT workspace, side, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY workspace, side, id)) AS w FROM raw),
    scores AS (SELECT workspace, r.id AS rule_id, c.id AS chunk_id, round_even(sum(r.w * c.w), 6) AS score FROM unit r JOIN unit c USING (workspace, token) WHERE r.side = 'r' AND c.side = 'c' GROUP BY ALL),
    every AS (SELECT workspace, rule_id, chunk_id, coalesce(score, 0.0) AS score FROM rules JOIN chunks USING (workspace) LEFT JOIN scores USING (workspace, rule_id, chunk_id)),
    hits AS (SELECT workspace, rule_id, chunk_id, row_number() OVER (PARTITION BY workspace, rule_id ORDER BY score DESC, chunk_id) AS rank FROM every QUALIFY rank <= 3),
    named AS (SELECT DISTINCT workspace, rule_id, rank, file, unnest(regexp_extract_all(s, '\b[A-Z][A-Z0-9_]{{2,}}\b')) AS c FROM hits JOIN chunks USING (workspace, chunk_id)),
    defined AS (SELECT DISTINCT workspace, chunk_id, file, unnest(regexp_extract_all(s, '(?m)^([A-Z][A-Z0-9_]{{2,}})\s*[:=]', 1)) AS c FROM chunks WHERE module),
    met AS (SELECT workspace, rule_id, d.chunk_id, min(rank) AS rank FROM named JOIN defined d USING (workspace, file, c) GROUP BY ALL),
    context AS (SELECT * FROM met ANTI JOIN hits USING (workspace, rule_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY workspace, rule_id ORDER BY rank, chunk_id) <= 2),
    shown AS (SELECT workspace, rule_id, rank, chunk_id FROM hits UNION ALL SELECT workspace, rule_id, rank + 3, chunk_id FROM context),
    asked AS (SELECT workspace, rule_id, rule, string_agg(s, chr(10) ORDER BY rank, chunk_id) AS code, string_agg(chunk_id, ',' ORDER BY rank, chunk_id) AS chunks
        FROM shown JOIN chunks USING (workspace, chunk_id) JOIN rules USING (workspace, rule_id) GROUP BY ALL)"""
_AUDITED = r"""spec AS (SELECT workspace, string_agg(rule, chr(10) ORDER BY rule_id) AS spec FROM rules GROUP BY 1),
    heads AS (SELECT workspace, chunk_id, qualname, lower(spec) AS spec, coalesce(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '^\s*(async )?def '))[1], string_split(s, chr(10))[1]) AS quote
        FROM chunks JOIN spec USING (workspace) WHERE NOT module AND NOT regexp_matches(regexp_extract(qualname, '[^.]*$', 0), '^__')),
    parts AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(qualname, '[^.]*$', 0), '^_+', '')), '_+'), lambda w: length(w) > 3) AS words FROM heads),
    raws AS (SELECT *, len(words) > 0 AND len(list_filter(words, lambda w: contains(spec, left(w, 5)))) = 0 AS found, trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AS quoted FROM parts),
    audited AS (SELECT workspace, 'CREEP:' || qualname AS rule_id, CASE WHEN NOT found THEN 'COMPLIANT' WHEN quoted THEN 'DRIFT' ELSE 'UNCERTAIN' END AS verdict, CAST(0.6 AS DOUBLE) AS confidence,
        CASE WHEN found AND quoted THEN 'No rule authorises: it has ' || qualname ELSE '' END AS violated_clause, found AND NOT quoted AS downgraded, chunk_id AS chunks FROM raws)"""
_GOLD = "gold AS (SELECT item_id AS rule_id, min(doc_id) AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id), ranked AS (SELECT gold.rule_id, min(rank) AS rank FROM gold LEFT JOIN hits USING (rule_id, chunk_id) GROUP BY 1)"
_CLAUSE = "CASE WHEN verdict = 'DRIFT' THEN trim(rule) ELSE '' END AS violated_clause"

_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_KEY = "sha256(CASE WHEN doc_id % 2 = 0 THEN 'v1' || chr(0) || text ELSE 'v1' || chr(0) || text || chr(0) || 'run=2' END)"

ORACLES: dict[str, str] = {
    "q01_tokens": f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token",
    "q02_doc_frequency": f"""WITH docs AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark),
        terms AS (SELECT unnest(list_distinct({_tokens('text')})) AS token FROM docs)
        SELECT token, CAST(count(*) AS BIGINT) AS df, round_even(ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) + 1, 4) AS idf FROM terms GROUP BY token""",
    "q03_keyword_verdicts": f"""WITH held AS (SELECT DISTINCT source AS project, unnest({_tokens('text')}) AS token FROM documents),
        asked AS (SELECT item_id AS rule_id, project, {_tokens('text')} AS t FROM benchmark, (SELECT DISTINCT project FROM held)),
        one AS (SELECT rule_id, project, u.token, regexp_matches(u.token, '^[0-9]') AS number, h.token IS NOT NULL AS has
                FROM (SELECT rule_id, project, unnest(t) AS token FROM asked) u LEFT JOIN held h USING (project, token)),
        summed AS (SELECT rule_id, project, count(*) FILTER (NOT number AND token NOT IN ({_MODALS})) AS words, count(*) FILTER (NOT number AND has AND token NOT IN ({_MODALS})) AS met,
                          count(DISTINCT token) FILTER (number AND NOT has) AS missing FROM one GROUP BY ALL),
        rated AS (SELECT rule_id, project, coalesce(CASE WHEN words > 0 THEN met / words END, 1.0) AS c, coalesce(missing, 0) AS missing FROM asked LEFT JOIN summed USING (rule_id, project))
        SELECT project, rule_id, round_even(c, 4) AS coverage, CAST(missing AS BIGINT) AS n_missing, CASE WHEN c >= 0.6 AND missing = 0 THEN 'COMPLIANT' ELSE 'DRIFT' END AS verdict,
               round_even(CASE WHEN c >= 0.6 AND missing = 0 THEN c ELSE 1 - c END, 3) AS confidence FROM rated""",
    "q04_tfidf_topk": f"WITH {_vectors(3)} SELECT rule_id, CAST(rank AS BIGINT) AS rank, chunk_id, round_even(score, 4) AS score FROM hits",
    "q05_recall_at_k": f"""WITH {_vectors(5)}, gold AS (SELECT item_id AS rule_id, min(doc_id) AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
        ranked AS (SELECT gold.rule_id, min(rank) AS rank FROM gold LEFT JOIN hits USING (rule_id, chunk_id) GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f"round_even(coalesce(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 0), 4) AS r{k}" for k in (1, 3, 5))} FROM ranked""",
    "q06_hash_bucket_norm": f"""WITH terms AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL),
        added AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 2048 AS b, sum(1 + ln(n)) AS w FROM terms GROUP BY ALL),
        unit AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM added)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_buckets, round_even(sum(w * w), 4) AS norm, round_even(max(w), 4) AS w_max, round_even(sum(w), 3) AS w_sum FROM unit GROUP BY doc_id""",
    "q07_outcomes": f"{_BASE} SELECT * EXCLUDE (run) FROM scored",
    "q08_overall_metrics": f"""{_BASE}, c AS (SELECT CAST(count(*) AS BIGINT) AS cases, CAST(sum(len(spurious_rules)) AS BIGINT) AS spurious_rule_flags, {_TALLY}, sum(uncertain) AS u FROM scored),
        r AS (SELECT *, {_RATES} FROM c)
        SELECT cases, spurious_rule_flags, tp, fn, fp, tn, precision, recall, false_alarm_rate, {_F1} AS f1, {_ratio('tp', 'tp + fp + spurious_rule_flags')} AS strict_precision,
               {_ratio('u', '(SELECT count(*) FROM verdicts)')} AS uncertain_rate FROM r""",
    "q09_per_category": f"{_BASE}, {_DIMENSION}, {_CATEGORY} SELECT * EXCLUDE (run) FROM categories",
    "q10_attribution": f"{_BASE} SELECT attribution, CAST(count(*) AS BIGINT) AS n FROM scored WHERE outcome = 'FN' AND attribution <> '' GROUP BY 1",
    "q11_strict_precision": f"""{_BASE}, c AS (SELECT project, CAST(sum(len(spurious_rules)) AS BIGINT) AS spurious_rule_flags, {_TALLY} FROM scored GROUP BY project)
        SELECT project, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fp + spurious_rule_flags')} AS strict_precision, spurious_rule_flags FROM c""",
    "q12_summary_groupings": f"""WITH {_cases()} SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS level, category, project,
        CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status = 'valid') AS BIGINT) AS valid, CAST(count(*) FILTER (status = 'valid' AND coalesce(escapes, false)) AS BIGINT) AS escaped
        FROM cases GROUP BY GROUPING SETS ((category), (project), ())""",
    "q13_comparison_pivot": f"""{_RUNS}, {_DIMENSION}, {_CATEGORY} SELECT category, {', '.join(f"max(value) FILTER (run = {r}) AS run{r}" for r in (1, 2, 3))} FROM categories GROUP BY category""",
    "q14_collapsed_verdict": f"WITH {_EVENTS} SELECT user_id, CASE WHEN bool_or(verdict = 'DRIFT') THEN 'DRIFT' ELSE arg_min(verdict, event_id) END AS verdict FROM said GROUP BY user_id",
    "q15_live_status": f"""WITH {_EVENTS}, c AS (SELECT user_id, {', '.join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS {v.lower()}" for v in ('COMPLIANT', 'DRIFT', 'UNCERTAIN'))} FROM said GROUP BY user_id)
        SELECT *, CASE WHEN drift > 0 THEN 'DRIFT' WHEN uncertain > 0 THEN 'NEEDS_HUMAN' ELSE 'PASS' END AS status FROM c""",
    "q16_run_rates_std": f"""{_RUNS}, c AS (SELECT run, {_TALLY} FROM scored GROUP BY run), r AS (SELECT *, {_RATES} FROM c), f AS (SELECT *, {_F1} AS f1 FROM r)
        SELECT CAST(count(*) AS BIGINT) AS runs, {', '.join(f"round_even(stddev_pop({m}), 4) AS {m}_std" for m in ('precision', 'recall', 'f1', 'false_alarm_rate'))} FROM f""",
    "q17_flip_rate": f"""{_RUNS}, k AS (SELECT case_id, count(DISTINCT outcome) AS kinds FROM scored GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS cases, {_ratio('count(*) FILTER (kinds > 1)', 'count(*)')} AS flip_rate FROM k""",
    "q18_nearest_rank_ci": """WITH l AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)
        SELECT lang, v[greatest(1, CAST(round_even(0.025 * (len(v) - 1), 0) AS INTEGER) + 1)] AS lo, v[greatest(1, CAST(round_even(0.975 * (len(v) - 1), 0) AS INTEGER) + 1)] AS hi FROM l""",
    "q19_bootstrap_hash": f"""{_BASE}, numbered AS (SELECT outcome, row_number() OVER (ORDER BY case_id) - 1 AS slot, count(*) OVER () AS n FROM scored),
        drawn AS (SELECT draw, CAST(('0x' || substr(md5('0:' || draw || ':' || slot), 1, 8)) AS BIGINT) % n AS slot FROM numbered, unnest(range(0, 200)) t(draw)),
        c AS (SELECT draw, {_TALLY} FROM drawn JOIN numbered USING (slot) GROUP BY draw),
        r AS (SELECT draw, {', '.join(f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0) AS {m}" for m, a, b in (('precision', 'tp', 'tp + fp'), ('recall', 'tp', 'tp + fn'), ('false_alarm_rate', 'fp', 'fp + tn')))} FROM c)
        SELECT CAST(draw AS INTEGER) AS draw, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
               round_even(false_alarm_rate, 6) AS false_alarm_rate FROM r""",
    "q21_merge_anti_union": """WITH kept AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 5 = 0)
        SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 ELSE 1073741824 END AS ord FROM kept""",
    "q22_cache_dedupe": f"""WITH asked AS (SELECT DISTINCT {_KEY} AS key FROM documents), stored AS (SELECT DISTINCT {_KEY} AS key FROM documents WHERE doc_id % 3 = 0)
        SELECT CAST(count(*) FILTER (s.key IS NOT NULL) AS BIGINT) AS hits, CAST(count(*) FILTER (s.key IS NULL) AS BIGINT) AS misses, {_ratio('count(*) FILTER (s.key IS NOT NULL)', 'count(*)')} AS hit_rate
        FROM asked a LEFT JOIN stored s USING (key)""",
    "q23_accept_baseline": f"""WITH f AS (SELECT doc_id, lang, sha256({_SQUEEZED.format('text')}) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'DRIFT' ELSE 'UNCERTAIN' END AS verdict FROM documents),
        b AS (SELECT DISTINCT lang, digest, true AS known FROM f WHERE doc_id % 4 = 1)
        SELECT doc_id, digest, coalesce(known, false) AND verdict = 'DRIFT' AS accepted, CASE WHEN coalesce(known, false) THEN CASE WHEN verdict = 'DRIFT' THEN 'COMPLIANT' ELSE verdict END ELSE verdict END AS verdict
        FROM f LEFT JOIN b USING (lang, digest)""",
    "q24_target_join": f"""WITH {_cases()}, t AS (SELECT case_id, unnest(list_distinct(targets)) AS rule_id FROM cases)
        SELECT case_id, t.rule_id, CAST(length(text) AS BIGINT) AS rule_chars FROM t JOIN benchmark ON t.rule_id = 'R' || item_id""",
    "q25_flips_self_join": f"WITH {_verdicts('1', 'a')}, {_verdicts('2', 'b')} SELECT a.case_id, a.rule_id, a.verdict AS was, b.verdict AS now FROM a JOIN b USING (case_id, rule_id, k) WHERE a.verdict <> b.verdict",
    "q26_explorer_filter_page": f"""WITH {_cases()} SELECT case_id, project, category, note FROM cases WHERE label = 'no_drift' AND coalesce(escapes, false)
        AND (contains(lower(case_id), 'r3') OR contains(lower(note), 'r3') OR contains(lower(gold), 'r3') OR len(list_filter(targets, lambda t: contains(lower(t), 'r3'))) > 0) ORDER BY case_id LIMIT 5 OFFSET 5""",
    "q27_fuzzy_match": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(?s)a.*e.*n')",
    "q28_representative_case": f"WITH {_cases()} SELECT category, min(case_id) AS case_id, arg_min(project, case_id) AS project FROM cases WHERE status = 'valid' AND label = 'drift' GROUP BY category",
    "q29_example_picker": f"""{_BASE}, first AS (SELECT outcome, min(case_id) AS case_id FROM scored WHERE outcome <> 'TN' GROUP BY outcome)
        SELECT outcome, case_id, rule_id, verdict FROM first JOIN cases USING (case_id) LEFT JOIN verdicts USING (case_id)
        QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN verdict = 'DRIFT' THEN 0 WHEN coalesce(list_contains(targets, rule_id), false) THEN 1 ELSE 2 END, k) = 1""",
    "q30_heading_carry": r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        marked AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN '## ' || line WHEN pos % 2 = 1 THEN '- **R' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0') || '** x' || line ELSE line END AS line FROM lines),
        parsed AS (SELECT *, nullif(regexp_extract(line, '^\s*#{2,}\s+(.+?)\s*$', 1), '') AS heading, regexp_extract(line, '^\s*[-*]\s+\*\*(R\d+)\*\*\s+(.+?)\s*$', 1) AS rule_id,
                          regexp_extract(line, '^\s*[-*]\s+\*\*(R\d+)\*\*\s+(.+?)\s*$', 2) AS body FROM marked),
        carried AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS section FROM parsed)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS rule_pos, rule_id, md5(body || '|' || section) AS digest FROM carried WHERE rule_id <> ''""",
    "q31_reply_parse": f"""WITH {_REPLIES} SELECT CAST(-k AS INTEGER) AS k, {_SAID} AS verdict, {_clamp(_reply('confidence'))} AS confidence, {_line(_reply('evidence.start_line'))} AS start_line FROM parsed
        UNION ALL SELECT CAST(event_id AS INTEGER), 'UNCERTAIN', {_clamp("json_extract_string(props, '$.k')")}, {_line("json_extract_string(props, '$.k')")} FROM events""",
    "q32_evidence_gate": f"""WITH {_REPLIES}, g AS (SELECT k, {_SAID} AS verdict, {' AND '.join(f"trim(coalesce({_reply(f)}, '')) <> ''" for f in ('violated_clause', 'counterexample.input', 'counterexample.actual'))} AS shown FROM parsed)
        SELECT CAST(k AS INTEGER) AS k, CASE WHEN verdict = 'DRIFT' AND NOT shown THEN 'UNCERTAIN' ELSE verdict END AS verdict, verdict = 'DRIFT' AND NOT shown AS downgraded FROM g""",
    "q33_salvage_objects": """WITH entries AS (
  SELECT doc_id, k, '{"n": {"k": ' || k || '}, "rule_id": "R' || k || '", "t": "} ' || md5(string_split(text, chr(10))[k + 1]) || ' \\"{"}' AS item
  FROM documents, unnest(range(0, len(string_split(text, chr(10))))) t(k)),
placed AS (SELECT *, 1 + sum(length(item) + 2) OVER (PARTITION BY doc_id ORDER BY k) - 2 AS last, sum(length(item) + 2) OVER (PARTITION BY doc_id) AS total FROM entries)
SELECT doc_id, k AS pos, item FROM placed WHERE last <= total * 3 // 4""",
    "q34_reply_index_last_wins": f"""WITH given AS (
  SELECT doc_id AS question_key, CAST(replace(pattern, '"rule_id": "', '"rule_id": "' || doc_id % 10) AS JSON) AS j FROM {_patterned([r[1:] for r in LISTED], 'pattern')}),
        lists AS (SELECT question_key, CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE coalesce(json_extract(j, '$.rules'), json_extract(j, '$.verdicts'), json_array(j)) END AS l FROM given),
        items AS (SELECT question_key, i, json_extract(l, '$[' || i || ']') AS x FROM lists, unnest(range(0, CAST(json_array_length(l) AS BIGINT))) t(i))
        SELECT question_key, json_extract_string(x, '$.rule_id') AS rule_id, arg_max(json_extract_string(x, '$.verdict'), i) AS verdict FROM items WHERE coalesce(json_extract_string(x, '$.rule_id'), '') <> '' GROUP BY 1, 2""",
    "q35_exact_once_patch": """WITH c AS (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents)
        SELECT doc_id, n, md5(CASE WHEN n = 1 THEN replace(text, 'the', '<the>') ELSE '-' END) AS digest, CASE WHEN n <> 1 THEN 'pattern found ' || n || ' times, expected 1' END AS error FROM c""",
    "q36_strip_ids": f"""WITH given AS (SELECT doc_id, pattern || chr(10) || text AS source FROM {_patterned([r[1:] for r in IDS], "pattern")}),
s AS (SELECT doc_id, {_strip("source")} AS s FROM given)
SELECT doc_id, md5(s) AS digest, CAST(length(s) AS BIGINT) AS n_chars, regexp_matches(s, '\\bR[0-9][0-9]\\b') AS left_over FROM s""",
    "q37_gutter_render": """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        n AS (SELECT doc_id, pos, line, CAST(doc_id * 10 + pos - 1 AS VARCHAR) AS number FROM lines)
        SELECT doc_id, md5(string_agg(lpad(number, CAST(greatest(4, length(number)) AS INTEGER), ' ') || ' | ' || line, chr(10) ORDER BY pos)) AS digest FROM n GROUP BY doc_id""",
    "q38_constant_context": r"""WITH chunks AS (SELECT doc_id AS id, source AS file, doc_id % 7 = 0 AS module, text || chr(10) || 'LIMIT_' || doc_id % 5 || CASE WHEN doc_id % 7 = 0 THEN ' = 1' || chr(10) ELSE ' used' || chr(10) END AS s FROM documents),
        hits AS (SELECT id % 40 AS group_id, id, row_number() OVER (PARTITION BY id % 40 ORDER BY id) AS rank FROM chunks WHERE NOT module QUALIFY rank <= 3),
        named AS (SELECT DISTINCT group_id, rank, file, unnest(regexp_extract_all(s, '\b[A-Z][A-Z0-9_]{2,}\b')) AS c FROM hits JOIN chunks USING (id)),
        defined AS (SELECT DISTINCT id AS module_id, file, unnest(regexp_extract_all(s, '(?m)^([A-Z][A-Z0-9_]{2,})\s*[:=]', 1)) AS c FROM chunks WHERE module),
        met AS (SELECT group_id, module_id, min(rank) AS rank FROM named JOIN defined USING (file, c) GROUP BY ALL)
        SELECT group_id, module_id, CAST(rank AS BIGINT) AS rank FROM met QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rank, module_id) <= 2""",
    "q39_number_gap_judge": r"""WITH given AS (SELECT doc_id, 'At least ' || doc_id % 9 || ' and ' || CAST(doc_id % 4 + 0.5 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN ' or raise `LimitError`' ELSE '' END AS rule,
            text || chr(10) || 'limit = ' || doc_id % 8 || '.0 # 99' || chr(10) || 'step = ' || CAST(doc_id % 5 + 0.5 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'raise LimitError' || chr(10) WHEN doc_id % 5 = 0 THEN chr(10) || 'raise Other' || chr(10) ELSE chr(10) END AS code FROM documents),
        cut AS (SELECT doc_id, rule, CASE WHEN contains(code, '|') THEN array_to_string(list_transform(list_filter(string_split(code, chr(10)), lambda x: contains(x, '|')), lambda x: regexp_replace(x, '^[^|]*\|', '')), chr(10)) ELSE code END AS code FROM given),
        plain AS (SELECT doc_id, rule, regexp_replace(regexp_replace(code, '#[^\n]*', '', 'g'), '(?s)\"\"\".*?\"\"\"', '', 'g') AS code FROM cut),
        sets AS (SELECT doc_id, code, list_filter(list_transform(regexp_extract_all(rule, '\b([0-9]+(?:\.[0-9]+)?)\b', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x NOT IN (0, 1, 2)) AS wanted,
            list_transform(regexp_extract_all(code, '\b([0-9]+(?:\.[0-9]+)?)\b', 1), lambda x: CAST(x AS DOUBLE)) AS there, contains(rule, '`') AS named FROM plain),
        rated AS (SELECT *, CASE WHEN len(there) > 0 THEN list_filter(wanted, lambda x: NOT list_contains(there, x)) ELSE [] END AS missing, contains(code, 'raise ') AS raises FROM sets)
        SELECT doc_id, CASE WHEN len(missing) > 0 OR (named AND raises AND NOT contains(code, 'raise LimitError')) THEN 'DRIFT' WHEN (len(wanted) > 0 AND len(there) = 0) OR (named AND NOT raises) THEN 'UNCERTAIN' ELSE 'COMPLIANT' END AS verdict,
            CAST(CASE WHEN len(missing) > 0 THEN 0.72 WHEN named AND raises AND NOT contains(code, 'raise LimitError') THEN 0.68 WHEN (len(wanted) > 0 AND len(there) = 0) OR (named AND NOT raises) THEN 0.3 ELSE 0.6 END AS DOUBLE) AS confidence,
            CASE WHEN len(missing) > 0 THEN CAST(list_min(missing) AS VARCHAR) WHEN named AND raises AND NOT contains(code, 'raise LimitError') THEN 'LimitError' ELSE '' END AS reason FROM rated""".replace('\\"', '"'),
    "q40_reverse_judge": r"""WITH asked AS (SELECT item_id % 40 AS slot, string_agg(text, chr(10) ORDER BY text) AS rules_text FROM benchmark GROUP BY 1),
        docs AS (SELECT doc_id, doc_id % 40 AS slot, regexp_replace('_' || regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z]+', '_', 'g'), '^_+', '') AS name, text,
            CASE WHEN doc_id % 3 = 0 THEN string_split(text, chr(10))[1] WHEN doc_id % 3 = 1 THEN 'not there at all' ELSE '  ' || string_split(text, chr(10))[-1] END AS quote FROM documents),
        said AS (SELECT doc_id, text, quote, list_filter(regexp_split_to_array(lower(name), '_+'), lambda w: length(w) > 3) AS words, lower(rules_text) AS r FROM docs JOIN asked USING (slot)),
        raws AS (SELECT doc_id, CASE WHEN len(words) = 0 OR len(list_filter(words, lambda w: contains(r, left(w, 5)))) > 0 THEN 'AUTHORISED' ELSE 'UNAUTHORISED' END AS raw,
            list_transform(list_filter(string_split(trim(quote), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS wanted,
            list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS lines, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS q FROM said),
        starts AS (SELECT *, list_filter(range(0, greatest(0, len(lines) - len(wanted) + 1)), lambda s: len(list_filter(range(1, len(wanted) + 1), lambda k: NOT contains(lines[s + k], wanted[k]))) = 0) AS fits FROM raws),
        spots AS (SELECT doc_id, raw, CASE WHEN len(wanted) = 0 THEN NULL WHEN len(fits) > 0 THEN fits[1] WHEN contains(flat, q) THEN 0 END AS first_line,
            CASE WHEN len(wanted) = 0 THEN NULL WHEN len(fits) > 0 THEN fits[1] + len(wanted) - 1 WHEN contains(flat, q) THEN len(lines) - 1 END AS last_line FROM starts)
        SELECT doc_id, raw, CASE WHEN raw = 'AUTHORISED' THEN 'COMPLIANT' WHEN first_line IS NULL THEN 'UNCERTAIN' ELSE 'DRIFT' END AS verdict, raw = 'UNAUTHORISED' AND first_line IS NULL AS downgraded,
            CASE WHEN raw = 'UNAUTHORISED' AND first_line IS NOT NULL THEN 'No rule authorises: b' ELSE '' END AS clause, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line FROM spots""",
    "q41_gold_match": "SELECT page_id, page_id % 5 <> 0 AND (page_id % 3 = 0 OR page_id % 3 = 1) AS matches FROM pages",
    "q42_union_directions": f"WITH {_verdicts()} SELECT 'both' AS detector, direction, verdict, CAST(count(*) AS BIGINT) AS n FROM verdicts GROUP BY ALL",
    "q43_spec_pick": f"""WITH given AS (
          SELECT name || '-' || doc_id // {len(SPEC_FILES)} AS upload, path, head || chr(10) || text AS text FROM {_patterned(SPEC_FILES, 'name, path, head')}),
        heads AS (SELECT *, min(CASE WHEN contains(path, '/') THEN 1 ELSE 0 END) OVER w = 1 AND min(string_split(path, '/')[1]) OVER w = max(string_split(path, '/')[1]) OVER w AS wrapped FROM given WINDOW w AS (PARTITION BY upload)),
        files AS (SELECT upload, CASE WHEN wrapped THEN substr(path, instr(path, '/') + 1) ELSE path END AS path, text FROM heads),
        rated AS (SELECT upload, path, list_position(['spec.md', 'specification.md', 'specs.md'], lower(regexp_extract(path, '[^/]*$', 0))) AS rank, len(string_split(path, '/')) - 1 AS depth,
            len(regexp_extract_all(text, '(?m)^\\s*[-*]\\s+\\*\\*(R[0-9]+)\\*\\*\\s+.+?\\s*$')) AS rules FROM files),
        kept AS (SELECT *, count(*) OVER (PARTITION BY upload, coalesce(rank, 0), depth) AS twins FROM rated WHERE coalesce(rank, 0) > 0 OR (lower(path) LIKE '%.md' AND rules > 0))
        SELECT upload, path, CASE WHEN coalesce(rank, 0) > 0 AND twins > 1 THEN 'more than one ' || regexp_extract(path, '[^/]*$', 0) END AS error FROM kept
        QUALIFY row_number() OVER (PARTITION BY upload ORDER BY coalesce(rank, 0) = 0, CASE WHEN coalesce(rank, 0) > 0 THEN 0 ELSE -rules END, depth, rank, path) = 1""",
    "q45_chunker": """WITH files AS (
  SELECT doc_id, 'w' || doc_id % 3 AS workspace, 'src/m' || doc_id || '.py' AS file, md5(text) AS digest, doc_id % 5 AS last FROM documents WHERE doc_id % 11 <> 0),
parts AS (
  SELECT *, '<module>' AS qualname, 'module' AS kind, 1 AS start_line, 2 AS end_line, repeat(chr(34), 3) || 'Module ' || digest || '.' || repeat(chr(34), 3) || chr(10) || 'LIMIT = ' || doc_id AS source FROM files
  UNION ALL SELECT *, 'first', 'function', 5, 7, '@wrap' || chr(10) || 'def first(a):' || chr(10) || '    return a' FROM files
  UNION ALL SELECT *, 'Box', 'class', 10, 12, 'class Box:' || chr(10) || '    size = 0' || chr(10) FROM files
  UNION ALL SELECT f.*, 'Box.m' || k, 'method', CAST(13 + 3 * k AS INTEGER), CAST(14 + 3 * k AS INTEGER), '    def m' || k || '(self):' || chr(10) || '        return ' || k FROM files f, unnest(range(0, last + 1)) t(k))
SELECT workspace, file || '::' || qualname AS chunk_id, file, qualname, kind, start_line, end_line, md5(source) AS source FROM parts""",
    "q46_retention": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00'",
    "q47_rate_limit_stateful": """WITH RECURSIVE hits AS (
  SELECT CAST(user_id AS VARCHAR) AS client, CAST(event_id + 1 AS DOUBLE) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (
  SELECT DISTINCT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS "at", CAST([] AS DOUBLE[]) AS kept, CAST(NULL AS BOOLEAN) AS admitted FROM hits
  UNION ALL
  SELECT client, n, "at", CASE WHEN len(recent) >= 2 THEN recent ELSE list_append(recent, "at") END, len(recent) < 2
  FROM (SELECT h.client, h.n, h."at", list_filter(w.kept, lambda x: h."at" - x <= 60) AS recent FROM walk w JOIN hits h ON h.client = w.client AND h.n = w.n + 1))
SELECT client, "at", admitted FROM walk WHERE n > 0""",
    "q48_stream_verdict_counts": f"WITH {_EVENTS} SELECT user_id % 20 AS check_id, verdict, CAST(count(*) AS BIGINT) AS n FROM said GROUP BY ALL",
    "q49_confidence_clamp": "SELECT round_even(CASE WHEN l_linenumber = 3 THEN 0.0 ELSE greatest(0.0, least(1.0, CAST(round_even(l_discount * 10, 3) AS DOUBLE))) END, 4) AS confidence, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1",
    "q50_oracle_status": f"""WITH {_cases()} SELECT case_id, CASE WHEN i % 7 = 0 THEN 'waived' WHEN i % 3 = 0 THEN 'missing' WHEN i % 10 = 1 THEN 'broken' WHEN i % 4 = 2 THEN 'blind' ELSE 'confirmed' END AS status
        FROM cases WHERE label = 'drift' AND status = 'valid' AND escapes""",
    "q51_ranked_detector": f"WITH {_WORKSPACES}, {_RANKED}, {_judged('rule', 'code', 'asked')} SELECT workspace, rule_id, verdict, confidence, {_CLAUSE}, false AS downgraded, chunks FROM judged",
    "q52_whole_project_detector": f"""WITH {_WORKSPACES}, code AS (SELECT workspace, string_agg(s, chr(10) ORDER BY file, s) AS code FROM chunks GROUP BY 1), asked AS (SELECT * FROM rules JOIN code USING (workspace)),
        {_judged('rule', 'code', 'asked')} SELECT workspace, rule_id, verdict, confidence, {_CLAUSE}, false AS parse_error FROM judged""",
    "q53_reverse_detector": f"WITH {_WORKSPACES}, {_AUDITED} SELECT * FROM audited",
    "q54_both_directions": f"""WITH {_WORKSPACES}, {_RANKED}, {_judged('rule', 'code', 'asked')}, {_AUDITED}, both_ AS (SELECT 'forward' AS direction, verdict FROM judged UNION ALL SELECT 'reverse', verdict FROM audited)
        SELECT 'ranked-reverse' AS detector, direction, verdict, CAST(count(*) AS BIGINT) AS n FROM both_ GROUP BY ALL""",
    "q55_recall_by_category": f"""WITH {_vectors(5)}, {_GOLD} SELECT CASE WHEN grouping('D' || (1 + rule_id % 9)) = 1 THEN 'all' ELSE 'D' || (1 + rule_id % 9) END AS category, CAST(count(*) AS BIGINT) AS n,
        {', '.join(f"round_even(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 4) AS r{k}" for k in (1, 3, 5))} FROM ranked GROUP BY GROUPING SETS (('D' || (1 + rule_id % 9)), ())""",
    "q57_check_events": f"""WITH {_WORKSPACES}, {_RANKED}, {_judged('rule', 'code', 'asked')}, per AS (SELECT workspace, count(*) AS n, CASE WHEN bool_or(verdict = 'DRIFT') THEN 'DRIFT' WHEN bool_or(verdict = 'UNCERTAIN') THEN 'NEEDS_HUMAN' ELSE 'PASS' END AS status FROM judged GROUP BY 1)
        SELECT workspace, event, CAST(CASE event WHEN 'stage' THEN 12 WHEN 'summary' THEN 1 ELSE n END AS BIGINT) AS n, CASE WHEN event = 'summary' THEN status END AS status FROM per, unnest(['stage', 'rule_start', 'verdict', 'rule_detail', 'summary']) t(event)""",
    "q62_dense_topk": f"""WITH docs AS (SELECT 'r' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'c', doc_id, text FROM documents),
terms AS (SELECT side, id, token, count(*) AS n FROM (SELECT side, id, unnest({_tokens("text")}) AS token FROM docs) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM terms GROUP BY token),
raw AS (
  SELECT side, id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS bucket, sum((1 + ln(n)) * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1)) AS w
  FROM terms JOIN df USING (token) GROUP BY ALL),
unit AS (SELECT side, id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM raw),
scores AS (
  SELECT r.id AS rule_id, c.id AS chunk_id, round_even(sum(r.w * c.w), 6) AS score FROM unit r JOIN unit c ON r.side = 'r' AND c.side = 'c' AND r.bucket = c.bucket GROUP BY ALL),
every AS (SELECT item_id AS rule_id, doc_id AS chunk_id, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN scores ON rule_id = item_id AND chunk_id = doc_id)
SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, round_even(score, 4) AS score FROM every QUALIFY rank <= 3""",
    "q63_case_detail": f"""WITH {_cases()}, {_verdicts("1", "one")}, {_verdicts("2", "two")},
wanted AS (SELECT DISTINCT case_id, rule_id, text FROM (SELECT case_id, unnest(targets) AS rule_id FROM cases) JOIN (SELECT 'R' || item_id AS rule_id, text FROM benchmark) USING (rule_id)),
texts AS (SELECT case_id, string_agg(rule_id, '|' ORDER BY rule_id) AS targets, string_agg(text, '|' ORDER BY rule_id) AS t FROM wanted GROUP BY case_id),
told AS (
  SELECT case_id, d || ':' || string_agg(rule_id || '=' || verdict, ',' ORDER BY k) AS one_said
  FROM (SELECT 'one' AS d, * FROM one UNION ALL SELECT 'two', * FROM two) GROUP BY case_id, d)
SELECT case_id, coalesce(texts.targets, '') AS targets, md5(coalesce(t, '')) AS digest, coalesce(said, '') AS said
FROM cases LEFT JOIN texts USING (case_id) LEFT JOIN (SELECT case_id, string_agg(one_said, ';' ORDER BY one_said) AS said FROM told GROUP BY case_id) USING (case_id)""",
    "q64_retrieval_misses": f"""WITH {_vectors(5)}, {_GOLD}
SELECT 'c' || rule_id AS case_id, 'D' || (1 + rule_id % 9) AS category, rule_id FROM ranked WHERE coalesce(rank, 2) > 1 ORDER BY case_id LIMIT 15""",
    "q65_source_counts": """SELECT 'w' || doc_id % 3 AS workspace, count(*) AS files, CAST(sum(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 12 + 3 * (doc_id % 5 + 1) END) AS BIGINT) AS lines FROM documents GROUP BY 1""",
    "q60_live_check": """WITH said AS (
  SELECT CAST(user_id % 20 AS VARCHAR) AS check_id, event_id, 'R' || event_id % 7 AS rule_id, CAST((event_id % 10) / 10 AS VARCHAR) AS confidence, CAST(event_id % 4 AS VARCHAR) AS retrieved,
         CASE WHEN event_type = 'error' THEN 'DRIFT' WHEN event_type = 'click' THEN 'UNCERTAIN' ELSE 'COMPLIANT' END AS verdict FROM events),
last AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY check_id, rule_id ORDER BY event_id DESC) = 1),
stand AS (
  SELECT check_id, CASE WHEN bool_or(verdict = 'DRIFT') THEN 'DRIFT' WHEN bool_or(verdict = 'UNCERTAIN') THEN 'NEEDS_HUMAN' ELSE 'PASS' END AS status FROM last GROUP BY check_id)
SELECT check_id, rule_id, verdict, confidence, retrieved, status, CAST(n_events AS BIGINT) AS n_events
FROM last JOIN stand USING (check_id) JOIN (SELECT check_id, 3 * count(*) AS n_events FROM said GROUP BY check_id) USING (check_id)""",
    "q61_live_sweep": f"""WITH {_cases()}, {_verdicts()}, r AS (
  SELECT case_id, any_value(category) AS category, coalesce(bool_or(verdict = 'DRIFT' AND (len(targets) = 0 OR list_contains(targets, rule_id))), false) AS caught
  FROM cases LEFT JOIN verdicts USING (case_id) GROUP BY case_id)
SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (caught) AS BIGINT) AS caught, round_even(count(*) FILTER (caught) / count(*), 4) AS rate FROM r GROUP BY category""",
    "q58_sweep_events": f"""WITH {_cases()}, {_verdicts()}, r AS (SELECT case_id, coalesce(bool_or(verdict = 'DRIFT' AND (len(targets) = 0 OR list_contains(targets, rule_id))), false) AS caught FROM cases LEFT JOIN verdicts USING (case_id) GROUP BY 1),
        s AS (SELECT category, count(*) FILTER (caught) AS n FROM r JOIN cases USING (case_id) GROUP BY 1)
        SELECT 'case_start' AS event, NULL AS caught, CAST(count(*) AS BIGINT) AS n FROM r UNION ALL SELECT 'case_result', CAST(caught AS VARCHAR), CAST(count(*) AS BIGINT) FROM r GROUP BY caught
        UNION ALL SELECT 'sweep_summary', CAST(n AS VARCHAR), CAST(count(*) AS BIGINT) FROM s GROUP BY n""",
    "q59_case_rows": f"""WITH {_cases()}, {_verdicts('1', 'a')}, {_verdicts('2', 'b')}, {', '.join(f"{t}s AS (SELECT case_id, CASE WHEN bool_or(verdict = 'DRIFT') THEN 'DRIFT' ELSE arg_min(verdict, k) END AS said FROM {t} GROUP BY 1)" for t in 'ab')}
        SELECT case_id, a_.said AS one, b_.said AS two, (SELECT CAST(count(*) AS BIGINT) FROM cases) AS total FROM cases LEFT JOIN as_ a_ USING (case_id) LEFT JOIN bs b_ USING (case_id) ORDER BY case_id LIMIT 50 OFFSET 50""".replace("as AS (", "as_ AS ("),
}
