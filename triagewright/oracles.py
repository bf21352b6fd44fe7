"""DuckDB SQL of the queries, written apart from the Spark code: plain joins, windows and aggregates over the same derived failures."""

from __future__ import annotations

from triagewright import fixtures as X
from triagewright import schemas as S
from triagewright.operators import answers as A
from triagewright.operators import prompts as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"regexp_replace(lower({trim(c)}), '\s+', ' ', 'g')"


def collapse(c: str) -> str:
    return trim(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def filled(c: str) -> str:
    return rf"(CASE WHEN regexp_matches({c}, '\S') THEN {c} END)"


def line1(c: str) -> str:
    return rf"string_split_regex({c}, '\r?\n')[1]"


def step(c: str) -> str:
    return rf"lower({collapse(rf"regexp_replace({trim(c)}, '(?i)^(given|when|then|and|but)\s+', '')")})"


def exception(c: str) -> str:
    e = rf"regexp_extract({c}, '([A-Za-z_][A-Za-z0-9_.$]*(?:Exception|Error))\b', 1)"
    return f"(CASE WHEN {e} <> '' THEN regexp_extract({e}, '([^.]*)$', 1) END)"


LOCATORS = (
    r"(?i)resource-id\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?", r"(?i)By\.xpath\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)", r"(?i)By\.id\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)",
    r"(?i)By\.cssSelector\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)", r"(?i)accessibilityId\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?", r"(?i)(?:test-id|data-testid)\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?",
)


def locator(c: str, more: tuple[str, ...] = ()) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {q(p)}, 1), '')" for p in (*LOCATORS, *more)) + ")"


def mask(c: str) -> str:
    quoted = f"regexp_replace({c}, {q('[' + chr(39) + chr(34) + '][^' + chr(39) + chr(34) + ']*[' + chr(39) + chr(34) + ']')}, '\"*\"', 'g')"
    return f"lower({collapse(rf"regexp_replace({quoted}, '\d+', '#', 'g')")})"


BOTH = "coalesce(error_message, '') || chr(10) || coalesce(stack_trace, '')"
FRAMES = rf"list_filter(list_transform(string_split_regex(stack_trace, '\r?\n'), lambda x: trim(x)), lambda x: starts_with(x, 'at '))"
OWN = f"list_filter({FRAMES}, lambda x: NOT (contains(x, 'io.cucumber.') OR contains(x, 'org.testng.Assert') OR contains(x, 'java.base/') OR contains(x, 'io.appium.') OR contains(x, 'org.openqa.selenium.support.ui.')))"
FAILURES = "WITH failures AS (" + X.FAILURES_SQL.replace("STRING", "VARCHAR") + ")"
PARTS = FAILURES + rf""", named AS (
  SELECT *, coalesce({step('failed_step_line')}, '') AS step, coalesce({exception(BOTH)}, 'UNKNOWN') AS exception,
    coalesce({locator(BOTH, (r"(?i)xpath\s*[=:]\s*['\"]?([^'\"\n]+)['\"]?",))}, '') AS locator, error_message IS NOT NULL AS has_error,
    coalesce(lower(regexp_replace(coalesce(({OWN})[1], ({FRAMES})[1]), ':\d+\)', ')', 'g')), '') AS stack_frame FROM failures),
parts AS (SELECT *, locator <> '' AS has_locator, CASE WHEN error_message IS NULL THEN 'no-error' ELSE {mask(f"(CASE WHEN locator <> '' THEN replace({line1('error_message')}, locator, '*') ELSE {line1('error_message')} END)")} END AS error_body FROM named)"""
KEYED = PARTS + """, groups AS (
  SELECT *, min(failure_idx) OVER (PARTITION BY report_id, step, exception, locator, CASE WHEN step = '' OR exception = 'UNKNOWN' THEN failure_idx END) AS group_idx FROM parts)"""
HEADS = KEYED + """, heads AS (
  SELECT report_id, group_idx, coalesce(min(failure_idx) FILTER (WHERE failure_image <> ''), min(failure_idx)) AS representative_idx, count(*) AS members FROM groups GROUP BY ALL)"""
SIGNATURE = f"{mask('failed_step_line')} || ' || ' || CASE WHEN error_message IS NULL THEN 'no-error' ELSE {mask(line1('error_message'))} END"
ID_ERROR = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce({squeeze('error_message')}, ''), '\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b', '<uuid>', 'g'), '\[\d+\]', '[#]', 'g'), '\d{{3,}}', '<num>', 'g')"""
FAILURE_ID = f"substr(sha256(coalesce({squeeze('failed_step_line')}, '') || '|' || lower(coalesce({exception('error_message')}, '')) || '|' || {ID_ERROR}), 1, 16)"
LEGACY_ID = "substr(sha256(" + " || '|' || ".join(f"coalesce({squeeze(c)}, '')" for c in ("scenario_name", "feature_name", "failed_step_line", "error_message")) + "), 1, 16)"
IDS = FAILURES + f", ids AS (SELECT *, {FAILURE_ID} AS failure_id, {LEGACY_ID} AS legacy_id, CASE WHEN failure_image <> '' THEN sha256(failure_image) END AS hash FROM failures)"
LABEL = "CASE WHEN contains(i.error_message, 'Timeout') THEN 'AUTOMATION_ISSUE' WHEN i.scenario_name = 'Scenario error' THEN l[CAST(i.failure_idx % 5 + 1 AS INT)] ELSE l[CAST(right(i.failed_step_line, 1) AS INT) + 1] END"
LABELS = "[" + ", ".join(map(q, S.CLASSIFICATIONS)) + "]"
LOG = IDS + f""", responses AS ({X.RESPONSES_SQL.replace('STRING', 'VARCHAR')}),
log AS (
  SELECT CASE WHEN i.scenario_name = 'Scenario purchase' THEN i.legacy_id ELSE i.failure_id END AS failure_id, 'AI' AS kind, i.failure_idx AS seq, r.classification AS ai_classification, r.root_cause, r.root_cause_type, r.severity,
    r.recommended_action, r.suggested_fix, r.similar_patterns, r.screenshot_observation, r.confidence, i.hash AS screenshot_hash, {exception(BOTH)} AS exception_type, {trim(locator(BOTH))} AS locator,
    {step('failed_step_line')} AS normalized_step, CAST(NULL AS VARCHAR) AS human
  FROM ids i JOIN responses r USING (failure_idx) WHERE i.failure_idx % 3 = 0
  UNION ALL BY NAME
  SELECT i.failure_id, 'HUMAN' AS kind, i.failure_idx AS seq, {LABEL} AS human FROM ids i, (SELECT {LABELS} AS l) WHERE i.failure_idx % 7 = 0 AND i.scenario_name <> 'Scenario purchase')"""
AI_COLUMNS = ("ai_classification", "root_cause", "root_cause_type", "severity", "recommended_action", "suggested_fix", "similar_patterns", "screenshot_observation", "confidence", "screenshot_hash", "exception_type", "locator", "normalized_step")
LOW = "lower(root_cause)"


def current(log: str = "log") -> str:
    each = ", ".join(f"(arg_max({{'x': {c}}}, stamp) FILTER (WHERE kind = 'AI')).x AS {c}" for c in AI_COLUMNS)
    return f""", stamped AS (SELECT *, CASE WHEN kind = 'CORRECTION' THEN 1750000000 ELSE 1700000000 END + seq AS stamp FROM {log}),
now0 AS (SELECT failure_id, {each}, bool_or(kind = 'AI') AS has_ai, (arg_max({{'x': human}}, stamp) FILTER (WHERE kind <> 'AI')).x AS human_classification, min(stamp) AS created, max(stamp) AS updated FROM stamped GROUP BY failure_id),
now AS (SELECT *, coalesce(has_ai AND similar_patterns IS NOT NULL AND severity IS NOT NULL AND regexp_matches(root_cause, '\\S') AND NOT contains({LOW}, 'the element was not visible'), false) AS complete FROM now0)"""


NOW = LOG + current()


def reuse(p: str) -> str:
    seen = rf"regexp_matches({p}.screenshot_observation, '\S') AND {p}.screenshot_hash = i.hash"
    return f"coalesce({p}.complete AND (i.hash IS NULL OR ({seen})), false)"


def matches(forced: str = "false") -> str:
    return NOW + f""", matched AS (
  SELECT i.*, CASE WHEN e.failure_id IS NOT NULL THEN 'exact' WHEN o.failure_id IS NOT NULL THEN 'legacy' END AS matched_by,
    CASE WHEN e.failure_id IS NOT NULL THEN {reuse('e')} WHEN o.failure_id IS NOT NULL THEN {reuse('o')} ELSE false END AS reusable,
    coalesce(e.failure_id, o.failure_id) AS hit
  FROM ids i LEFT JOIN now e ON e.failure_id = i.failure_id AND NOT ({forced}) LEFT JOIN now o ON o.failure_id = i.legacy_id AND e.failure_id IS NULL AND NOT ({forced})),
named AS (SELECT *, CASE WHEN reusable THEN 'HISTORICAL' WHEN matched_by IS NOT NULL THEN 'AI_ENRICHED' ELSE 'AI' END AS source FROM matched)"""


INVESTIGATED = FAILURES + f""", responses AS ({X.RESPONSES_SQL}), investigated AS (
  SELECT f.*, r.classification, r.root_cause, r.severity, r.confidence, r.failure_idx IS NOT NULL AS investigated FROM failures f LEFT JOIN (SELECT * FROM responses WHERE failure_idx % 9 <> 0) r USING (failure_idx))"""


def plain(c: str) -> str:
    return rf"(CASE WHEN {filled(c)} IS NULL THEN 'UNKNOWN' ELSE {collapse(f"regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g')")} END)"


CLUSTERS = INVESTIGATED + rf""", signed AS (
  SELECT *, CASE WHEN investigated THEN {trim('classification')} || '|' || {plain('feature_name')} || '|' || {plain('failed_step_line')} || '|' || CASE WHEN error_message IS NULL THEN 'UNKNOWN' ELSE regexp_replace({plain('error_message')}, '\d+\s*seconds?', 'timeout', 'g') END ELSE 'UNKNOWN' END AS signature FROM investigated),
clusters AS (
  SELECT report_id, signature, min(failure_idx) AS first_idx, count(*) AS failures, avg(confidence) AS mean,
    max(CASE upper(severity) WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS rank,
    string_agg(CAST(failure_idx AS VARCHAR), ',' ORDER BY failure_idx) AS failure_indexes, list(test_case_id ORDER BY failure_idx) AS t, list(scenario_name ORDER BY failure_idx) AS s
  FROM signed GROUP BY ALL)"""


def distinct(c: str) -> str:
    return f"array_to_string(list_filter({c}, lambda x, i: list_position({c}, x) = i), ',')"


SUMMARY = ", ".join(f"count(*) FILTER (WHERE investigated AND upper(classification) = '{k.upper()}_ISSUE') AS {k}_issues" for k in ("automation", "application", "api", "data", "environment", "network"))
SUMMARY += ", count(*) FILTER (WHERE investigated AND NOT coalesce(upper(classification) IN ('AUTOMATION_ISSUE', 'APPLICATION_ISSUE', 'API_ISSUE', 'DATA_ISSUE', 'ENVIRONMENT_ISSUE', 'NETWORK_ISSUE'), false)) AS unknown_issues, "
SUMMARY += ", ".join(f"count(*) FILTER (WHERE investigated AND upper(severity) = '{s.upper()}') AS {s}_severity" for s in ("critical", "high", "medium", "low"))


def cues(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + ")"


def guard(label: str, said: str) -> str:
    return f"CASE WHEN upper({trim(label)}) = 'APPLICATION_ISSUE' AND {cues(said, A.LOCATOR_CUES)} AND {cues(said, A.VISIBLE_CUES)} AND NOT {cues(said, A.CONNECTION_CUES)} THEN 'AUTOMATION_ISSUE' ELSE {label} END"


def joined(*columns: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(filled(c) for c in columns) + ")"


TOLD = "concat_ws(chr(10), " + ", ".join(rf"CASE WHEN regexp_matches({c}, '\S') THEN '{label}: ' || {trim(c)} END" for label, c in P.HISTORY) + ")"
PROMPT = " || chr(10) || chr(10) || ".join(
    [q(P.RULES)]
    + [f"'--- {h} ---' || chr(10) || {v}" for h, v in zip(P.HEADINGS, (
        "test_case_id", "'EXTENT'", "feature_name", "scenario_name", "all_steps", trim("failed_step_line"), "coalesce(error_message, 'NOT PROVIDED')", "coalesce(stack_trace, 'NOT PROVIDED')", "'NOT PROVIDED'", "'NOT PROVIDED'",
        "CASE WHEN matched_by IS NULL OR told = '' THEN 'NOT PROVIDED' ELSE told END"))]
    + [f"CASE WHEN failure_image <> '' THEN {q(P.WITH_IMAGE)} ELSE {q(P.NO_IMAGE)} END"]
)
CORRECTED = LOG + """, raw AS (
  SELECT CASE WHEN failure_idx % 10 <> 9 THEN failure_id END AS failure_id, failure_idx AS seq, CASE failure_idx % 4 WHEN 0 THEN 'api_issue ' WHEN 1 THEN 'WRONG' WHEN 2 THEN ' ' ELSE 'DATA_ISSUE' END AS label
  FROM ids WHERE failure_idx % 2 = 1 OR failure_idx % 4 = 0),
judged AS (SELECT *, CASE WHEN failure_id IS NULL THEN 'blank failure id' WHEN trim(label) = '' THEN 'blank classification' WHEN label = 'WRONG' THEN 'unknown classification' END AS reason FROM raw),
more AS (SELECT * FROM log UNION ALL BY NAME SELECT failure_id, 'CORRECTION' AS kind, seq, upper(trim(label)) AS human FROM judged WHERE reason IS NULL)""" + current("more")
EFFECTIVE = "SELECT failure_id, ai_classification, human_classification, coalesce(human_classification, ai_classification) AS classification, CASE WHEN human_classification IS NULL THEN 'AI' ELSE 'HUMAN_CORRECTED' END AS label_source FROM now"
PATTERN = rf"coalesce(regexp_replace(regexp_replace(lower({{c}}), '\[\d+\]', '[#]', 'g'), '\d{{3,}}', '<num>', 'g'), '')".replace("{{", "{").replace("}}", "}")
DYNAMIC = r"coalesce(regexp_matches(lower({c}), '[_-]\d{3,}|\[\d+\]|\d{4,}'), false)"
MATCHED = "SELECT failure_idx, failure_id, matched_by, reusable, source FROM named"

#: Two calls for each id, told by its first failure; every fifth has a model with pictures.
ANSWERED = IDS + """, firsts AS (SELECT failure_id, min(failure_idx) AS failure_idx FROM ids GROUP BY failure_id),
calls AS (SELECT f.*, attempt, failure_idx % 5 = 0 AS vision, CASE WHEN failure_idx % 5 = 0 THEN 'vision' ELSE 'text' END AS model, failure_idx % 1000 + 50 AS http_ms FROM firsts f, (VALUES (1), (2)) a(attempt))"""

#: Measures of calls, by the first failure of their id.
MEASURED = {
    "prompt_chars": "(failure_idx % 4000 + 900)", "build_ms": "(failure_idx % 7)", "http_ms": "http_ms", "parse_ms": "(failure_idx % 11)", "prompt_tokens": "(failure_idx % 700)", "output_tokens": "(failure_idx % 300)",
    "total_ms": "(failure_idx % 7 + http_ms + failure_idx % 11)",
}
COUNTERS = [f"{k}_issues" for k in ("automation", "application", "api", "data", "environment", "network", "unknown")] + [f"{s}_severity" for s in ("critical", "high", "medium", "low")]
RECORD = ("root_cause", "recommended_action", "suggested_fix", "similar_patterns", "screenshot_observation")


def folded(rows: str, order: str, complete: str = "f.first_idx % 7 NOT IN (0, 1)", seen_image: str = "true", legacy: str = "o.failure_id = i.legacy_id") -> str:
    """Requests (rows: failure_idx of each, its order and whether forced) one after the other, by a recursion over the requests of each id."""
    seen = rf"coalesce(regexp_matches({{p}}.screenshot_observation, '\S'), false)"
    past = ", ".join(f"{p}.failure_id IS NOT NULL AS {p}_has, coalesce({p}.complete, false) AS {p}_c, {seen.format(p=p)} AS {p}_s, {p}.screenshot_hash AS {p}_h" for p in "eo")
    return f""", firsts AS (SELECT failure_id, min(failure_idx) AS first_idx FROM ids GROUP BY failure_id), asked AS ({rows}),
req AS (
  SELECT q.*, i.failure_id, i.legacy_id, i.hash, i.error_message, i.failed_step_line, f.first_idx, {complete} AS c, {past}, row_number() OVER (PARTITION BY i.failure_id ORDER BY {order}) AS rn
  FROM asked q JOIN ids i USING (failure_idx) JOIN firsts f USING (failure_id) LEFT JOIN now e ON e.failure_id = i.failure_id LEFT JOIN now o ON {legacy}),
fold AS (
  SELECT failure_id, CAST(0 AS BIGINT) AS rn, e_has AS has, e_c AS c, e_s AS s, e_h AS h, false AS own, failure_id AS hit, CAST(NULL AS BIGINT) AS failure_idx, '' AS origin, '' AS source FROM req WHERE rn = 1
  UNION ALL
  SELECT failure_id, rn, has OR NOT reuse, CASE WHEN reuse THEN c ELSE mine END, CASE WHEN reuse THEN s ELSE {seen_image} END, CASE WHEN reuse THEN h ELSE hash END, own OR NOT reuse, hit, failure_idx,
    CASE WHEN NOT reuse THEN 'ASKED' WHEN own THEN 'REPEAT' ELSE 'HISTORY' END, CASE WHEN reuse THEN 'HISTORICAL' WHEN forced OR NOT has THEN 'AI' ELSE 'AI_ENRICHED' END
  FROM (SELECT *, NOT forced AND has AND c AND (hash IS NULL OR (s AND coalesce(h = hash, false))) AS reuse FROM (
    SELECT r.failure_id, r.rn, r.failure_idx, r.forced, r.hash, r.c AS mine, f.own, f.has OR old AS has, CASE WHEN old THEN r.o_c ELSE f.c END AS c, CASE WHEN old THEN r.o_s ELSE f.s END AS s, CASE WHEN old THEN r.o_h ELSE f.h END AS h,
      CASE WHEN old THEN r.legacy_id ELSE f.hit END AS hit
    FROM (SELECT f.*, r AS r, NOT f.has AND NOT r.forced AND r.o_has AS old FROM fold f JOIN req r ON r.failure_id = f.failure_id AND r.rn = f.rn + 1) f))),
askers AS (SELECT failure_id, hash, arg_min(error_message, rn) AS error_message, arg_min(failed_step_line, rn) AS failed_step_line FROM req GROUP BY failure_id, hash)"""


HELD = f"(SELECT *, coalesce(human_classification, {filled('ai_classification')}, 'UNKNOWN') AS h_label FROM now)"
OLD_CLASS = guard("h_label", joined(*[f"h.{c}" for c in RECORD], "'evidence'"))


def settled(rows: str, order: str) -> str:
    """folded(), with what the fixture's answers say."""
    return folded(rows, order) + f""",
told AS (
  SELECT f.failure_idx, f.failure_id, f.origin, f.source, r.first_idx % 130 - 10 AS fresh_confidence, h.confidence AS old_confidence, e.human_classification AS human, coalesce(h.human_classification, {filled('h.ai_classification')}, 'UNKNOWN') AS old_label,
    {OLD_CLASS} AS old_class, {guard('a.classification', joined('z.error_message', 'z.failed_step_line', *[f'a.{c}' for c in RECORD]))} AS fresh, a.*
  FROM fold f JOIN req r ON r.failure_idx = f.failure_idx JOIN responses a ON a.failure_idx = r.first_idx LEFT JOIN askers z ON z.failure_id = f.failure_id AND z.hash IS NOT DISTINCT FROM f.h LEFT JOIN now e ON e.failure_id = f.failure_id
    LEFT JOIN {HELD} h ON h.failure_id = f.hit WHERE f.rn > 0),
responded AS (
  SELECT failure_idx, failure_id, origin, source, CASE origin WHEN 'HISTORY' THEN old_class WHEN 'ASKED' THEN coalesce(human, fresh) ELSE {guard('again', joined(*RECORD))} END AS classification,
    CAST(CASE WHEN origin = 'HISTORY' THEN old_confidence ELSE fresh_confidence END AS INT) AS confidence
  FROM (SELECT *, coalesce(human, {filled('fresh')}, 'UNKNOWN') AS again FROM told))"""


NETWORK_CUES = ("err_name_not_resolved", "dns", "refused to connect", "err_connection_refused", "err_connection_timed_out")
#: Reports read back from their markup: no feature, the error as stack; rules answer in place of a model, and never saw a picture.
BACK = NOW.replace("WITH ", "WITH RECURSIVE ", 1) + f", back AS (SELECT * REPLACE ({collapse('failed_step_line')} AS failed_step_line, '' AS feature_name, error_message AS stack_trace) FROM failures), " + HEADS.removeprefix(FAILURES + ", ").replace("FROM failures", "FROM back")
BACK += folded("SELECT representative_idx AS failure_idx, false AS forced, report_id AS of_report, group_idx AS of_group FROM heads", "q.of_report, q.of_group", "true", "false", "false")
BACK += f""", said AS (SELECT f.*, {joined('z.error_message', 'z.failed_step_line')} AS words FROM fold f LEFT JOIN askers z ON z.failure_id = f.failure_id AND z.hash IS NOT DISTINCT FROM f.h),
ruled AS (SELECT *, CASE WHEN {cues('words', NETWORK_CUES)} THEN 'NETWORK_ISSUE' WHEN {cues('words', A.CONNECTION_CUES)} THEN 'ENVIRONMENT_ISSUE' WHEN {cues('words', A.LOCATOR_CUES)} AND {cues('words', A.VISIBLE_CUES)} THEN 'AUTOMATION_ISSUE' ELSE 'UNKNOWN' END AS rule FROM said),
responded AS (
  SELECT f.failure_idx, f.origin, CASE WHEN f.origin = 'HISTORY' THEN {OLD_CLASS} WHEN f.origin = 'REPEAT' AND e.human_classification = 'APPLICATION_ISSUE' AND rule = 'AUTOMATION_ISSUE' THEN rule ELSE coalesce(e.human_classification, rule) END AS classification,
    CASE WHEN f.origin = 'HISTORY' THEN h.severity WHEN rule = 'UNKNOWN' THEN 'LOW' WHEN rule = 'AUTOMATION_ISSUE' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN f.origin = 'HISTORY' THEN h.confidence WHEN rule = 'UNKNOWN' THEN 35 ELSE 60 END AS confidence
  FROM ruled f LEFT JOIN now e ON e.failure_id = f.failure_id LEFT JOIN {HELD} h ON h.failure_id = f.hit WHERE f.rn > 0),
investigated AS (SELECT b.*, t.classification, t.severity, t.confidence, '' AS root_cause, true AS investigated FROM back b JOIN groups g USING (report_id, failure_idx) JOIN heads d ON d.report_id = g.report_id AND d.group_idx = g.group_idx JOIN responded t ON t.failure_idx = d.representative_idx)"""
BACK += CLUSTERS.removeprefix(INVESTIGATED)
ENVELOPES = f""", numbered AS (SELECT report_id, 'CLUSTER-' || lpad(CAST(row_number() OVER (PARTITION BY report_id ORDER BY first_idx) AS VARCHAR), 3, '0') AS c, failures FROM clusters),
listed AS (SELECT report_id, count(*) AS total_clusters, sum(failures)::BIGINT AS total_failures, string_agg(c || '=' || CAST(failures AS VARCHAR), ',' ORDER BY c) AS listed FROM numbered GROUP BY report_id),
summed AS (SELECT report_id, {SUMMARY} FROM investigated GROUP BY report_id)"""


def led(threshold: float) -> str:
    """The leader rule, failure by failure: a recursion that carries each report's leaders."""
    part = lambda match, weight: f"CASE WHEN {match} THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    raw = " + ".join((part("x.s <> '' AND x.s = o.step", 0.35), part("x.e = o.exception AND x.e <> 'UNKNOWN'", 0.25), part("x.l = o.locator", 0.25), part("x.h AND o.has_error AND x.b = o.error_body", 0.15)))
    score = f"CASE WHEN x.l <> '' AND o.locator <> '' AND x.l <> o.locator THEN least({raw}, CAST(0.59 AS DOUBLE)) WHEN x.f <> '' AND x.f = o.stack_frame THEN least(CAST(1 AS DOUBLE), {raw} + CAST(0.03 AS DOUBLE)) ELSE {raw} END"
    return PARTS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY failure_idx) AS rn FROM parts),
lead AS (
  SELECT DISTINCT report_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(i BIGINT, s VARCHAR, e VARCHAR, l VARCHAR, b VARCHAR, f VARCHAR, h BOOLEAN)[]) AS heads, CAST(0 AS BIGINT) AS failure_idx, CAST(0 AS BIGINT) AS group_idx FROM parts
  UNION ALL
  SELECT report_id, rn, CASE WHEN best IS NULL THEN heads || [me] ELSE heads END, failure_idx, coalesce(-best.n, failure_idx)
  FROM (SELECT o.report_id, o.rn, p.heads, o.failure_idx, {{'i': o.failure_idx, 's': o.step, 'e': o.exception, 'l': o.locator, 'b': o.error_body, 'f': o.stack_frame, 'h': o.has_error}} AS me,
      list_max(list_filter(list_transform(p.heads, lambda x: {{'v': {score}, 'n': -x.i}}), lambda y: y.v >= {threshold})) AS best
    FROM lead p JOIN ordered o ON o.report_id = p.report_id AND o.rn = p.rn + 1))
SELECT report_id, failure_idx, group_idx FROM lead WHERE rn > 0"""


TRIAGED = HEADS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + (NOW.removeprefix(FAILURES).removeprefix(", ")) + settled("SELECT representative_idx AS failure_idx, false AS forced, report_id AS of_report, group_idx AS of_group FROM heads", "q.of_report, q.of_group")

ORACLE_SQL = {
    "components": PARTS + " SELECT report_id, failure_idx, step, exception, locator, error_body, stack_frame, has_locator, has_error FROM parts",
    "groups": HEADS + " SELECT report_id, group_idx, failure_idx, representative_idx, members FROM groups JOIN heads USING (report_id, group_idx)",
    "groups_at_0_95": PARTS + " SELECT report_id, failure_idx, min(failure_idx) OVER (PARTITION BY report_id, step, exception, locator, error_body, CASE WHEN step = '' OR exception = 'UNKNOWN' OR NOT has_error THEN failure_idx END) AS group_idx FROM parts",
    "groups_at_1_1": FAILURES + " SELECT report_id, failure_idx, failure_idx AS group_idx FROM failures",
    "group_metrics": KEYED + f" SELECT report_id, count(*) AS failures, count(DISTINCT group_idx) AS groups, count(DISTINCT {SIGNATURE}) AS exact_groups, count(DISTINCT group_idx) AS calls, count(*) - count(DISTINCT group_idx) AS calls_avoided FROM groups GROUP BY report_id",
    "pair_scores": PARTS + """, kinds AS (SELECT report_id, step, exception, locator, has_locator, error_body, stack_frame, has_error, min(failure_idx) AS first, count(*) AS n FROM parts WHERE step <> '' GROUP BY ALL),
scored AS (
  SELECT a.report_id, a.first AS a_first, b.first AS b_first, CASE WHEN a.first = b.first THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs, a.exception = b.exception AND a.exception <> 'UNKNOWN' AS exception_match, a.locator = b.locator AS locator_match,
    a.has_error AND b.has_error AND a.error_body = b.error_body AS error_body_match, a.has_locator AND b.has_locator AND a.locator <> b.locator AS conflict, a.stack_frame <> '' AND a.stack_frame = b.stack_frame AS frame
  FROM kinds a JOIN kinds b ON a.report_id = b.report_id AND a.step = b.step AND a.first <= b.first),
raw AS (SELECT *, 0.35 + CASE WHEN exception_match THEN 0.25 ELSE 0 END + CASE WHEN locator_match THEN 0.25 ELSE 0 END + CASE WHEN error_body_match THEN 0.15 ELSE 0 END AS base FROM scored WHERE pairs > 0)
SELECT report_id, a_first, b_first, pairs, true AS step_match, exception_match, locator_match, error_body_match, round(CAST(CASE WHEN conflict THEN least(base, 0.59) WHEN frame THEN least(1.0, base + 0.03) ELSE base END AS DOUBLE), 4) AS score FROM raw""",
    "pair_totals": PARTS + """, scored AS (
  SELECT a.report_id, a.has_error AND b.has_error AND a.error_body = b.error_body AS body, a.has_locator AND b.has_locator AND a.locator <> b.locator AS conflict, a.stack_frame <> '' AND a.stack_frame = b.stack_frame AS frame,
    0.35 + CASE WHEN a.exception = b.exception AND a.exception <> 'UNKNOWN' THEN 0.25 ELSE 0 END + CASE WHEN a.locator = b.locator THEN 0.25 ELSE 0 END AS base
  FROM parts a JOIN parts b ON a.report_id = b.report_id AND a.step = b.step AND a.failure_idx < b.failure_idx AND a.step <> ''),
final AS (SELECT report_id, body, CASE WHEN conflict THEN least(base + CASE WHEN body THEN 0.15 ELSE 0 END, 0.59) WHEN frame THEN least(1.0, base + CASE WHEN body THEN 0.15 ELSE 0 END + 0.03) ELSE base + CASE WHEN body THEN 0.15 ELSE 0 END END AS score FROM scored)
SELECT report_id, count(*) AS pairs, round(CAST(sum(score) AS DOUBLE), 4) AS total, count(*) FILTER (WHERE score >= 0.8) AS alike, count(*) FILTER (WHERE body) AS bodies FROM final GROUP BY report_id""",
    "failure_ids": IDS + f" SELECT failure_idx, failure_id, legacy_id, hash AS screenshot_hash, {SIGNATURE} AS signature FROM ids",
    "feedback_fields": FAILURES + f", f AS (SELECT failure_idx, scenario_name, {step('failed_step_line')} AS normalized_step, substr({squeeze(line1('error_message'))}, 1, 500) AS normalized_error, {exception(BOTH)} AS exception_type, {trim(locator(BOTH))} AS locator, substr({line1('stack_trace')}, 1, 300) AS stack_trace_pattern FROM failures) SELECT *, {DYNAMIC.replace('{c}', 'locator')} AS dynamic, {PATTERN.replace('{c}', 'locator')} AS pattern FROM f",
    "feedback_current": NOW + " SELECT failure_id, ai_classification, root_cause, confidence, CASE WHEN has_ai THEN 'AI' END AS source, human_classification, created, updated, complete FROM now",
    "effective_labels": NOW + " " + EFFECTIVE,
    "match_history": matches("i.failure_idx % 17 = 0") + " " + MATCHED,
    "stream_triage": matches() + " " + MATCHED,
    "legacy_aliases": matches() + " SELECT n.failure_id, 'ALIAS' AS kind, n.seq, w.ai_classification, w.created FROM (SELECT failure_id, min(failure_idx) AS seq, min(legacy_id) AS legacy_id FROM named WHERE matched_by = 'legacy' GROUP BY failure_id) n JOIN now w ON w.failure_id = n.legacy_id",
    "pending": matches() + " SELECT report_id, count(*) AS open, count(DISTINCT failure_id) AS ids FROM named WHERE NOT reusable GROUP BY report_id",
    "resolve_repeats": HEADS + f", ids AS (SELECT failure_idx, {FAILURE_ID} AS failure_id FROM failures) SELECT report_id, group_idx, failure_id, row_number() OVER (PARTITION BY failure_id ORDER BY report_id, group_idx) = 1 AS asks FROM heads JOIN ids ON failure_idx = representative_idx",
    "match_across_reports": NOW + f""", asked AS (SELECT failure_idx, {exception(BOTH)} AS e, {trim(locator(BOTH))} AS loc, {step('failed_step_line')} AS st FROM failures),
pairs AS (
  SELECT a.failure_idx, upper(trim(n.human_classification)) AS label, n.created, n.failure_id FROM asked a JOIN now n ON upper(a.e) = upper(n.exception_type) AND n.human_classification IS NOT NULL AND (
    (a.loc IS NOT NULL AND NOT {DYNAMIC.replace('{c}', 'a.loc')} AND lower(a.loc) = lower(n.locator))
    OR (a.loc IS NOT NULL AND {DYNAMIC.replace('{c}', 'a.loc')} AND n.locator IS NOT NULL AND {PATTERN.replace('{c}', 'a.loc')} = {PATTERN.replace('{c}', 'n.locator')})
    OR ((a.loc IS NULL OR {DYNAMIC.replace('{c}', 'a.loc')}) AND a.st = n.normalized_step)))
SELECT failure_idx, min(label) AS classification, arg_min(failure_id, (created, failure_id)) AS matched_id FROM pairs GROUP BY failure_idx HAVING count(DISTINCT label) = 1""",
    "reused_responses": matches() + f""", used AS (SELECT DISTINCT ON (n.failure_id) n.failure_id, w.* EXCLUDE (failure_id) FROM named n JOIN now w ON w.failure_id = n.hit WHERE n.reusable ORDER BY n.failure_id, n.failure_idx),
labelled AS (SELECT *, coalesce(human_classification, {filled('ai_classification')}, 'UNKNOWN') AS label FROM used)
SELECT failure_id, {guard('label', joined('root_cause', 'recommended_action', 'suggested_fix', 'similar_patterns', 'screenshot_observation', "'evidence'"))} AS classification, ai_classification, human_classification, root_cause, confidence, 'HISTORICAL' AS source FROM labelled""",
    "corrections": CORRECTED + f", labels AS ({EFFECTIVE}) SELECT failure_id, classification, label_source, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason FROM labels UNION ALL SELECT failure_id, label, NULL, seq, reason FROM judged WHERE reason IS NOT NULL",
    "stream_corrections": CORRECTED + " " + EFFECTIVE,
    "stream_dedupe": IDS + " SELECT DISTINCT failure_id FROM ids",
    "cluster_failures": CLUSTERS + f""" SELECT c.report_id, 'CLUSTER-' || lpad(CAST(row_number() OVER (PARTITION BY c.report_id ORDER BY first_idx) AS VARCHAR), 3, '0') AS cluster_id, signature,
  CASE WHEN f.investigated THEN f.feature_name || ' - ' || {trim('f.failed_step_line')} || ' (' || {trim('f.classification')} || ')' END AS cluster_name, f.classification, f.root_cause AS common_root_cause,
  CASE WHEN f.investigated THEN CAST(trunc(mean) AS INT) END AS confidence, CASE WHEN f.investigated THEN ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rank + 1] END AS severity, failures, failure_indexes, {distinct('t')} AS test_case_ids, {distinct('s')} AS scenarios
FROM clusters c JOIN investigated f ON f.failure_idx = c.first_idx""",
    "summarize": INVESTIGATED + f" SELECT report_id, {SUMMARY} FROM investigated GROUP BY report_id",
    "report_totals": CLUSTERS + " SELECT CAST(r AS VARCHAR) AS report_id, coalesce(sum(failures), 0)::BIGINT AS total_failures, count(signature) AS total_clusters FROM range(0, 60) t(r) LEFT JOIN clusters ON report_id = CAST(r AS VARCHAR) GROUP BY r",
    "prompts": matches() + f""", told AS (SELECT n.*, CASE WHEN w.failure_id IS NULL THEN '' ELSE {TOLD.replace('source)', 'w_source)').replace('(source', '(w_source')} END AS told FROM named n LEFT JOIN (SELECT *, CASE WHEN has_ai THEN 'AI' END AS w_source FROM now) w ON w.failure_id = n.hit WHERE NOT n.reusable)
SELECT failure_id, CASE WHEN failure_image <> '' THEN 'vision' ELSE 'text' END AS model, CASE WHEN failure_image <> '' THEN 1000 ELSE 400 END AS max_tokens, {PROMPT} AS prompt FROM told""",
    "guardrail": FAILURES + f""", responses AS ({X.RESPONSES_SQL})
SELECT r.failure_idx, {guard('classification', joined('error_message', 'failed_step_line', 'root_cause', 'recommended_action', 'suggested_fix', 'similar_patterns', 'screenshot_observation', 'stack_trace'))} AS classification,
  CASE WHEN failure_image <> '' AND (screenshot_observation = '' OR contains(lower(screenshot_observation), 'no screenshot')) THEN {q(A.UNSEEN)} ELSE screenshot_observation END AS screenshot_observation
FROM responses r JOIN failures f USING (failure_idx)""",
    "validate_response": f"""WITH responses AS ({X.RESPONSES_SQL}), v AS (SELECT *, CASE WHEN root_cause_type = '' THEN 'UNKNOWN' WHEN root_cause_type IN ('CONFIRMED', 'probable') THEN upper(root_cause_type) ELSE 'POSSIBLE' END AS kind FROM responses)
SELECT failure_idx, CASE WHEN trim(classification) = '' THEN 'UNKNOWN' ELSE classification END AS classification, kind AS root_cause_type, coalesce(severity, 'MEDIUM') AS severity,
  least(greatest(confidence, 0), CASE WHEN kind = 'CONFIRMED' THEN 100 ELSE 80 END) AS confidence, CASE WHEN kind = 'PROBABLE' THEN 'Additional evidence is required to confirm the root cause' ELSE '' END AS missing FROM v""",
    "rule_triage": FAILURES + f""", said AS (SELECT failure_idx, {joined('error_message', 'failed_step_line', 'stack_trace')} AS s FROM failures),
picked AS (SELECT failure_idx, CASE WHEN {cues('s', ('err_name_not_resolved', 'dns', 'refused to connect', 'err_connection_refused', 'err_connection_timed_out'))} THEN 'NETWORK_ISSUE' WHEN {cues('s', A.CONNECTION_CUES)} THEN 'ENVIRONMENT_ISSUE' WHEN {cues('s', A.LOCATOR_CUES)} AND {cues('s', A.VISIBLE_CUES)} THEN 'AUTOMATION_ISSUE' ELSE 'UNKNOWN' END AS classification FROM said)
SELECT CAST(failure_idx AS VARCHAR) AS failure_id, classification, CASE classification WHEN 'UNKNOWN' THEN 'POSSIBLE' ELSE 'PROBABLE' END AS root_cause_type, CASE classification WHEN 'UNKNOWN' THEN 'LOW' WHEN 'AUTOMATION_ISSUE' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE classification WHEN 'UNKNOWN' THEN 35 ELSE 60 END AS confidence FROM picked""",
    "explode_reports": FAILURES + f" SELECT report_id, test_case_id, scenario_name, {collapse('failed_step_line')} AS failed_step_line, coalesce(error_message, '') AS error_message, failure_image, '1. [PASS] open' || chr(10) || '2. [FAIL] ' || {collapse('failed_step_line')} AS all_steps FROM failures",
    "explode_pages": "SELECT CAST(page_id AS VARCHAR) AS report_id, 'P' || CAST(page_id AS VARCHAR) AS test_case_id FROM pages WHERE page_id % 3 = 0",
    "explode_markup": FAILURES + """, shown AS (SELECT report_id, failure_idx, CAST(failure_idx AS VARCHAR) AS n FROM failures WHERE failure_idx % 5 <> 1),
said AS (SELECT *, CASE failure_idx % 4 WHEN 0 THEN 'open page ' || n WHEN 1 THEN 'one two ' || n ELSE 'go to ' || n END AS line, CASE WHEN failure_idx % 3 = 0 THEN 'ERROR' ELSE 'FAIL' END AS mark FROM shown)
SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY failure_idx) - 1 AS failure_idx, 'T' || n AS test_case_id, 'S' || n AS scenario_name, line AS failed_step_line,
  CASE WHEN failure_idx % 4 = 1 THEN '' WHEN failure_idx % 2 = 0 THEN 'E' || n || ': x < y' || chr(10) || 'at a.b' ELSE 'E' || n || ': x < y' END AS error_message, 'i' || n AS failure_image,
  CASE WHEN failure_idx % 4 = 2 THEN '1. [INFO] ' || line || chr(10) || '2. [' || mark || '] ' || line ELSE '1. [' || mark || '] ' || line END AS all_steps
FROM said""",
    "model_call_stats": ANSWERED + " SELECT model, vision, count(*) AS calls, count(*) FILTER (WHERE attempt > 1) AS retries, sum(failure_idx % 300) * 1000 / sum(failure_idx % 1000 + 50) AS tokens_per_s, "
    + ", ".join(f"CAST(sum({e}) AS BIGINT) AS sum_{c}, avg({e}) AS mean_{c}, max({e}) AS max_{c}" for c, e in MEASURED.items()) + " FROM calls GROUP BY ALL",
    "failed_answers": ANSWERED + " SELECT failure_id, 1 AS attempts, CASE failure_idx % 5 WHEN 2 THEN 'no JSON object' ELSE 'not a JSON object' END AS error, true AS cut_from_one FROM calls WHERE attempt = 1 AND failure_idx % 5 IN (2, 3)",
    "clean_answers": ANSWERED + f""", responses AS ({X.RESPONSES_SQL}), asked AS (SELECT failure_id, min({{'e': error_message, 's': failed_step_line, 'i': failure_image}}) AS q FROM ids GROUP BY failure_id),
told AS (SELECT f.failure_id, f.failure_idx, q.e AS error_message, q.s AS failed_step_line, q.i AS image, r.* EXCLUDE (failure_idx) FROM firsts f JOIN asked USING (failure_id) JOIN responses r ON r.failure_idx = f.failure_idx)
SELECT failure_id, CASE WHEN failure_idx % 5 IN (2, 3) THEN 2 ELSE 1 END AS attempt, {guard('classification', joined('error_message', 'failed_step_line', *RECORD))} AS classification, coalesce(severity, '') AS severity, confidence,
  CASE failure_idx % 5 WHEN 1 THEN 0 ELSE 2 END AS evidence, CASE WHEN image <> '' AND failure_idx % 3 <> 2 THEN {q(A.UNSEEN)} ELSE screenshot_observation END AS screenshot_observation FROM told""",
    "explode_tag_soup": FAILURES + """, shown AS (SELECT report_id, failure_idx, CAST(failure_idx AS VARCHAR) AS n FROM failures),
said AS (SELECT *, 'E: List<String> of <' || n || '> </div>' AS e, CASE WHEN failure_idx % 2 = 0 THEN ' shot' ELSE '' END AS shot FROM shown),
told AS (SELECT *, 'go to ' || n || CASE failure_idx % 6 WHEN 4 THEN '' WHEN 3 THEN ' ' || e || ' at a.b' || shot WHEN 5 THEN ' ' || e || ' at a.b' || shot ELSE e || ' at a.b' || shot END AS line FROM said)
SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY failure_idx) - 1 AS failure_idx, 'T' || n AS test_case_id, 'S' || n AS scenario_name, line AS failed_step_line,
  e || chr(10) || 'at a.b' AS error_message, CASE WHEN failure_idx % 2 = 0 THEN 's' || n ELSE '' END AS failure_image, '1. [FAIL] ' || line || chr(10) || '2. [INFO] end' AS all_steps
FROM told""",
    "stream_answers": ANSWERED + f""", responses AS ({X.RESPONSES_SQL}), asked AS (SELECT failure_id, min({{'e': error_message, 's': failed_step_line, 'i': failure_image}}) AS q FROM ids GROUP BY failure_id),
told AS (SELECT f.failure_id, f.failure_idx, q.e AS error_message, q.s AS failed_step_line, q.i AS image, r.* EXCLUDE (failure_idx) FROM firsts f JOIN asked USING (failure_id) JOIN responses r ON r.failure_idx = f.failure_idx)
SELECT failure_id, CASE WHEN failure_idx % 5 IN (2, 3) THEN 2 ELSE 1 END AS attempts, {guard('classification', joined('error_message', 'failed_step_line', *RECORD))} AS classification, coalesce(severity, '') AS severity,
  CASE WHEN image <> '' AND failure_idx % 3 <> 2 THEN {q(A.UNSEEN)} ELSE screenshot_observation END AS screenshot_observation, NULL AS error FROM told WHERE failure_idx % 5 NOT IN (2, 3) OR failure_idx % 4 <> 0
UNION ALL SELECT failure_id, 1, NULL, NULL, NULL, CASE failure_idx % 5 WHEN 2 THEN 'no JSON object' ELSE 'not a JSON object' END FROM firsts WHERE failure_idx % 5 IN (2, 3) AND failure_idx % 4 = 0""",
    "report_envelopes": CLUSTERS + ENVELOPES + f""" SELECT CAST(r AS VARCHAR) AS report_id, coalesce(total_failures, 0) AS total_failures, coalesce(total_clusters, 0) AS total_clusters, coalesce(listed, '') AS listed, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTERS)}
FROM range(0, 60) t(r) LEFT JOIN listed ON listed.report_id = CAST(r AS VARCHAR) LEFT JOIN summed ON summed.report_id = CAST(r AS VARCHAR)""",
    "triage_reports": BACK + ENVELOPES + f" SELECT report_id, total_failures, total_clusters, listed, {', '.join(COUNTERS)} FROM listed JOIN summed USING (report_id)",
    "groups_at_0_60": led(0.60), "groups_at_0_75": led(0.75), "groups_at_0_87": led(0.87),
    "scenario_keys": "SELECT event_id AS failure_idx, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 3 = 0 THEN tc ELSE sc END AS in_report, CASE WHEN event_id % 6 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN tc ELSE sc END AS single FROM (SELECT event_id, 'TC-' || CAST(event_id % 97 AS VARCHAR) AS tc, 'Scenario ' || event_type AS sc FROM events)",
    "report_files": FAILURES + f" SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY failure_idx) - 1 AS failure_idx, test_case_id, scenario_name, {collapse('failed_step_line')} AS failed_step_line, coalesce(error_message, '') AS error_message, '' AS feature_name, '' AS console_logs FROM failures",
    "failure_files": FAILURES + f" SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY failure_idx) - 1 AS failure_idx, {', '.join(S.FAILURE_FIELDS)} FROM failures",
    "triage_requests": NOW.replace("WITH ", "WITH RECURSIVE ", 1) + settled("SELECT failure_idx, failure_idx % 17 = 0 AS forced FROM failures", "i.failure_idx") + " SELECT * FROM responded",
    "triage_failures": TRIAGED + " SELECT g.report_id, g.failure_idx, g.group_idx, t.failure_id, t.origin, t.source, t.classification, t.confidence FROM groups g JOIN heads h USING (report_id, group_idx) JOIN responded t ON t.failure_idx = h.representative_idx",
    "triage_metrics": TRIAGED + f""", callers AS (SELECT t.failure_id, arg_min(h.report_id, (h.report_id, h.group_idx)) AS report_id FROM responded t JOIN heads h ON t.failure_idx = h.representative_idx WHERE origin = 'ASKED' GROUP BY t.failure_id),
made AS (SELECT a.report_id, count(*) AS retries, count(*) FILTER (WHERE first_idx % 5 <> 0) AS text_calls, count(*) FILTER (WHERE first_idx % 5 = 0) AS vision_calls, CAST(sum(2 * (first_idx % 1000 + 50)) AS BIGINT) AS total_ms FROM callers a JOIN firsts USING (failure_id) GROUP BY a.report_id),
each AS (SELECT report_id, count(*) AS failures, count(DISTINCT group_idx) AS groups, count(DISTINCT {SIGNATURE}) AS exact_groups FROM groups GROUP BY report_id)
SELECT e.*, groups AS calls, failures - groups AS calls_avoided, coalesce(retries, 0) AS retries, coalesce(text_calls, 0) AS text_calls, coalesce(vision_calls, 0) AS vision_calls, coalesce(total_ms, 0) AS total_ms FROM each e LEFT JOIN made USING (report_id)""",
    "failure_records": FAILURES + " SELECT report_id, failure_idx, test_case_id AS test_id, scenario_name AS scenario, error_message AS error FROM failures WHERE CAST(report_id AS INT) % 2 = 0",
    "typed_requests": FAILURES + " SELECT failure_idx, CAST(failure_idx AS VARCHAR) AS test_name, feature_name || ', ' || scenario_name AS feature, error_message AS error, CAST(NULL AS VARCHAR) AS scenario, scenario_name AS steps, failure_idx % 2 = 0 AS force_reanalysis FROM failures",
}
ORACLE_SQL["compacted_feedback"] = ORACLE_SQL["feedback_current"]
ORACLE_SQL["exported_feedback"] = ORACLE_SQL["feedback_current"]
ORACLE_SQL["written_envelopes"] = ORACLE_SQL["report_envelopes"]
