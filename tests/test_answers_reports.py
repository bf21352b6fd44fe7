import json

import pytest
from pyspark.sql import functions as F

from triagewright import schemas as S
from triagewright.operators import answers as A
from triagewright.operators import clusters as C
from triagewright.operators import prompts as P
from triagewright.plans import jobs as J
from triagewright.operators import history as H
from triagewright.sources import reports as R

GOOD = {"classification": "API_ISSUE", "rootCauseType": "PROBABLE", "rootCause": "x", "confidence": 70.9, "evidence": ["a", {"message": "m"}, 3, [1, "b"]], "severity": "HIGH", "missingEvidence": "one", "suggestedFix": {"k": 1}, "recommendedAction": ["p", "q"]}


@pytest.mark.parametrize(
    "cut, want",
    [
        ('{"a": 1', {"a": 1}),
        ('{"a": "b', {"a": "b"}),
        ('{"a": "b\\', {"a": "b"}),
        ('{"a": ["x", ', {"a": ["x"]}),
        ('{"a": [{"b": "c}', {"a": [{"b": "c}"}]}),
        ('{"a": "say \\"hi\\" now", "b": [1', {"a": 'say "hi" now', "b": [1]}),
        ('{"a": 1}', {"a": 1}),
    ],
)
def test_closing_cut_json(cut, want):
    assert json.loads(A.close_json(cut)) == want


def answers(spark, rows):
    return spark.createDataFrame([(i, n, raw, "m", False, 10, 5, 5) for i, n, raw in rows], S.ANSWERS)


def requests(spark, image="", error="e"):
    return spark.createDataFrame([(i, error, "tap", image) for i in "abcdefg"], "failure_id string, error string, failed_step string, failure_image string")


def test_cleaning(spark):
    rows = [
        ("a", 1, "```json\n" + json.dumps(GOOD) + "\n``` trailing"), ("b", 1, "nothing"), ("b", 2, json.dumps({"confidence": "90", "evidence": None})), ("c", 1, ""), ("c", 2, "[1]"),
        ("d", 1, json.dumps(GOOD)[:60]), ("e", 1, None), ("f", 3, json.dumps(GOOD)), ("a", 2, json.dumps({**GOOD, "severity": "LOW"})),
    ]
    told, bad = A.clean_answers(answers(spark, rows), requests(spark))
    got = {r.failure_id: r for r in told.collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a.confidence, a.severity, a.evidence, a.missing_evidence, a.recommended_action, a.suggested_fix) == (70, "HIGH", ["a", "m", "3", "1; b"], ["one"], "p; q", '{"k":1}')
    assert (got["b"].attempt, got["b"].confidence, got["b"].classification, got["b"].evidence) == (2, 0, "", [])
    assert {r.failure_id: r.error for r in bad.collect()} == {"c": "no JSON object", "e": "empty answer"}
    assert A.clean_answers(answers(spark, []), requests(spark))[0].collect() == []


def test_screenshot_and_guardrail(spark):
    said = {"classification": "APPLICATION_ISSUE", "screenshotObservation": "No screenshot provided", "rootCause": "Unable to locate it, though the button is visible"}
    told = A.clean_answers(answers(spark, [("a", 1, json.dumps(said))]), requests(spark, "data:image/png;base64,x"))[0].first()
    assert told.screenshot_observation == A.UNSEEN and told.classification == "AUTOMATION_ISSUE"
    told = A.clean_answers(answers(spark, [("a", 1, json.dumps(said))]), requests(spark, error="gateway"))[0].first()
    assert told.screenshot_observation == "No screenshot provided" and told.classification == "APPLICATION_ISSUE"


def test_validation(spark):
    rows = [(None, "", 95, None, []), ("X", "probable", -4, "LOW", None), ("X", "CONFIRMED", 130, "LOW", ["m"]), ("X", "odd", 99, " ", [])]
    df = spark.createDataFrame(rows, "classification string, root_cause_type string, confidence int, severity string, missing_evidence array<string>")
    got = [(r.classification, r.root_cause_type, r.confidence, r.severity, len(r.missing_evidence or [])) for r in A.validate_response(df).collect()]
    assert got == [("UNKNOWN", "UNKNOWN", 80, "MEDIUM", 0), ("X", "PROBABLE", 0, "LOW", 1), ("X", "CONFIRMED", 100, "LOW", 1), ("X", "POSSIBLE", 80, "MEDIUM", 0)]


def test_rules(spark):
    rows = [("a", "net::ERR_CONNECTION_REFUSED"), ("b", "502 gateway"), ("c", "unable to locate, element is visible"), ("d", None)]
    df = spark.createDataFrame([(i, e, "tap", None, "") for i, e in rows], "failure_id string, error string, failed_step string, stack_trace string, console_logs string")
    assert [r.classification for r in A.rule_triage(df).orderBy("failure_id").collect()] == ["NETWORK_ISSUE", "ENVIRONMENT_ISSUE", "AUTOMATION_ISSUE", "UNKNOWN"]


HTML = """<html><ul>
<li class="test-item x" status="FAIL" test-id=" TC-1 "><div class="test-detail"><p class="name"> A &amp; B
 c</p></div><ul>
 <li class="step pass-bg"><span>open  it</span></li><li class="step"><span> </span></li><li class="step skip-bg">later<br>on</li>
 <li class="step fail-bg"><span>tap <b>now</b></span><span>no</span><textarea class="code-block">
E &lt;x&gt;  \r\n at y\t
</textarea><div class="screenshots"><a href="shot.png">s</a></div><img src="i.png"><video><source src=" v.mp4 "></video></li></ul></li>
<li class="test-item" status="pass"><div class="step fail-bg"><span>z</span></div></li>
<li class="test-item" status="error"><div class="step pass-bg">fine</div></li>
<li class="test-item" status="error" test-id="TC-4"><div class="step error-bg">only text</div></li>
</ul>"""


def test_extraction(spark):
    reports = spark.createDataFrame([("r", "extent", HTML), ("n", "EXTENT", None), ("e", "EXTENT", "<p>none"), ("o", "OTHER", HTML)], S.REPORTS)
    got = R.explode_reports(reports.where("report_id <> 'o'")).orderBy("failure_idx").collect()
    assert [(r.report_id, r.failure_idx, r.test_case_id) for r in got] == [("r", 0, "TC-1"), ("r", 1, "TC-4")]
    a, b = got
    assert (a.scenario_name, a.failed_step_line, a.error_message, a.failure_image, a.video_url) == ("A & B c", "tap now", "E <x>\n at y", "shot.png", "v.mp4")
    assert a.stack_trace == a.error_message and a.feature_name == a.console_logs == ""
    assert a.all_steps == "1. [PASS] open it\n2. [SKIP] later on\n3. [FAIL] tap now"
    assert (b.failed_step_line, b.error_message, b.failure_image, b.all_steps) == ("only text", "", "", "1. [ERROR] only text")
    records = R.to_failure_records(R.explode_reports(reports), reports)
    assert {r.report_id for r in records.collect()} == {"r"} and len(records.columns) == 10


NESTED = """<div id="screenshots-of-all" class="screenshots"><li class="test-item" status="fail" test-id="N1">
<div class="test-detail"><h3 class="name">one<br/>two</h3></div>
<div class="step info"><p>outer</p><div class="step fail-bg"><div>in</div><div>ner</div><textarea class="code-block" value="from value">  </textarea></div>tail</div>
<li class="test-item" status="Error" test-id="N2"><div class="step error-bg"><span>A<br>B</span><b><img src="a.png" href="b"></b><a href="c.png">x</a>
<li class="test-item" status="error" test-id="N3"><p class="step error-bg">x<b>y</i></b>z<textarea class="code-block">a &amp; b\n\n  c  </textarea><video><source><source src="2"></video></p></li></div>"""


def test_markup_of_other_forms():
    got = list(R.failed_tests(NESTED))
    flat = lambda t: " ".join(t.split())
    assert [t["test_case_id"] for t in got] == ["N1", "N2", "N3"]
    a, b, c = got
    assert (flat(a["scenario_name"]), flat(a["failed_step_line"]), a["error_message"]) == ("one two", "in ner", "from value")
    assert [(s["status"], flat(s["text"])) for s in a["steps"]] == [("INFO", "outer in ner tail"), ("FAIL", "in ner")]
    assert (flat(b["failed_step_line"]), b["failure_image"], b["error_message"]) == ("A B", "a.png", "")
    assert (flat(c["failed_step_line"]), c["error_message"], c["failure_image"], c["video_url"]) == ("xyza & b c", "a & b\n\n  c  ", "", "")
    assert list(R.failed_tests("<li class=test-item status=fail><div class=step>x</div>")) == list(R.failed_tests("")) == []


def test_lists_of_any_depth(spark):
    deep = json.dumps({"error": [[[[["x", [" ", "y"]]]]], 2], "feature": [], "testName": {"a": [1]}})
    r = R.parse_requests(spark.createDataFrame([(deep,), ("[1]",), (None,)], "value string")).collect()
    assert (r[0].error, r[0].feature, r[0].test_name) == ("x, y, 2", "", '{"a":[1]}') and r[1].error is r[2].error is None
    told = A.normalize_response(json.dumps({"rootCause": [[[[["x", "y"]]]]], "severity": [None, "a", None], "suggestedFix": {"message": [1]}, "evidence": [{"message": None}, 1.5, True, {"k": "é"}], "confidence": 1e10}))
    assert (told["root_cause"], told["severity"], told["suggested_fix"], told["evidence"], told["confidence"]) == ("x; y", "a; ", "", ["null", "1.5", "true", '{"k":"é"}'], 0)
    assert A.normalize_response('{"confidence": NaN}') is None and A.normalize_response("[1]") is None


def test_repeated_answers_give_the_same_choice(spark):
    rows = [("a", 1, json.dumps({"severity": s})) for s in ("HIGH", "LOW", "MEDIUM")]
    asked = spark.createDataFrame([("a", e, "tap", i) for e, i in (("b", "x"), ("a", "y"), ("c", None))], "failure_id string, error string, failed_step string, failure_image string")
    one = A.clean_answers(answers(spark, rows).repartition(3), asked.repartition(2))[0].first()
    two = A.clean_answers(answers(spark, rows[::-1]).coalesce(1), asked.coalesce(1))[0].first()
    assert one == two


def test_files(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text(HTML)
    assert R.explode_reports(R.read_reports(spark, str(tmp_path / "html"))).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(json.dumps({"failures": [{"test_case_id": "1"}, {"error_message": "x"}]}))
    (tmp_path / "f" / "b.json").write_text(json.dumps({"failures": None}))
    assert [(r.failure_idx, r.test_case_id, r.error_message) for r in R.read_failures_json(spark, str(tmp_path / "f")).orderBy("failure_idx").collect()] == [(0, "1", None), (1, None, "x")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"testName": 5, "error": ["a", " ", ["b", 2]], "feature": True, "scenario": None, "consoleLogs": {"k": 1}, "allStepsDetail": ["s", {"text": "t"}, {"raw": "w"}], "forceReanalysis": True}))
    r = R.read_requests_json(spark, str(tmp_path / "r")).first()
    assert (r.test_name, r.error, r.feature, r.scenario, r.console_logs, r.all_steps_detail, r.force_reanalysis) == ("5", "a, b, 2", "true", None, '{"k":1}', ["s", "t", "w"], True)


def test_prompts_never_hold_the_picture(spark):
    image = "data:image/png;base64,AAAA"
    base = dict(test_name="t", report_type="EXTENT", feature=" ", scenario="s", all_steps="1. a", failed_step="tap", error="E" * 3000, stack_trace=None, console_logs=None, video_url="", failure_image=image, failure_id="i", matched_by=None)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base)).withColumns({f"fb_{c}": F.lit(None).cast("string") for _, c in P.HISTORY})
    r = P.build_prompts(df).first()
    assert "AAAA" not in r.prompt and P.WITH_IMAGE in r.prompt and r.route.model == "vision" and "[TRUNCATED]" in r.prompt and "--- Feature ---\nNOT PROVIDED" in r.prompt
    known = df.withColumns({"matched_by": F.lit("exact"), "fb_source": F.lit(" AI "), "failure_image": F.lit("")})
    r = P.build_prompts(known).first()
    assert "Previous Source: AI" in r.prompt and P.NO_IMAGE in r.prompt and r.route.format == "json"


def test_clusters_and_summary(spark, tmp_path):
    rows = [
        ("r", 0, "TC-1", "one", "F", "Tap!", "wait 30 seconds", "API_ISSUE", "why", "low", 41, True), ("r", 1, "TC-2", "one", "f", "tap", "wait 60 seconds", "API_ISSUE", "b", "Critical", 50, True),
        ("r", 2, "TC-2", " ", "f", "tap", "wait 60 seconds", None, None, None, None, False), ("r", 3, "TC-2", "x", None, "tap", None, "odd", "c", "none", 10, True),
    ]
    df = spark.createDataFrame(rows, "report_id string, failure_idx long, test_case_id string, scenario_name string, feature_name string, failed_step_line string, error_message string, classification string, root_cause string, severity string, confidence int, investigated boolean")
    got = C.cluster_failures(df).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.failure_indexes, r.severity, r.confidence, r.cluster_name) for r in got] == [
        ("CLUSTER-001", [0, 1], "CRITICAL", 45, "F - Tap! (API_ISSUE)"), ("CLUSTER-002", [2], None, None, None), ("CLUSTER-003", [3], "LOW", 10, "tap (odd)"),
    ]
    assert got[0].test_case_ids == ["TC-1", "TC-2"] and got[0].scenarios == ["one"] and got[0].common_root_cause == "why" and got[1].scenarios == []
    s = C.summarize(df).first()
    assert (s.api_issues, s.unknown_issues, s.critical_severity, s.low_severity, s.high_severity) == (2, 1, 1, 1, 0)
    reports = spark.createDataFrame([("r",), ("empty",)], "report_id string")
    out = {r.report_id: r for r in C.report_envelopes(reports, df, C.cluster_failures(df)).collect()}
    assert (out["r"].total_failures, out["r"].total_clusters, len(out["r"].clusters)) == (4, 3, 3)
    C.write_envelopes(C.report_envelopes(reports, df, C.cluster_failures(df)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("report_id = 'r'").first().clusters[0].cluster_id == "CLUSTER-001"
    assert (out["empty"].total_failures, out["empty"].clusters, out["empty"].summary.api_issues) == (0, [], 0)


def test_reports_end_to_end(spark):
    reports = spark.createDataFrame([("r", "EXTENT", HTML), ("o", "OTHER", HTML), ("e", "EXTENT", "")], S.REPORTS)
    empty = H.feedback_current(spark.createDataFrame([], S.FEEDBACK_LOG))
    out = J.triage_reports(reports, empty)
    assert {r.report_id: (r.total_failures, r.total_clusters) for r in out["envelopes"].collect()} == {"r": (2, 2), "o": (0, 0), "e": (0, 0)}
    now = H.feedback_current(out["events"])
    assert now.count() == 2
    ids = [r.failure_id for r in out["prompts"].collect()]
    told = [(i, 1, json.dumps({**GOOD, "screenshotObservation": "seen", "similarPatterns": "n", "stepsToReproduce": [], "preventionTips": []})) for i in ids]
    first = J.triage_reports(reports, empty, answers(spark, told))
    again = J.triage_reports(reports, H.feedback_current(first["events"]), answers(spark, []))
    assert {r.source for r in again["investigated"].collect()} == {"HISTORICAL"} and again["prompts"].count() == 0
    assert all(r.classification == "API_ISSUE" for r in again["investigated"].collect())


def test_call_sketches_merge_and_stay_close(spark):
    """Sketches of ten days, merged: each quantile's rank is within a hundredth of the asked one; sums are those of single days."""
    n = 20_000
    calls = spark.range(n).select(F.lit("i").alias("failure_id"), F.lit(1).alias("attempt"), F.lit("m").alias("model"), F.lit(False).alias("vision"), (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("http_ms"), (F.col("id") % 10).alias("day"), F.lit(5).alias("output_tokens"))
    got = {(r.measure, round(r.q, 2)): r.value for r in A.call_quantiles(A.call_sketches(calls, "day")).collect()}
    assert {m for m, _ in got} == {"http_ms", "output_tokens"}
    for q in A.QUANTILES:
        assert abs(calls.where(F.col("http_ms") <= got["http_ms", q]).count() / n - q) < 0.01
        assert got["output_tokens", q] == 5
    stats = A.model_call_stats(calls).first()
    assert (stats.calls, stats.sum_output_tokens, stats.sum_prompt_chars) == (n, 5 * n, None) and stats.sum_total_ms == stats.sum_http_ms
