from datetime import datetime

import pytest
from pyspark.sql import functions as F

from triagewright import schemas as S
from triagewright.functions import text as T
from triagewright.operators import answers as A
from triagewright.operators import history as H
from triagewright.operators import store
from triagewright.plans import jobs as J
from triagewright.streaming import jobs as ST

IMAGE = "data:image/png;base64,abc"


def at(n):
    return datetime.fromtimestamp(1_700_000_000 + n)


def log(spark, events):
    """events: (failure_id, kind, n, other columns)"""
    rows = [{"failure_id": i, "kind": k, "event_time": at(n), "created_at": at(n), "seq": n, **more} for i, k, n, more in events]
    schema = spark.createDataFrame([], S.FEEDBACK_LOG).schema
    return spark.createDataFrame([[r.get(f.name) for f in schema] for r in rows], schema)


FULL = {
    "ai_classification": "API_ISSUE", "root_cause": "The service said no", "root_cause_type": "PROBABLE", "severity": "HIGH", "recommended_action": "", "suggested_fix": "",
    "similar_patterns": "", "screenshot_observation": "a screen", "source": "AI", "evidence": [], "missing_evidence": [], "steps_to_reproduce": [], "prevention_tips": [], "confidence": 70,
}


def request(spark, step="tap", error="a.TimeoutException: 5", image="", force=False, scenario="s"):
    r = spark.createDataFrame([("t", "f", scenario, step, error, None, "", image, "", "EXTENT", "", force, 1)], ", ".join(f"{c} string" for c in S.REQUEST_FIELDS) + ", force_reanalysis boolean, seq long")
    return H.with_ids(r)


def outcome(spark, r, more, identity="failure_id"):
    i = r.first()[identity]
    m = H.match_history(r, H.feedback_current(log(spark, [(i, "AI", 1, {**FULL, **more})]))).first()
    return m.matched_by, m.source


def test_human_label_survives_and_late_events_converge(spark):
    now = H.feedback_current(log(spark, [("a", "AI", 1, FULL), ("a", "HUMAN", 5, {"human_classification": "DATA_ISSUE"}), ("a", "HUMAN", 3, {"human_classification": "UNKNOWN"}), ("a", "AI", 9, {**FULL, "ai_classification": "UNKNOWN", "root_cause": None}), ("", "AI", 1, FULL), ("h", "HUMAN", 2, {"human_classification": "API_ISSUE"})]))
    got = {r.failure_id: r for r in now.collect()}
    assert set(got) == {"a", "h"}
    assert (got["a"].human_classification, got["a"].ai_classification, got["a"].root_cause) == ("DATA_ISSUE", "UNKNOWN", None)
    assert got["a"].created_at == at(1) and got["a"].updated_at == at(9)
    assert (got["h"].human_classification, got["h"].ai_classification) == ("API_ISSUE", None)


def test_alias_counts_only_as_first_event(spark):
    alias = {**FULL, "human_classification": "DATA_ISSUE", "created_at": at(-50)}
    now = {r.failure_id: r for r in H.feedback_current(log(spark, [("a", "ALIAS", 2, alias), ("a", "AI", 4, {**FULL, "root_cause": "new"}), ("b", "AI", 1, FULL), ("b", "ALIAS", 2, alias)])).collect()}
    assert (now["a"].human_classification, now["a"].root_cause, now["a"].created_at) == ("DATA_ISSUE", "new", at(-50))
    assert now["b"].human_classification is None and now["b"].created_at == at(1)


@pytest.mark.parametrize(
    "image, more, want",
    [
        ("", {}, "HISTORICAL"),
        ("", {"screenshot_observation": " "}, "HISTORICAL"),
        ("", {"root_cause": " "}, "AI_ENRICHED"),
        ("", {"root_cause": "There may be a network issue here"}, "AI_ENRICHED"),
        ("", {"evidence": None}, "AI_ENRICHED"),
        (IMAGE, {"screenshot_hash": None}, "AI_ENRICHED"),
        (IMAGE, {"screenshot_hash": "other"}, "AI_ENRICHED"),
        (IMAGE, {"screenshot_hash": "same"}, "HISTORICAL"),
        (IMAGE, {"screenshot_hash": "same", "screenshot_observation": ""}, "AI_ENRICHED"),
    ],
)
def test_reuse(spark, image, more, want):
    if more.get("screenshot_hash") == "same":
        more = {**more, "screenshot_hash": spark.range(1).select(T.screenshot_hash(F.lit(IMAGE)).alias("h")).first().h.upper()}
    assert outcome(spark, request(spark, image=image), more) == ("exact", want)


def test_legacy_and_forced(spark):
    r = request(spark)
    assert outcome(spark, r, {}, "legacy_id") == ("legacy", "HISTORICAL")
    assert outcome(spark, request(spark, force=True), {}) == (None, "AI")
    feedback = H.feedback_current(log(spark, [(r.first().legacy_id, "AI", 1, FULL)]))
    alias = H.aliases(H.match_history(r, feedback), feedback, F.lit(at(5)), "seq").collect()
    assert [(x.failure_id, x.kind, x.root_cause, x.created_at) for x in alias] == [(r.first().failure_id, "ALIAS", FULL["root_cause"], at(1))]


def test_guardrail_on_reused_labels(spark):
    words = {"ai_classification": "APPLICATION_ISSUE", "root_cause": "The locator is wrong, the button is visible"}
    r = request(spark)
    for more, guard, want in (({}, True, "AUTOMATION_ISSUE"), ({"root_cause": "Visible locator, but a 502 page"}, True, "APPLICATION_ISSUE"), ({}, False, "APPLICATION_ISSUE")):
        m = H.match_history(r, H.feedback_current(log(spark, [(r.first().failure_id, "AI", 1, {**FULL, **words, **more})])))
        assert A.reused_responses(m, "seq", guard).first().classification == want


def test_corrections(spark):
    rows = [("a", " data_issue ", at(3), 3), (" ", "API_ISSUE", at(3), 4), ("b", "", at(3), 5), ("c", "NOPE", at(3), 6), ("d", "UNKNOWN", at(3), 7)]
    out = J.apply_corrections(spark.createDataFrame(rows, S.CORRECTIONS), log(spark, [("a", "AI", 1, FULL)]))
    labels = {r.failure_id: (r.classification, r.label_source, r.ai_classification) for r in out["labels"].collect()}
    assert labels == {"a": ("DATA_ISSUE", "HUMAN_CORRECTED", "API_ISSUE"), "d": ("UNKNOWN", "HUMAN_CORRECTED", None)}
    assert sorted(r.reason for r in out["rejects"].collect()) == ["blank classification", "blank failure id", "unknown classification"]


def test_matches_across_reports(spark):
    base = {"exception_type": "TimeoutException", "locator": "save", "normalized_step": "tap", "human_classification": None}
    ai = lambda i, n, **more: (i, "AI", n, {**FULL, **base, **more})
    human = lambda i, n, label: (i, "HUMAN", n, {"human_classification": label})
    feedback = H.feedback_current(log(spark, [ai("a", 1), human("a", 2, "API_ISSUE"), ai("b", 3, locator="card_1234", normalized_step="x"), human("b", 4, "DATA_ISSUE"), ai("c", 5, locator=None, normalized_step="swipe"), human("c", 6, "UNKNOWN"), ai("d", 7, locator=None, normalized_step="swipe"), human("d", 8, "API_ISSUE"), ai("e", 9, locator="later")]))
    ask = lambda error, step="And tap": [(r.classification, r.matched_id) for r in H.match_across_reports(request(spark, step, error), feedback, "seq").collect()]
    assert ask("a.TimeoutException resource-id=SAVE") == [("API_ISSUE", "a")]
    assert ask("a.TimeoutException resource-id=card_9999", "other") == [("DATA_ISSUE", "b")]
    assert ask("a.TimeoutException resource-id=card_9999", "tap") == []  # pattern and step disagree
    assert ask("a.TimeoutException", "Then Swipe") == []  # two labels
    assert ask("a.TimeoutException", "tap") == [("API_ISSUE", "a")]
    assert ask("no exception resource-id=save") == [] and ask("a.OtherException resource-id=save") == []


def test_old_rows_and_exports(spark, tmp_path):
    old = spark.createDataFrame([("a", "AI", at(1), 1, "API_ISSUE")], "failure_id string, kind string, event_time timestamp, seq long, ai_classification string")
    assert H.evolve_feedback(old).first().evidence is None
    back = H.import_feedback(H.export_feedback(log(spark, [("a", "AI", 1, {**FULL, "evidence": ["x", "y"]})])))
    assert back.first().evidence == ["x", "y"] and back.first().event_time == at(1)
    bad = spark.createDataFrame([("not json", " ")], "evidence string, missing_evidence string")
    assert tuple(H.import_feedback(bad).first()) == (None, None)
    H.write_feedback(old, str(tmp_path / "log"))
    H.write_feedback(log(spark, [("b", "HUMAN", 90_000, {"human_classification": "UNKNOWN"})]), str(tmp_path / "log"))
    assert H.read_feedback(spark, str(tmp_path / "log")).count() == 2


def test_repeats(spark):
    groups = spark.createDataFrame([("r1", 0, "a"), ("r1", 4, "b"), ("r2", 1, "a")], "report_id string, group_idx long, failure_id string")
    got = {(r.report_id, r.group_idx): r.asks for r in H.resolve_repeats(groups, ["report_id", "group_idx"]).collect()}
    assert got == {("r1", 0): True, ("r1", 4): True, ("r2", 1): False}


def test_streams(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    r = request(spark).drop("failure_id", "legacy_id")
    r.write.parquet(p("in"))
    store.append(log(spark, [(request(spark).first().failure_id, "AI", 1, FULL)]), p("log"))
    stream = spark.readStream.schema(r.schema).parquet(p("in"))
    ST.stream_triage(stream, p("log"), p("matched"), p("prompts"), p("state")).awaitTermination()
    assert spark.read.parquet(p("matched")).first().source == "HISTORICAL" and spark.read.schema("failure_id string").parquet(p("prompts")).count() == 0
    c = spark.createDataFrame([(request(spark).first().failure_id, "UNKNOWN", at(9), 9), ("", "UNKNOWN", at(9), 9)], S.CORRECTIONS)
    c.write.parquet(p("corrections"))
    ST.stream_corrections(spark.readStream.schema(c.schema).parquet(p("corrections")), p("log"), p("rejects"), p("state2")).awaitTermination()
    assert H.effective_label(store.current(spark, p("log"))).first().classification == "UNKNOWN"
    assert spark.read.parquet(p("rejects")).count() == 1
