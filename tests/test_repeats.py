"""Requests that share an id: as if done one after the other."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_history import FULL, at, log
from triagewright import schemas as S
from triagewright.functions import text as T
from triagewright.operators import answers as A
from triagewright.operators import history as H
from triagewright.operators import repeats as E
from triagewright.plans import jobs as J

PICTURES = ["", "data:image/png;base64,A", "data:image/png;base64,B"]
COLUMNS = ", ".join(f"{c} string" for c in S.REQUEST_FIELDS) + ", force_reanalysis boolean, event_time timestamp, seq long"


def requests(spark, rows):
    """rows: (step, scenario, picture, forced), in order."""
    data = [("t", "f", scenario, step, "a.TimeoutException: 5", None, "", image, "", "EXTENT", "", forced, at(i), i) for i, (step, scenario, image, forced) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def hashes(spark):
    got = spark.createDataFrame([(p,) for p in PICTURES], "p string").select("p", E.picture(F.col("p")).alias("h")).collect()
    return {r.p: r.h for r in got}


def one_by_one(rows, ids, past, told, image_of):
    """(origin, record, source) of each request. past: records by id, told: (complete, seen) by id and picture."""
    records, out = {i: dict(r, own=False) for i, r in past.items()}, []
    for (_, _, image, forced), (new, old) in zip(rows, ids):
        h, found = image_of[image], False
        if not forced:
            if new not in records and old in past:
                records[new] = dict(past[old], own=False)
            found = new in records
            r = records.get(new)
            if r and r["complete"] and (h is None or (r["seen"] and r["picture"] == h)):
                out.append(("REPEAT" if r["own"] else "HISTORY", r["picture"] if r["own"] else None, "HISTORICAL"))
                continue
        out.append(("ASKED", h, "AI_ENRICHED" if found else "AI"))
        if (new, h) in told:
            complete, seen = told[new, h]
            records[new] = {"complete": complete, "seen": seen, "picture": h, "own": True}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_settled_as_one_by_one(spark, seed):
    rng, image_of = random.Random(seed), hashes(spark)
    steps = [f"tap {c}" for c in "abcdefghijkl"]
    rows = [(rng.choice(steps), rng.choice(["s1", "s2"]), rng.choice(PICTURES), rng.random() < 0.1) for _ in range(240)]
    df = H.with_ids(requests(spark, rows))
    ids = [(r.failure_id, r.legacy_id) for r in df.orderBy("seq").collect()]
    events, past = [], {}
    for n, i in enumerate(sorted({x for pair in ids for x in pair})):
        if rng.random() < 0.35:
            picture, complete, seen = rng.choice(PICTURES), rng.random() < 0.7, rng.random() < 0.7
            past[i] = {"complete": complete, "seen": seen, "picture": image_of[picture]}
            events.append((i, "AI", n, {**FULL, "root_cause": "x" if complete else "", "screenshot_observation": "s" if seen else "", "screenshot_hash": image_of[picture]}))
    told = {(i, h): (rng.random() < 0.6, rng.random() < 0.8) for i in {x for x, _ in ids} for h in image_of.values() if rng.random() < 0.75}
    feedback = H.feedback_current(log(spark, events))
    answered = spark.createDataFrame([(*k, *v) for k, v in told.items()], "failure_id string, picture string, complete boolean, seen boolean")
    got = {r.seq: (r.origin, r.record, r.source) for r in E.settle(H.match_history(df, feedback), answered, ["seq"]).collect()}
    assert [got[i] for i in range(len(rows))] == one_by_one(rows, ids, past, told, image_of)


def answer(spark, rows):
    """rows: (failure_id, picture hash, attempt, text, ms)"""
    data = [(i, n, text, "m", h is not None, ms, 10, 5, h) for i, h, n, text, ms in rows]
    return spark.createDataFrame(data, S.ANSWERS + ", screenshot_hash string")


def said(label, cause="It broke in a new way"):
    return json.dumps({"classification": label, "rootCause": cause, "rootCauseType": "PROBABLE", "severity": "HIGH", "confidence": 50, "screenshotObservation": "a page"})


def failures(spark, rows):
    """rows: (report, index, picture)"""
    data = [(r, i, "T", "s", "tap x", f"a.TimeoutException: resource-id=card_{i + 1000}", p, "", "f", None, "", "") for r, i, p in rows]
    return spark.createDataFrame(data, S.FAILURES)


def test_another_picture_is_asked_again(spark):
    image_of = hashes(spark)
    f = failures(spark, [("r1", 0, PICTURES[1]), ("r2", 0, PICTURES[2])])
    i = f.select(T.failure_id(F.col("failed_step_line"), F.col("error_message"))).first()[0]
    told = answer(spark, [(i, image_of[PICTURES[1]], 1, "nothing", 200), (i, image_of[PICTURES[1]], 2, said("API_ISSUE"), 150), (i, image_of[PICTURES[2]], 1, said("DATA_ISSUE"), 70)])
    out = J.triage_failures(f, H.feedback_current(log(spark, [])), told)
    got = {r.report_id: (r.source, r.classification, r.origin) for r in out["investigated"].collect()}
    assert got == {"r1": ("AI", "API_ISSUE", "ASKED"), "r2": ("AI_ENRICHED", "DATA_ISSUE", "ASKED")}
    metrics = {r.report_id: (r.calls, r.retries, r.vision_calls, r.total_ms) for r in out["metrics"].collect()}
    assert metrics == {"r1": (1, 1, 1, 350), "r2": (1, 0, 1, 70)}
    assert out["prompts"].count() == 2 and out["events"].where("kind = 'AI'").count() == 2


def test_three_groups_ask_three_times_and_calls_count_once(spark):
    """Pictures A, B, A: three asks; the third has no call of its own. Then one without picture finds what was recorded last."""
    image_of = hashes(spark)
    f = failures(spark, [("r1", 0, PICTURES[1]), ("r1", 1, PICTURES[2]), ("r1", 2, PICTURES[1]), ("r2", 3, "")])
    i = f.select(T.failure_id(F.col("failed_step_line"), F.col("error_message"))).first()[0]
    told = answer(spark, [(i, image_of[PICTURES[1]], 1, said("API_ISSUE"), 5), (i, image_of[PICTURES[2]], 1, said("DATA_ISSUE"), 7), ("other", None, 1, said("DATA_ISSUE"), 7)])
    out = J.triage_failures(f, H.feedback_current(log(spark, [])), told)
    got = {(r.report_id, r.failure_idx): (r.origin, r.source, r.classification) for r in out["investigated"].collect()}
    assert got == {
        ("r1", 0): ("ASKED", "AI", "API_ISSUE"), ("r1", 1): ("ASKED", "AI_ENRICHED", "DATA_ISSUE"), ("r1", 2): ("ASKED", "AI_ENRICHED", "API_ISSUE"), ("r2", 3): ("REPEAT", "HISTORICAL", "API_ISSUE"),
    }
    asked = told.join(out["calls"].select("failure_id").distinct(), "failure_id")
    assert out["calls"].count() == 2
    assert out["metrics"].agg(F.sum("total_ms")).first()[0] == A.model_call_stats(asked).agg(F.sum("total_ms")).first()[0] == 12
    assert out["events"].where("kind = 'AI'").count() == 3


def test_an_answer_without_picture_serves_any_and_bad_ones_are_told(spark):
    f = failures(spark, [("r1", 0, PICTURES[1]), ("r1", 1, PICTURES[2]), ("r1", 2, PICTURES[2])])
    i = f.select(T.failure_id(F.col("failed_step_line"), F.col("error_message"))).first()[0]
    empty = H.feedback_current(log(spark, []))
    out = J.triage_failures(f, empty, answer(spark, [(i, None, 1, said("API_ISSUE"), 5)]))
    assert [(r.failure_idx, r.origin) for r in out["investigated"].orderBy("failure_idx").collect()] == [(0, "ASKED"), (1, "ASKED"), (2, "REPEAT")]
    out = J.triage_failures(f, empty, answer(spark, [(i, None, 1, "no", 5), (i, None, 2, "no", 5)]))
    assert {(r.origin, r.source, r.investigated) for r in out["investigated"].collect()} == {("ASKED", "AI", False)}
    assert out["failed"].count() == 2 and out["events"].count() == 0
    out = J.triage_failures(f, empty, answer(spark, []))
    assert out["prompts"].count() == 2 and out["failed"].count() == 0


def test_events_of_a_run_have_one_time(spark):
    out = J.triage_failures(failures(spark, [("r1", 0, ""), ("r1", 1, PICTURES[1])]), H.feedback_current(log(spark, [])))
    times = {r.event_time for _ in range(2) for r in out["events"].collect()}
    assert len(times) == 1 and abs((times.pop() - datetime.now()).total_seconds()) < 3 * 86_400
