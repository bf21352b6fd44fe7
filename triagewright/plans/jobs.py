"""Jobs: many reports or requests in, tables out. Each is one plan over DataFrames; nothing passes the driver."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagewright import schemas as S
from triagewright.functions import text as T
from triagewright.operators import answers as A
from triagewright.operators import clusters as C
from triagewright.operators import grouping as G
from triagewright.operators import history as H
from triagewright.operators import prompts as P
from triagewright.operators import repeats as E
from triagewright.plans.shared import written
from triagewright.sources import reports as R

RESPONSE_COLUMNS = (*S.RESPONSE_TEXTS, *S.RESPONSE_LISTS, "confidence")
EVENT_FIELDS = (
    "failure_id", "event_time", "seq", "scenario_name", "feature_name", "failed_step_line", "normalized_step", "normalized_error", "exception_type", "locator",
    "stack_trace_pattern", "screenshot_hash", "source",
)


def run_time() -> Column:
    """The time of a run, one for all it writes and however often a plan is executed."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def ai_events(asked: DataFrame) -> DataFrame:
    """AI events for the log: what requests (with ids, event_time, seq and source) say and, in RESPONSE_COLUMNS, what was answered."""
    rows = H.feedback_columns(asked)
    told = [F.col(c).alias("ai_classification" if c == "classification" else c) for c in RESPONSE_COLUMNS]
    return H.evolve_feedback(rows.select(*EVENT_FIELDS, *told, F.lit("AI").alias("kind"), F.col("event_time").alias("created_at")))


def as_history(fresh: DataFrame) -> DataFrame:
    """Fresh answers (ask, human, RESPONSE_COLUMNS) as records that a later request finds."""
    ai = [F.col(c).alias("fb_ai_classification" if c == "classification" else f"fb_{c}") for c in RESPONSE_COLUMNS]
    return fresh.select(F.col("ask").alias("failure_id"), F.lit(True).alias("reusable"), F.lit(0).alias("at"), F.col("human").alias("fb_human_classification"), *ai)


def attributed(given: DataFrame) -> DataFrame:
    """Calls (rows of answers with the asks that they serve, and `at`, when those are made) with the first ask alone: each call was made once."""
    call = F.struct("failure_id", "given_for").alias("_call")
    first = given.groupBy(call).agg(F.min("at").alias("_first"))
    return given.withColumn("_call", call).join(first, "_call").where("at = _first").drop("_call", "_first")


def triage_requests(requests: DataFrame, feedback: DataFrame, answers: DataFrame | None = None, order: tuple[str, ...] = ("seq",), now: Column | None = None) -> dict[str, DataFrame]:
    """Requests (REQUEST_FIELDS, event_time, seq) against history, each other and a model's answers, as if done one after the other in `order` (unique).

    matched: what history says of each; settled: what each gets (repeats.settle()); prompts: what has to be asked, once for each id and picture;
    responses: one for each request, with its origin and a name of its scenario, empty if its answer is missing; calls: each call's time with the request that asked it;
    failed: unreadable answers; events: what to append to the log.
    answers may name a picture (screenshot_hash). Without answers the written rules answer.
    """
    matched = written(H.match_history(H.with_ids(requests), feedback), "matched")
    asks = written(E.asks_of(matched, list(order)), "asks")
    named = asks.drop("failure_id").withColumnRenamed("ask", "failure_id")
    given = None
    if answers is None:
        fresh, failed = A.rule_triage(named), None
    else:
        given = E.answers_of(asks, answers.where("attempt <= 2"))
        fresh, failed = A.clean_answers(given.drop("failure_id").withColumnRenamed("ask", "failure_id"), named)
    aliases = H.aliases(matched, feedback, run_time() if now is None else now, "seq")
    human = feedback.select("failure_id", "human_classification").unionByName(aliases.select("failure_id", "human_classification"))
    human = human.select("failure_id", T.filled(F.col("human_classification")).alias("human"))
    fresh = fresh.select(F.col("failure_id").alias("ask"), *RESPONSE_COLUMNS).join(asks.select("ask", "failure_id", "picture"), "ask").join(human, "failure_id", "left")
    fresh = written(fresh, "fresh")
    told = fresh.withColumn("source", F.lit("AI")).select("failure_id", "picture", H.is_complete().alias("complete"), (~T.blank(F.col("screenshot_observation"))).alias("seen"))
    settled = written(E.settle(matched, told, list(order)), "settled")

    key = lambda origin, picture: F.struct("failure_id", F.lit(origin).alias("origin"), picture.alias("record")).alias("_key")
    response = ["classification", *(c for c in RESPONSE_COLUMNS if c != "classification"), "ai_classification", "human_classification"]
    own = fresh.withColumns({"ai_classification": F.col("classification"), "human_classification": F.col("human"), "classification": F.coalesce("human", "classification")})
    own = own.select(key("ASKED", F.col("picture")), *response)
    again = A.reused_responses(as_history(fresh), "at").withColumnRenamed("failure_id", "ask").join(asks.select("ask", "failure_id", "picture"), "ask")
    past = matched.where("matched_by IS NOT NULL").withColumns({"reusable": F.lit(True), "at": F.struct(*order)})
    past = A.reused_responses(past, "at").select(key("HISTORY", F.lit(None).cast("string")), *response)
    known = own.unionByName(again.select(key("REPEAT", F.col("picture")), *response)).unionByName(past)
    names = matched.select(*order, T.scenario_key(F.col("scenario"), F.col("test_name"), F.lit("unknown")).alias("scenario_id"))
    responses = settled.withColumn("_key", F.struct("failure_id", "origin", "record")).join(known, "_key", "left").drop("_key", "picture", "record").join(names, list(order))

    asked = settled.where("origin = 'ASKED'").withColumn("ask", F.concat_ws("#", "failure_id", "picture"))
    first = asked.groupBy("ask").agg(F.min(F.struct(*order)).alias("at"))
    askers = first.select("ask", "at.*")
    rest = matched.drop("failure_id", "source", "reusable")
    events = ai_events(asked.join(fresh.drop("failure_id", "picture", "human"), "ask").join(rest.drop("matched_by"), list(order)))
    out = {"matched": matched, "settled": settled, "responses": responses, "events": events.unionByName(H.evolve_feedback(aliases)), "failed": failed, "calls": None}
    out["prompts"] = P.build_prompts(matched.join(askers.drop("ask"), list(order)))
    if given is not None:
        out["failed"] = failed.withColumnRenamed("failure_id", "ask").join(first.select("ask"), "ask").join(asks.select("ask", "failure_id", "picture"), "ask").drop("ask")
        extra = [c for c in A.MEASURES if c in given.columns and c != "http_ms"]
        out["calls"] = attributed(given.join(first, "ask")).select("at.*", "failure_id", "attempt", "model", "vision", *extra, "http_ms", F.col("http_ms").alias("total_ms"))
    return out


def triage_failures(failures: DataFrame, feedback: DataFrame, answers: DataFrame | None = None, threshold: float = 0.80) -> dict[str, DataFrame]:
    """Failures of many reports: grouped, one representative a group triaged, its response shared by all members.

    Adds to triage_requests(): groups, investigated (failures in their order, with the response), clusters, summary and metrics. Groups are
    asked in order of report and group; each call counts for the group that asked it.
    """
    now = run_time()
    failures = written(failures, "failures")
    groups = written(G.group_failures(T.components(failures), threshold), "groups")
    heads = G.representatives(groups, failures)
    picked = failures.join(heads.select("report_id", F.col("representative_idx").alias("failure_idx"), "group_idx"), ["report_id", "failure_idx"])
    requests = R.to_requests(picked, "group_idx").withColumns({"event_time": now, "seq": F.col("group_idx")})
    order = ["report_id", "group_idx"]
    out = triage_requests(requests, feedback, answers, tuple(order), now)
    out["responses"] = written(out["responses"].withColumn("investigated", F.col("classification").isNotNull()), "responses")
    # Both have a row for about every failure in a few megabytes of file, by which Spark would take them for small enough to broadcast.
    members = failures.join(groups.hint("merge"), ["report_id", "failure_idx"]).join(out["responses"].hint("merge"), order, "left")
    investigated = written(members.withColumn("investigated", F.coalesce("investigated", F.lit(False))), "investigated")
    return out | {
        "groups": groups, "investigated": investigated, "clusters": C.cluster_failures(investigated), "summary": C.summarize(investigated), "metrics": G.report_metrics(failures, groups, out["calls"]),
    }


def triage_reports(reports: DataFrame, feedback: DataFrame, answers: DataFrame | None = None, threshold: float = 0.80, pieces: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reports of HTML, from tag soup to envelopes. Reports of another type, or without failures, get an empty envelope.

    Long reports come in pieces and leave so: pieces (report_id, at, html) stand in place of a column html of reports, and envelope_pieces for envelopes.
    """
    known = reports.where(F.upper("report_type") == "EXTENT")
    # Joined after reading: before it, on the column that deals pieces out, Spark may leave that dealing out.
    found = R.explode_reports(known) if pieces is None else R.explode_pieces(pieces).join(known.select("report_id").distinct(), "report_id", "left_semi")
    out = triage_failures(found, feedback, answers, threshold)
    clusters = written(out["clusters"], "clusters")
    given = reports.select("report_id"), out["investigated"], clusters
    return out | {"clusters": clusters, "envelopes": C.report_envelopes(*given), "envelope_pieces": C.envelope_pieces(*given)}


def apply_corrections(corrections: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Valid corrections as events, the labels after them, and the rejects with reasons. No AI result need be there."""
    events, rejects = H.split_corrections(corrections)
    return {"events": events, "labels": H.effective_label(H.feedback_current(H.evolve_feedback(log).unionByName(events))), "rejects": rejects}
