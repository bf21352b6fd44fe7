"""The feedback log, its current state, and matching requests against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagewright import schemas as S
from triagewright.functions import text as T


def feedback_columns(requests: DataFrame) -> DataFrame:
    """requests with the columns that the feedback table derives from them. Requests: schemas.REQUEST_FIELDS."""
    both = F.col("_both")
    rows = T.once(requests, {"_both": T.searched(F.col("error"), F.col("stack_trace"))})
    return rows.withColumns(
        {
            "scenario_name": T.scenario_key(F.col("scenario"), F.col("test_name")),
            "feature_name": F.col("feature"),
            "failed_step_line": F.col("failed_step"),
            "normalized_step": T.norm_step(F.col("failed_step")),
            "normalized_error": T.norm_error_line(F.col("error")),
            "exception_type": T.simple_exception(both),
            "locator": T.feedback_locator(both),
            "stack_trace_pattern": T.stack_pattern(F.col("stack_trace")),
            "screenshot_hash": T.screenshot_hash(F.col("failure_image")),
        }
    ).drop("_both")


def with_ids(requests: DataFrame) -> DataFrame:
    """requests with their ids, each worked out once: filters on them (usable()) would write them out again at each of their uses."""
    return T.once(
        requests,
        {
            "failure_id": T.failure_id(F.col("failed_step"), F.col("error")),
            "legacy_id": T.legacy_failure_id(F.col("scenario"), F.col("feature"), F.col("failed_step"), F.col("error")),
        },
    )


def valid_classification(c: Column) -> Column:
    return F.coalesce(F.upper(T.trim(c)).isin(*S.CLASSIFICATIONS), F.lit(False))


def usable(df: DataFrame) -> DataFrame:
    return df.where(~T.blank(F.col("failure_id")))


def evolve_feedback(log: DataFrame) -> DataFrame:
    """An older log with every column of today's; those it lacks are null."""
    full = log.sparkSession.createDataFrame([], S.FEEDBACK_LOG)
    return full.unionByName(log, allowMissingColumns=True)


def import_feedback(rows: DataFrame) -> DataFrame:
    """Exported rows, whose lists are JSON texts and whose times are ISO texts, with real types. Text that isn't such a list is null."""
    lists = {c: F.from_json(T.filled(F.col(c)), "array<string>") for c in S.RESPONSE_LISTS if c in rows.columns}
    times = {c: F.try_to_timestamp(F.col(c)) for c in ("created_at", "updated_at", "event_time") if c in rows.columns}
    return rows.withColumns(lists | times)


def export_feedback(rows: DataFrame) -> DataFrame:
    lists = {c: F.to_json(F.col(c)) for c in S.RESPONSE_LISTS if c in rows.columns}
    stamp = lambda c: F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.withColumns(lists | {c: stamp(c) for c in ("created_at", "updated_at", "event_time") if c in rows.columns})


def feedback_current(log: DataFrame) -> DataFrame:
    """One row an id. An AI result replaces the AI columns and never the human label; a correction replaces that label alone.

    An ALIAS event is a full copy under a new id, and only counts if it is the id's first. Last events win by (event_time, seq), so late
    ones converge; created_at is the first event's.
    """
    order = F.struct("event_time", "seq")
    ai = F.struct(*S.FEEDBACK_AI)
    first = F.struct("kind", "human_classification", F.coalesce("created_at", "event_time").alias("created_at"), ai.alias("ai"))
    of = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, c), F.when(F.col("kind") == kind, order))
    folded = usable(log).groupBy("failure_id").agg(
        F.min_by(first, order).alias("first"), of("AI", ai).alias("ai"),
        of("HUMAN", F.struct(F.col("human_classification").alias("label"))).alias("human"),
        F.max(F.when(F.col("kind") != "ALIAS", F.col("event_time"))).alias("last"),
    )
    alias = F.col("first.kind") == "ALIAS"
    kept = folded.withColumns(
        {
            "ai": F.coalesce("ai", F.when(alias, F.col("first.ai"))),
            "human_classification": F.when(F.col("human").isNotNull(), F.col("human.label")).when(alias, F.col("first.human_classification")),
            "created_at": F.col("first.created_at"),
            "updated_at": F.coalesce("last", "first.created_at"),
        }
    )
    return kept.select("failure_id", *[F.col(f"ai.{c}").alias(c) for c in S.FEEDBACK_AI], "human_classification", "created_at", "updated_at")


def effective_label(feedback: DataFrame) -> DataFrame:
    """(failure_id, ai_classification, human_classification, classification, label_source)"""
    human = T.filled(F.col("human_classification"))
    return feedback.select(
        "failure_id", "ai_classification", "human_classification", F.coalesce(human, F.col("ai_classification")).alias("classification"),
        F.when(human.isNotNull(), "HUMAN_CORRECTED").otherwise("AI").alias("label_source"),
    )


def meaningful(root_cause: Column) -> Column:
    """A root cause that says something: not blank, and none of the known empty phrases (fixed values)."""
    low = F.lower(T.trim(root_cause))
    empty = (
        low.startswith("result loaded from previously saved failure details")
        | low.contains("there may be a delay in page loading")
        | low.contains("there may be a network issue")
        | low.contains("the element was not visible")
        | (low.startswith("timeoutexception") & (low.contains("delay in page loading") | low.contains("element visibility")))
    )
    return F.coalesce(~T.blank(root_cause) & ~empty, F.lit(False))


COMPLETE = (
    "root_cause_type", "severity", "recommended_action", "suggested_fix", "similar_patterns", "screenshot_observation",
    *S.RESPONSE_LISTS, "source",
)


def is_complete(prefix: str = "") -> Column:
    """All columns of an analysis are there (empty ones count) and its root cause is meaningful."""
    out = meaningful(F.col(prefix + "root_cause"))
    for c in COMPLETE:
        out = out & F.col(prefix + c).isNotNull()
    return out


def can_reuse(prefix: str = "fb_", image: str = "failure_image") -> Column:
    """A complete record answers a request without image; with one, its observation must be there and its image the same."""
    same = F.lower(T.screenshot_hash(F.col(image))) == F.lower(F.col(prefix + "screenshot_hash"))
    seen = ~T.blank(F.col(prefix + "screenshot_observation")) & ~T.blank(F.col(prefix + "screenshot_hash"))
    return F.coalesce(is_complete(prefix) & (T.blank(F.col(image)) | (seen & same)), F.lit(False))


def prefixed(feedback: DataFrame, prefix: str = "fb_", key: str = "failure_id") -> DataFrame:
    return feedback.select([F.col(c).alias(key if c == "failure_id" else prefix + c) for c in feedback.columns])


def match_history(requests: DataFrame, feedback: DataFrame) -> DataFrame:
    """Requests (with ids) and what history says of them: matched_by (exact, legacy or null), reusable, fb_*; source is what an answer will be called.

    A forced request looks nothing up. The legacy id is tried only where the exact one is unknown.
    """
    asked = requests.withColumn("_forced", F.coalesce("force_reanalysis", F.lit(False)) if "force_reanalysis" in requests.columns else F.lit(False))
    # rows that look nothing up get keys of their own, so that they don't meet in one task
    alone = F.concat(F.lit("-"), F.xxhash64(*[c for c in ("report_id", "failure_idx", "seq", "failure_id") if c in asked.columns]).cast("string"))
    asked = T.once(asked, {"_key": F.when(F.col("_forced"), alone).otherwise(F.col("failure_id"))})
    exact = asked.join(prefixed(usable(feedback), "ex_", "_key").withColumn("ex_hit", F.lit(True)), "_key", "left")
    old = exact.withColumn("_old", F.when(~F.col("_forced") & F.col("ex_hit").isNull(), F.col("legacy_id")).otherwise(alone))
    both = old.join(prefixed(usable(feedback), "old_", "_old").withColumn("old_hit", F.lit(True)), "_old", "left")
    columns = [c for c in feedback.columns if c != "failure_id"]
    out = both.withColumns({f"fb_{c}": F.coalesce(f"ex_{c}", F.when(F.col("ex_hit").isNull(), F.col(f"old_{c}"))) for c in columns})
    out = out.withColumn("matched_by", F.when(F.col("ex_hit"), "exact").when(F.col("old_hit"), "legacy"))
    out = out.withColumn("reusable", F.col("matched_by").isNotNull() & can_reuse())
    source = F.when(F.col("reusable"), "HISTORICAL").when(F.col("matched_by").isNotNull(), "AI_ENRICHED").otherwise("AI")
    return out.select(*requests.columns, "matched_by", "reusable", source.alias("source"), *[f"fb_{c}" for c in columns])


def aliases(matched: DataFrame, feedback: DataFrame, event_time: Column, seq: str) -> DataFrame:
    """ALIAS events for requests found by their legacy id: a copy of the old record under the new id, unless that exists."""
    new = matched.where("matched_by = 'legacy'").groupBy("failure_id").agg(F.min(seq).alias("seq"), F.min("legacy_id").alias("legacy_id"))
    new = new.join(feedback.select("failure_id"), "failure_id", "left_anti")
    copy = new.join(prefixed(feedback, "", "legacy_id"), "legacy_id")
    return copy.select("failure_id", F.lit("ALIAS").alias("kind"), event_time.alias("event_time"), F.col("seq").cast("long").alias("seq"), "created_at", "human_classification", *S.FEEDBACK_AI)


def pending(matched: DataFrame) -> DataFrame:
    """What still needs a model's answer."""
    return matched.where(~F.col("reusable"))


def resolve_repeats(groups: DataFrame, order: list[str]) -> DataFrame:
    """groups with asks: only the first of those that share an id is asked; the others look at what it recorded."""
    first = groups.groupBy("failure_id").agg(F.min(F.struct(*order)).alias("_first"))
    return groups.join(first, "failure_id").withColumn("asks", F.struct(*order) == F.col("_first")).drop("_first")


def ask_again(repeats: DataFrame, recorded: DataFrame) -> DataFrame:
    """Of the groups that weren't asked, those for which the new record can't be reused."""
    return match_history(repeats.where(~F.col("asks")), recorded).where(~F.col("reusable")).select(repeats.columns)


def match_across_reports(requests: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """(key, classification, matched_id, matches): one human label that all similar failures of history agree on.

    The exception has to be equal. A fixed locator has to be equal too; a generated one by its pattern, or else the step; without
    locator the step has to be. Three equal joins instead of one join with OR, over history summed up by key.
    """
    asked = T.once(feedback_columns(requests), {"locator": F.col("locator"), "e": F.upper("exception_type"), "step": F.lower("normalized_step")}).select(key, "e", "locator", "step").where(F.col("e").isNotNull() & (F.col("e") != ""))
    has = ~T.blank(F.col("locator"))
    dynamic = has & T.is_dynamic_locator(F.col("locator"))
    label = F.upper(T.trim(F.col("human_classification")))
    known = (
        feedback.where(~T.blank(F.col("human_classification")) & F.col("exception_type").isNotNull())
        .select(F.upper("exception_type").alias("e"), F.lower("locator").alias("locator"), T.locator_pattern(F.col("locator")).alias("pattern"), F.lower("normalized_step").alias("step"), label.alias("label"), "created_at", "failure_id")
    )
    found = None
    for ask, by in (
        (asked.where(has & ~dynamic).select(key, "e", F.lower("locator").alias("k")), known.select("*", F.col("locator").alias("k"))),
        (asked.where(dynamic).select(key, "e", T.locator_pattern(F.col("locator")).alias("k")), known.where(F.col("locator").isNotNull()).select("*", F.col("pattern").alias("k"))),
        (asked.where(dynamic | ~has).where(~T.blank(F.col("step"))).select(key, "e", F.col("step").alias("k")), known.select("*", F.col("step").alias("k"))),
    ):
        summed = by.where(F.col("k").isNotNull()).groupBy("e", "k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("created_at", "failure_id")).alias("first"))
        hit = ask.join(summed, ["e", "k"]).select(key, "low", "high", "first")
        found = hit if found is None else found.unionByName(hit)
    one = found.groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"))
    return one.where("low = high").select(key, F.col("low").alias("classification"), F.col("first.failure_id").alias("matched_id"))


def split_corrections(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(HUMAN events, rejects with a reason)"""
    reason = (
        F.when(T.blank(F.col("failure_id")), "blank failure id")
        .when(T.blank(F.col("human_classification")), "blank classification")
        .when(~valid_classification(F.col("human_classification")), "unknown classification")
    )
    judged = corrections.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("failure_id", F.lit("HUMAN").alias("kind"), "event_time", "seq", F.col("event_time").alias("created_at"), F.upper(T.trim(F.col("human_classification"))).alias("human_classification"))
    return evolve_feedback(good), judged.where("reason IS NOT NULL")


def write_feedback(events: DataFrame, path: str) -> None:
    """Appends events to the log, by day."""
    evolve_feedback(events).withColumn("day", F.to_date("event_time")).write.mode("append").partitionBy("day").parquet(path)


def read_feedback(spark, path: str) -> DataFrame:
    return evolve_feedback(spark.read.option("mergeSchema", "true").parquet(path).drop("day"))
