"""Prompts for the failures that history leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagewright.functions import text as T

RULES = """You investigate failed UI tests. Name one specific technical cause, from the evidence below alone.

Rules:
- CONFIRMED needs a picture and an error that agree; PROBABLE rests on the error or stack alone; POSSIBLE is for thin or conflicting evidence.
- Refused connections, unresolved names, gateways and 502/503/504 pages are ENVIRONMENT_ISSUE or NETWORK_ISSUE, whatever step failed.
- A timeout or a missing element is a symptom. AUTOMATION_ISSUE needs proof that the application stood in the expected state.
- A screen that shows another state than the step expects is APPLICATION_ISSUE.
- If the element is plainly visible on the right screen but wasn't found, it is AUTOMATION_ISSUE: locator, wait or context.
- Read all steps; one that worked earlier and fails later points at the application.
- Invent nothing that the evidence doesn't show.

Answer with one JSON object of these fields: classification (AUTOMATION_ISSUE, APPLICATION_ISSUE, API_ISSUE, DATA_ISSUE,
ENVIRONMENT_ISSUE, NETWORK_ISSUE or UNKNOWN), rootCauseType, rootCause, screenshotObservation, confidence (0 to 100), evidence,
missingEvidence, severity (LOW, MEDIUM, HIGH or CRITICAL), recommendedAction, suggestedFix, stepsToReproduce, preventionTips,
similarPatterns."""
WITH_IMAGE = "Screenshot: attached to this request. Describe what it shows and let it confirm or refute the cause."
NO_IMAGE = "Screenshot: NOT PROVIDED. The cause cannot be CONFIRMED without one."
#: The parts of a prompt after the rules: a heading for each of eleven slots; the picture's part comes last.
HEADINGS = (
    "Test", "Report type", "Feature", "Scenario", "Steps", "Failed step", "Error", "Stack trace", "Console", "Video", "History",
)
ERROR_CAP, CONSOLE_CAP = 2500, 1200
#: Label and column of history's lines.
HISTORY = (
    ("Previous Source", "source"), ("Previous AI Classification", "ai_classification"), ("Previous Human Classification", "human_classification"),
    ("Previous Root Cause", "root_cause"), ("Previous Root Cause Type", "root_cause_type"), ("Previous Similar Patterns", "similar_patterns"),
    ("Previous Screenshot Observation", "screenshot_observation"),
)


def history_context(prefix: str = "fb_") -> Column:
    lines = [F.when(~T.blank(F.col(prefix + c)), F.concat(F.lit(f"{label}: "), T.trim(F.col(prefix + c)))) for label, c in HISTORY]
    return T.let(F.concat_ws("\n", *lines), lambda x: F.when(x == "", "NOT PROVIDED").otherwise(x))


def has_image(image: Column) -> Column:
    return F.coalesce(T.trim(image).startswith("data:image/"), F.lit(False))


def build_prompt(context: Column, detail: Column) -> Column:
    """The prompt of a request. The picture itself is never part of it."""
    c = F.col
    slots = (
        T.or_not_provided(c("test_name")), T.or_not_provided(c("report_type")), T.or_not_provided(c("feature")), T.or_not_provided(c("scenario")),
        T.format_steps(detail, c("all_steps")), T.or_not_provided(c("failed_step")), T.limit_text(T.strip_stack_noise(c("error")), ERROR_CAP),
        T.stack_section(c("error"), c("stack_trace")), T.limit_text(c("console_logs"), CONSOLE_CAP), T.or_not_provided(c("video_url")), T.let(context, T.or_not_provided),
    )
    parts = [F.concat(F.lit(f"--- {h} ---\n"), s) for h, s in zip(HEADINGS, slots)]
    return F.concat_ws("\n\n", F.lit(RULES), *parts, F.when(has_image(c("failure_image")), WITH_IMAGE).otherwise(NO_IMAGE))


def model_route(image: Column, text_model: str, vision_model: str, vision_tokens: int = 1000) -> Column:
    """Which model a request goes to: one that sees if a picture is there, whatever its data URI says."""
    trimmed = T.trim(image)
    raw = F.when(trimmed.startswith("data:") & (F.instr(trimmed, ",") > 1), F.regexp_replace(trimmed, r"(?s)^[^,]*,", "")).otherwise(trimmed)
    route = lambda model, vision, tokens, context, form: F.struct(F.lit(model).alias("model"), F.lit(vision).alias("vision"), F.lit(tokens).alias("max_tokens"), F.lit(context).alias("context"), F.lit(form).alias("format"))
    return F.when(~T.blank(raw), route(vision_model, True, vision_tokens, 6144, "")).otherwise(route(text_model, False, 400, 8192, "json"))


def build_prompts(open_requests: DataFrame, text_model: str = "text", vision_model: str = "vision") -> DataFrame:
    """(failure_id, route, prompt, screenshot_hash) of requests that history leaves open: history.pending(history.match_history(...))."""
    detail = F.col("all_steps_detail") if "all_steps_detail" in open_requests.columns else F.array().cast("array<string>")
    context = F.when(F.col("matched_by").isNotNull(), history_context()).otherwise("NOT PROVIDED")
    return open_requests.select("failure_id", model_route(F.col("failure_image"), text_model, vision_model).alias("route"), build_prompt(context, detail).alias("prompt"), T.screenshot_hash(F.col("failure_image")).alias("screenshot_hash"))
