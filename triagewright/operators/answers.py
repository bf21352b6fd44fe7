"""Cleaning what a model answered, and answering by rule where there is no model."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from triagewright import schemas as S
from triagewright.functions import text as T

# The cue lists of the guardrail, and the sentences that responses are given.
LOCATOR_CUES = (
    "nosuchelementexception", "unable to locate", "cannot find element", "element not found", "failed to find element", "locator",
    "selector", "resource-id", "accessibility id", "accessibility-id", "xpath", "css selector",
)
VISIBLE_CUES = (
    "element is visible", "visually present", "button is visible", "present and correctly", "ui readiness", "screen is ready",
    "no error dialogs", "visible", "enabled",
)
CONNECTION_CUES = (
    "err_connection_refused", "site can't be reached", "refused to connect", "err_name_not_resolved", "err_connection_timed_out",
    "dns", "502", "503", "504", "gateway",
)
UNSEEN = "A screenshot was attached but the AI vision model did not clearly describe it. Please review the screenshot manually alongside this analysis."
LACKING = "Additional evidence is required to confirm the root cause"
LOADED = "Result loaded from previously saved failure details."
#: Names in a model's JSON.
NAMES = {
    "classification": "classification", "root_cause_type": "rootCauseType", "root_cause": "rootCause", "severity": "severity",
    "recommended_action": "recommendedAction", "suggested_fix": "suggestedFix", "similar_patterns": "similarPatterns",
    "screenshot_observation": "screenshotObservation", "evidence": "evidence", "missing_evidence": "missingEvidence",
    "steps_to_reproduce": "stepsToReproduce", "prevention_tips": "preventionTips",
}
COLUMNS = (*S.RESPONSE_TEXTS, "confidence", *S.RESPONSE_LISTS)
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def has_cue(text: Column, cues: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(c) for c in cues))


def extract_json(raw: Column) -> Column:
    """From the first brace to the last, or to the end if none follows; null if there is none. Code fences go."""
    bare = T.trim(F.regexp_replace(T.trim(raw), "```(json|JSON)?", ""))
    whole = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(whole != "", whole).otherwise(F.regexp_extract(bare, r"(?s)\{.*", 0)), F.lit(""))


def close_json(text: str) -> str:
    """A cut JSON text with its open string closed, a last comma dropped and open brackets closed; text that parses stays."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    outside = STRING.sub(lambda m: " " * len(m[0]), text)
    if '"' in outside:  # what follows the odd quote is an open string
        at = outside.index('"')
        tail = text[at:]
        if (len(tail) - len(tail.rstrip("\\"))) % 2:
            tail = tail[:-1]
        text, outside = text[:at] + tail + '"', outside[:at]
    elif text.rstrip().endswith(","):
        text = text.rstrip()[:-1]
    open_: list[str] = []
    for c in outside:
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    return text + "".join(reversed(open_))


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else close_json(t))


def as_text(value) -> str:
    """A JSON value as text: lists joined, however deep, an object's message, else its JSON; null is empty."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        out = ""
        for x in value:
            out = f"{out}; {as_text(x)}" if out else as_text(x)
        return out
    if isinstance(value, dict) and "message" in value:
        said = value["message"]
        return said if isinstance(said, str) else "" if isinstance(said, list | dict) else json.dumps(said)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def no_constant(name: str):
    raise ValueError(name)


def normalize_response(text: str | None) -> dict | None:
    """The response's fields from a JSON text, closed if it was cut: texts are never null, lists never null, a confidence that isn't a number is 0. None if it is no object."""
    if text is None:
        return None
    try:
        root = json.loads(close_json(text), parse_constant=no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    out: dict = {c: as_text(root.get(NAMES[c])) for c in S.RESPONSE_TEXTS}
    for c in S.RESPONSE_LISTS:
        value = root.get(NAMES[c])
        out[c] = [] if value is None else list(map(as_text, value)) if isinstance(value, list) else [as_text(value)]
    number = root.get("confidence")
    out["confidence"] = int(number) if isinstance(number, int | float) and not isinstance(number, bool) and -2147483649 < number < 2147483648 else 0
    return out


READ = StructType([StructField("ok", BooleanType()), *(StructField(c, StringType()) for c in S.RESPONSE_TEXTS), StructField("confidence", IntegerType()), *(StructField(c, ArrayType(StringType())) for c in S.RESPONSE_LISTS)])


@F.pandas_udf(READ)
def read_answer(texts: pd.Series) -> pd.DataFrame:
    """ok and the response's columns, of JSON texts as extract_json() finds them."""
    rows = [normalize_response(t) for t in texts]
    return pd.DataFrame([{"ok": r is not None, **(r or {c: None for c in COLUMNS})} for r in rows], columns=["ok", *COLUMNS]).astype({"confidence": "Int32"})


def fix_screenshot_text(observation: Column, image: Column) -> Column:
    """If a picture was sent, an observation that denies it is replaced."""
    denies = T.blank(observation) | F.lower(observation).contains("no screenshot") | F.lower(observation).contains("not provided")
    return F.when(~T.blank(image) & denies, UNSEEN).otherwise(observation)


def enforce_consistency(classification: Column, texts: list[Column]) -> Column:
    """APPLICATION_ISSUE becomes AUTOMATION_ISSUE if the texts speak of locators and of visible elements, and not of connections."""
    said = F.concat_ws("\n", *[T.filled(t) for t in texts])
    wrong = has_cue(said, LOCATOR_CUES) & has_cue(said, VISIBLE_CUES) & ~has_cue(said, CONNECTION_CUES)
    return F.when((F.upper(T.trim(classification)) == "APPLICATION_ISSUE") & wrong, "AUTOMATION_ISSUE").otherwise(classification)


def guarded(prefix: str, error: Column | None, step: Column | None) -> Column:
    """enforce_consistency() over a response's columns with that prefix, and the request's error and step if given."""
    texts = [*(x for x in (error, step) if x is not None), *[F.col(prefix + c) for c in ("root_cause", "recommended_action", "suggested_fix", "similar_patterns", "screenshot_observation")]]
    return enforce_consistency(F.col(prefix + "classification"), [*texts, F.array_join(F.coalesce(prefix + "evidence", F.array().cast("array<string>")), "\n")])


def judged(answers: DataFrame) -> DataFrame:
    """The first two attempts of each id, with what they say: r.ok tells whether they parse."""
    return answers.where("attempt <= 2").select("failure_id", "attempt", "raw_text", read_answer(extract_json(F.col("raw_text"))).alias("r"))


def clean_answers(answers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, failures) from raw answers: of two attempts a request the first that parses; failures tell what was wrong.

    requests: (failure_id, error, failed_step, failure_image). A failure keeps the first and last 200 and the first 3,000 characters.
    """
    # min and max over all fields: whichever rows an id has more than one of, the same is chosen on every run
    each = judged(answers).groupBy("failure_id").agg(
        F.min(F.when(F.col("r.ok"), F.struct("attempt", "raw_text", "r"))).alias("best"), F.max(F.struct("attempt", "raw_text")).alias("last"), F.count("*").alias("attempts")
    )
    return finished(each, requests)


def finished(each: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, failures) of ids with their best attempt (null if none parses), their last and their number of attempts."""
    asked = requests.groupBy("failure_id").agg(F.min(F.struct(F.col("error").alias("_error"), F.col("failed_step").alias("_step"), F.col("failure_image").alias("_image"))).alias("_asked"))
    chosen = each.where("best IS NOT NULL").select("failure_id", "best.attempt", *[F.col(f"best.r.{c}").alias(c) for c in COLUMNS])
    told = chosen.join(asked, "failure_id", "left").withColumn("screenshot_observation", fix_screenshot_text(F.col("screenshot_observation"), F.col("_asked._image")))
    told = told.withColumn("classification", guarded("", F.col("_asked._error"), F.col("_asked._step")))
    said = F.col("last.raw_text")
    bad = each.where("best IS NULL").select(
        "failure_id", "attempts", F.when(T.blank(said), "empty answer").when(~said.contains("{"), "no JSON object").otherwise("not a JSON object").alias("error"),
        F.substring(said, 1, 200).alias("first_200"), F.right(said, F.lit(200)).alias("last_200"), F.substring(said, 1, 3000).alias("first_3000"),
    )
    return told.drop("_asked"), bad


def validate_response(responses: DataFrame) -> DataFrame:
    """Domains of a response enforced; opt-in, as cleaning leaves them to the reader."""
    kind = F.when(T.blank(F.col("root_cause_type")), "UNKNOWN").when(F.upper("root_cause_type").isin("CONFIRMED", "PROBABLE", "POSSIBLE"), F.upper("root_cause_type")).otherwise("POSSIBLE")
    out = responses.withColumns({"classification": F.coalesce(T.filled(F.col("classification")), F.lit("UNKNOWN")), "severity": F.coalesce(T.filled(F.col("severity")), F.lit("MEDIUM")), "root_cause_type": kind})
    most = F.when(F.col("root_cause_type") == "CONFIRMED", 100).otherwise(80)
    none = F.size(F.coalesce("missing_evidence", F.array().cast("array<string>"))) == 0
    lacking = F.array(F.lit(LACKING))
    return out.withColumns(
        {
            "confidence": F.least(F.greatest(F.coalesce("confidence", F.lit(0)), F.lit(0)), most),
            "missing_evidence": F.when((F.col("root_cause_type") == "PROBABLE") & none, lacking).otherwise(F.col("missing_evidence")),
        }
    )


def reused_responses(matched: DataFrame, order: str, guard: bool = True) -> DataFrame:
    """(failure_id, response columns, ...) of requests that history answers, one an id: what the first request in order got, as later ones find its
    copy. The guardrail runs over human labels too, unless guard is off."""
    history = [c for c in matched.columns if c.startswith("fb_")]
    matched = matched.where("reusable").groupBy("failure_id").agg(F.min_by(F.struct("reusable", *history), order).alias("r")).select("failure_id", "r.*")
    human = T.filled(F.col("fb_human_classification"))
    rows = matched.where("reusable").withColumns(
        {
            "fb_classification": F.coalesce(human, T.filled(F.col("fb_ai_classification")), F.lit("UNKNOWN")),
            "fb_human_classification": human,
            "fb_root_cause": F.coalesce(T.filled(F.col("fb_root_cause")), F.lit(LOADED)),
            "fb_confidence": F.coalesce("fb_confidence", F.lit(0)),
        }
    )
    label = guarded("fb_", None, None) if guard else F.col("fb_classification")
    columns = [c for c in (*S.RESPONSE_TEXTS, *S.RESPONSE_LISTS, "confidence") if c != "classification"]
    return rows.select("failure_id", label.alias("classification"), *[F.col(f"fb_{c}").alias(c) for c in columns], F.col("fb_ai_classification").alias("ai_classification"), F.col("fb_human_classification").alias("human_classification"), F.lit("HISTORICAL").alias("source"))


def overlay_human(responses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Fresh responses with a human label in place of the model's, which stays as ai_classification; source stays."""
    human = feedback.select("failure_id", T.filled(F.col("human_classification")).alias("_human"))
    out = responses.join(human, "failure_id", "left").withColumns({"ai_classification": F.col("classification"), "human_classification": F.col("_human"), "classification": F.coalesce("_human", "classification")})
    return out.drop("_human")


#: What is known of a call, if its columns are there: characters of the prompt; milliseconds of building it, of the call and of reading the answer; tokens.
MEASURES = ("prompt_chars", "build_ms", "http_ms", "parse_ms", "prompt_tokens", "output_tokens")
QUANTILES = (0.5, 0.9, 0.99)
#: A sketch of this size gives ranks within 1 in 100 of the true ones, 99 times in 100.
SKETCH = 400


def measured(calls: DataFrame) -> DataFrame:
    return calls.withColumns({c: (F.col(c) if c in calls.columns else F.lit(None)).cast("long") for c in MEASURES})


def model_call_stats(calls: DataFrame) -> DataFrame:
    """Calls, retries, and sums, means and maxima of all measures, by model and kind. calls: the answers table, with as many of MEASURES as there are."""
    rows = measured(calls).withColumn("total_ms", sum((F.coalesce(c, F.lit(0)) for c in ("http_ms", "parse_ms")), F.coalesce("build_ms", F.lit(0))))
    each = [f(c).alias(f"{name}_{c}") for c in (*MEASURES, "total_ms") for name, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))]
    retried = F.count_if(F.col("attempt") > 1).alias("retries")
    return rows.groupBy("model", "vision").agg(F.count("*").alias("calls"), retried, (F.sum("output_tokens") * 1000 / F.sum("http_ms")).alias("tokens_per_s"), *each)


def call_sketches(calls: DataFrame, *by: str) -> DataFrame:
    """Quantile sketches of MEASURES by model, kind and further columns, such as a day: small rows that merge, so that old calls needn't be kept."""
    rows = measured(calls)
    return rows.groupBy("model", "vision", *by).agg(*[F.kll_sketch_agg_bigint(c, F.lit(SKETCH)).alias(c) for c in MEASURES])


def call_quantiles(sketches: DataFrame) -> DataFrame:
    """(model, vision, measure, q, value) of sketches of any days, merged; measures that no call has are left out."""
    merge = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.kll_sketch_merge_bigint(a, b))
    long = sketches.select("model", "vision", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("sketch")) for c in MEASURES])))
    merged = long.groupBy("model", "vision", "measure").agg(F.reduce(F.collect_list("sketch"), F.lit(None).cast("binary"), merge).alias("sketch"))
    some = merged.where(F.kll_sketch_get_n_bigint("sketch") > 0)
    each = F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value")) for q in QUANTILES])
    return some.select("model", "vision", "measure", F.inline(each))


def rule_triage(requests: DataFrame) -> DataFrame:
    """A response for each request by rule: connection cues, then locator cues with visible ones, else unknown. So the jobs run without a model."""
    said = F.concat_ws("\n", *[T.filled(F.col(c)) for c in ("error", "failed_step", "stack_trace", "console_logs")])
    names = ("err_name_not_resolved", "dns", "refused to connect", "err_connection_refused", "err_connection_timed_out")
    network, connection = has_cue(said, names), has_cue(said, CONNECTION_CUES)
    automation = has_cue(said, LOCATOR_CUES) & has_cue(said, VISIBLE_CUES)
    pick = lambda a, b, c, d: F.when(network, a).when(connection, b).when(automation, c).otherwise(d)
    none = F.array().cast("array<string>")
    return requests.select(
        "failure_id", pick("NETWORK_ISSUE", "ENVIRONMENT_ISSUE", "AUTOMATION_ISSUE", "UNKNOWN").alias("classification"), pick("PROBABLE", "PROBABLE", "PROBABLE", "POSSIBLE").alias("root_cause_type"),
        F.concat(F.lit("By rule: "), pick("connection cue", "availability cue", "locator cue with a visible element", "no cue")).alias("root_cause"), pick("HIGH", "HIGH", "MEDIUM", "LOW").alias("severity"),
        F.lit("").alias("recommended_action"), F.lit("").alias("suggested_fix"), F.lit("").alias("similar_patterns"), F.lit("").alias("screenshot_observation"),
        pick(F.lit(60), F.lit(60), F.lit(60), F.lit(35)).alias("confidence"), *[none.alias(c) for c in S.RESPONSE_LISTS],
    )
