"""Column functions over the texts of failures: steps, exceptions, locators, error bodies, stack frames, ids.

Three normalizers exist on purpose: for grouping inside a report, for the feedback table, and for ids. They differ in what
they mask, and history depends on each staying as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide ids, groups and history.
KEYWORD = r"(?i)^(given|when|then|and|but)\s+"
EXCEPTION = r"([A-Za-z_][A-Za-z0-9_.$]*(?:Exception|Error))\b"
FEEDBACK_LOCATORS = (
    r"(?i)resource-id\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?",
    r"(?i)By\.xpath\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)",
    r"(?i)By\.id\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)",
    r"(?i)By\.cssSelector\s*:?\s*(\"[^\"]+\"|'[^']+'|[^,)\n]+)",
    r"(?i)accessibilityId\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?",
    r"(?i)(?:test-id|data-testid)\s*[=:]\s*['\"]?([\w.:/-]+)['\"]?",
)
#: What any of the patterns needs; most texts have none.
LOCATOR_CUE = r"(?i)resource-id|By\.|accessibilityId|test-?id|xpath"
GROUPING_LOCATORS = (*FEEDBACK_LOCATORS, r"(?i)xpath\s*[=:]\s*['\"]?([^'\"\n]+)['\"]?")
FRAMEWORK_FRAMES = (
    "org.openqa.selenium.support.ui.FluentWait", "org.openqa.selenium.support.ui.WebDriverWait", "org.testng.Assert",
    "java.base/", "io.appium.", "io.cucumber.",
)
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
LONG_NUMBER = r"(?<!\d)\d{3,}(?!\d)"
LINE = r"\r?\n"


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"\S")


def filled(c: Column) -> Column:
    """c, null if blank."""
    return F.when(~blank(c), c)


def trim(c: Column) -> Column:
    """Without characters up to the blank at both ends."""
    return F.btrim(c, F.lit("".join(map(chr, range(0x21)))))


def spaced(c: Column) -> Column:
    """Each run of white space as one blank. Single blanks match nothing: most texts have no other, and stay as they are."""
    return F.regexp_replace(c, r"\s{2,}|[^\S ]", " ")


def collapse(c: Column) -> Column:
    return trim(spaced(c))


def once(df, columns: dict):
    """df with columns, each computed once however often it is used: the optimizer would write it out again at every use, but not through a generator."""
    kept = [c for c in df.columns if c not in columns]
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*kept, row.alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_line(c: Column) -> Column:
    return F.get(F.split(c, LINE, 2), F.lit(0))


def norm_step(c: Column) -> Column:
    """A step without its leading keyword, in lower case; null stays null. Quotes and digits stay."""
    return F.lower(collapse(F.regexp_replace(trim(c), KEYWORD, "")))


def simple_exception(c: Column) -> Column:
    """The class name of the first exception in the text, null if there is none."""
    named = c.contains("Exception") | c.contains("Error")  # most texts have neither word, and need no pattern
    return F.when(named, F.nullif(F.substring_index(F.regexp_extract(c, EXCEPTION, 1), ".", -1), F.lit("")))


def grouping_locator(c: Column) -> Column:
    """The first locator in order of the patterns, without wrapping quotes; empty if there is none."""

    def clean(pattern: str) -> Column:
        value = trim(F.regexp_extract(c, pattern, 1))
        bare = F.regexp_replace(value, r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")
        return F.nullif(collapse(bare), F.lit(""))

    return F.when(c.rlike(LOCATOR_CUE), F.coalesce(*map(clean, GROUPING_LOCATORS), F.lit(""))).otherwise("")


def feedback_locator(c: Column) -> Column:
    """The first locator in order of the patterns, quotes kept; null if there is none."""
    return F.when(c.rlike(LOCATOR_CUE), trim(F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in FEEDBACK_LOCATORS])))


def mask(c: Column) -> Column:
    """Quoted texts and digits masked, in lower case."""
    quoted = F.regexp_replace(c, r"['\"][^'\"]*['\"]", '"*"')
    return F.lower(collapse(F.regexp_replace(quoted, r"\d+", "#")))


def error_body(error: Column, locator: Column) -> Column:
    line = first_line(error)
    without = F.when(locator != "", F.replace(line, locator, F.lit("*"))).otherwise(line)
    return F.when(blank(error), "no-error").otherwise(mask(without))


def top_frame(stack: Column) -> Column:
    """The first stack frame outside of frameworks, else the first at all, without its line number; empty if there is none."""
    frames = F.filter(F.transform(F.split(stack, LINE), trim), lambda x: x.startswith("at "))
    own = F.filter(frames, lambda x: ~F.greatest(*[x.contains(m) for m in FRAMEWORK_FRAMES]))
    frame = F.coalesce(F.get(own, F.lit(0)), F.get(frames, F.lit(0)), F.lit(""))
    return F.lower(collapse(F.regexp_replace(frame, r":\d+\)", ")")))


def exact_signature(step: Column, error: Column) -> Column:
    """The older signature: step and first error line, masked."""
    left = F.when(blank(step), "").otherwise(mask(step))
    line = first_line(error)
    right = F.when(blank(error), "no-error").when(blank(line), "").otherwise(mask(line))
    return F.concat(left, F.lit(" || "), right)


def searched(error: Column, stack: Column) -> Column:
    return F.concat(F.coalesce(error, F.lit("")), F.lit("\n"), F.coalesce(stack, F.lit("")))


def components(failures):
    """failures with step, exception, locator, error_body, stack_frame, has_locator and has_error."""
    error, stack = F.col("error_message"), F.col("stack_trace")
    both = F.col("_both")
    found = once(once(failures, {"_both": searched(error, stack)}), {"exception": F.coalesce(simple_exception(both), F.lit("UNKNOWN")), "locator": grouping_locator(both)})
    return found.drop("_both").withColumns(
        {
            "step": F.coalesce(norm_step(F.col("failed_step_line")), F.lit("")),
            "stack_frame": F.when(blank(stack), "").otherwise(top_frame(stack)),
            "has_error": ~blank(error),
        }
    ).withColumns({"error_body": error_body(error, F.col("locator")), "has_locator": F.col("locator") != ""})


def norm_error_line(error: Column) -> Column:
    return F.substring(spaced(F.lower(trim(first_line(error)))), 1, 500)


def stack_pattern(stack: Column) -> Column:
    """The first line of a stack that isn't blank, 300 characters at most."""
    lines = F.filter(F.transform(F.split(stack, LINE), trim), lambda x: x != "")
    return F.when(~blank(stack), F.substring(F.get(lines, F.lit(0)), 1, 300))


def squeezed(c: Column) -> Column:
    """As ids see a text: trimmed, in lower case, white space collapsed; null is empty."""
    return F.coalesce(spaced(F.lower(trim(c))), F.lit(""))


def failure_id(step: Column, error: Column) -> Column:
    """16 hex digits of step, exception and masked error. Scenario and feature don't count, the step's keyword does."""
    masked = squeezed(error)
    for pattern, by in ((UUID, "<uuid>"), (r"\[\d+\]", "[#]"), (LONG_NUMBER, "<num>")):
        masked = F.regexp_replace(masked, pattern, by)
    kind = F.lower(F.coalesce(simple_exception(error), F.lit("")))
    return F.substring(F.sha2(F.concat_ws("|", squeezed(step), kind, masked), 256), 1, 16)


def legacy_failure_id(scenario: Column, feature: Column, step: Column, error: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *map(squeezed, (scenario, feature, step, error))), 256), 1, 16)


def screenshot_hash(image: Column) -> Column:
    return F.when(~blank(image), F.sha2(image, 256))


def plain_words(c: Column) -> Column:
    """Letters a-z and digits in lower case, the rest blanks; UNKNOWN if blank."""
    return F.when(blank(c), "UNKNOWN").otherwise(collapse(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")))


def cluster_signature(classification: Column, feature: Column, step: Column, error: Column, investigated: Column) -> Column:
    seconds = F.when(blank(error), "UNKNOWN").otherwise(F.regexp_replace(plain_words(error), r"\d+\s*seconds?", "timeout"))
    parts = F.concat_ws("|", F.coalesce(trim(classification), F.lit("")), plain_words(feature), plain_words(step), seconds)
    return F.when(investigated, parts).otherwise("UNKNOWN")


def is_dynamic_locator(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"[_-]\d{3,}|\[\d+\]|\d{4,}"), F.lit(False))


def locator_pattern(c: Column) -> Column:
    masked = F.regexp_replace(F.regexp_replace(F.lower(trim(c)), r"\[\d+\]", "[#]"), r"\d{3,}", "<num>")
    return F.coalesce(spaced(masked), F.lit(""))


def limit_text(c: Column, n: int) -> Column:
    cut = lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("\n[TRUNCATED]"))).otherwise(x)
    return let(c, lambda x: F.when(blank(x), "NOT PROVIDED").otherwise(let(trim(x), cut)))


def or_not_provided(c: Column) -> Column:
    return F.when(blank(c), "NOT PROVIDED").otherwise(trim(c))


def strip_stack_noise(c: Column, frames: int = 8) -> Column:
    """Without capability dumps and build lines, and with the first stack frames only; other lines all stay."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)Capabilities \{.*?\}\n", ""), r"(?m)^(Build info|System info|Driver info|Session ID):.*$\n?", "")

    def capped(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(trim(x).startswith("at "), i)), lambda i: i.isNotNull())
        last = F.coalesce(F.get(at, F.lit(frames)), F.size(lines))
        return let(last, lambda n: F.filter(lines, lambda x, i: (i < n) | ~trim(x).startswith("at ")))

    lines = F.element_at(F.transform(F.array(F.split(bare, LINE)), capped), 1)
    return F.when(blank(c), c).otherwise(trim(F.array_join(lines, "\n")))


def format_steps(detail: Column, all_steps: Column, last: int = 25) -> Column:
    """Numbered details, else the lines of all steps that aren't blank; the last ones, under a note of how many were left out."""
    numbered = F.transform(detail, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit(""))))
    lines = F.filter(F.split(F.coalesce(all_steps, F.lit("")), LINE), lambda x: ~blank(x))
    chosen = F.when(F.size(F.coalesce(detail, F.array().cast("array<string>"))) > 0, numbered).otherwise(lines)

    def shown(x: Column) -> Column:
        note = F.concat(F.lit("[... "), (F.size(x) - last).cast("string"), F.lit(" earlier step(s) omitted for brevity ...]\n"))
        cut = F.concat(note, F.array_join(F.slice(x, -last, last), "\n"))
        return F.when(F.size(x) == 0, "NOT PROVIDED").when(F.size(x) > last, cut).otherwise(F.array_join(x, "\n"))

    return F.element_at(F.transform(F.array(chosen), shown), 1)


# Fixed value.
SAME_STACK = "Same content as the ERROR MESSAGE / EXCEPTION section above."


def stack_section(error: Column, stack: Column) -> Column:
    both = F.struct(strip_stack_noise(stack).alias("stack"), strip_stack_noise(error).alias("error"))
    same = lambda x: F.coalesce(trim(x["stack"]) == trim(x["error"]), F.lit(False))
    return F.when(blank(stack), "NOT PROVIDED").otherwise(let(both, lambda x: F.when(same(x), SAME_STACK).otherwise(limit_text(x["stack"], 2000))))


def scenario_key(scenario: Column, fallback: Column, otherwise: Column | None = None) -> Column:
    """A scenario's name, else another name of the test; for single requests, else 'unknown'."""
    return F.coalesce(filled(scenario), filled(fallback) if otherwise is not None else fallback, *([] if otherwise is None else [otherwise]))
