"""Grouping of near-identical failures inside a report."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagewright.functions import text as T
from triagewright.plans.shared import written

# What each matching part adds to a pair's score, and where a locator conflict caps it.
STEP, EXCEPTION, LOCATOR, BODY, FRAME = 0.35, 0.25, 0.25, 0.15, 0.03
CAP = STEP + EXCEPTION - 0.01
PARTS = ("step", "exception", "locator", "error_body", "stack_frame", "has_error")


def score_columns(a: str = "a_", b: str = "b_") -> dict:
    """Columns that score a pair of failures, whose parts are prefixed."""
    x, y = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    step = (x("step") != "") & (x("step") == y("step"))
    exception = (x("exception") == y("exception")) & (x("exception") != "UNKNOWN")
    locator = x("locator") == y("locator")  # both absent match; one alone never does
    conflict = (x("locator") != "") & (y("locator") != "") & ~locator
    body = x("has_error") & y("has_error") & (x("error_body") == y("error_body"))
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    raw = part(step, STEP) + part(exception, EXCEPTION) + part(locator, LOCATOR) + part(body, BODY)
    frame = (x("stack_frame") != "") & (x("stack_frame") == y("stack_frame"))
    score = F.when(conflict, F.least(raw, F.lit(CAP))).when(frame, F.least(F.lit(1.0), raw + FRAME)).otherwise(raw)
    return {"step_match": step, "exception_match": exception, "locator_match": locator, "error_body_match": body, "score": score}


def pair_scores(parts: DataFrame) -> DataFrame:
    """Scored pairs of failures of a report that share a step; other pairs stay under 0.68. For looking into single reports."""
    side = lambda p: parts.select("report_id", F.col("step").alias("_step"), F.col("failure_idx").alias(f"{p}idx"), *[F.col(c).alias(p + c) for c in PARTS])
    pairs = side("a_").join(side("b_"), ["report_id", "_step"]).where("a_idx < b_idx AND _step <> ''")
    return pairs.select("report_id", "a_idx", "b_idx", *[c.alias(n) for n, c in score_columns().items()])


def scored_kinds(parts: DataFrame, tile: int = 1024) -> DataFrame:
    """(report_id, a_first, b_first, pairs, matches, score): pairs of distinct parts of a report that share a step, each by its first failure, and how many
    pairs of failures have them. A step with many distinct parts is compared in tiles of about `tile` by `tile`, which any task may take."""
    kinds = parts.where("step <> ''").groupBy("report_id", *PARTS).agg(F.count("*").alias("n"), F.min("failure_idx").alias("first"))
    tiles = kinds.groupBy("report_id", "step").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    dealt = kinds.join(tiles, ["report_id", "step"]).withColumn("_t", F.pmod(F.xxhash64("first"), F.col("_tiles")).cast("int"))

    def side(p: str, other: Column) -> DataFrame:
        place = F.struct(*([F.col("_t").alias("i"), F.col("o").alias("j")] if p == "a_" else [F.col("o").alias("i"), F.col("_t").alias("j")]))
        rows = dealt.withColumn("o", F.explode(other)).select("report_id", F.col("step").alias("_step"), place.alias("_tile"), F.col("n").alias(p + "n"), F.col("first").alias(p + "first"), *[F.col(c).alias(p + c) for c in PARTS])
        return rows

    both = side("a_", F.sequence("_t", F.col("_tiles") - 1)).join(side("b_", F.sequence(F.lit(0), F.col("_t"))), ["report_id", "_step", "_tile"])
    both = both.where("_tile.i < _tile.j OR a_first <= b_first")
    pairs = F.when(F.col("a_first") == F.col("b_first"), (F.col("a_n") * (F.col("a_n") - 1) / 2).cast("long")).otherwise(F.col("a_n") * F.col("b_n"))
    firsts = [F.least("a_first", "b_first").alias("a_first"), F.greatest("a_first", "b_first").alias("b_first")]
    return both.withColumn("pairs", pairs).where("pairs > 0").select("report_id", *firsts, "pairs", *[c.alias(n) for n, c in score_columns().items()])


def pair_totals(parts: DataFrame) -> DataFrame:
    """pair_scores() summed up by report, without its pairs: distinct parts are scored once and weighed by how many pairs of failures have them."""
    of = lambda c: F.sum(F.when(c, F.col("pairs")).otherwise(0))
    return scored_kinds(parts).groupBy("report_id").agg(
        F.sum("pairs").alias("pairs"), F.round(F.sum(F.col("score") * F.col("pairs")), 4).alias("total"), of(F.col("score") >= 0.8).alias("alike"), of(F.col("error_body_match")).alias("bodies")
    )


def score(a: tuple, b: tuple) -> float:
    """As score_columns(), for two rows in the order of PARTS."""
    raw = STEP * (a[0] != "" and a[0] == b[0]) + EXCEPTION * (a[1] == b[1] != "UNKNOWN") + LOCATOR * (a[2] == b[2]) + BODY * (a[5] and b[5] and a[3] == b[3])
    if a[2] != "" and b[2] != "" and a[2] != b[2]:
        return min(raw, CAP)
    return min(1.0, raw + FRAME) if a[4] != "" and a[4] == b[4] else raw


#: Of the parts that may match beside the locator: the column.
MATCHES = {"step": "step", "exception": "exception", "body": "error_body", "frame": "stack_frame"}


def says_something(match: str) -> Column:
    return F.col("has_error") if match == "body" else F.col(MATCHES[match]) != ("UNKNOWN" if match == "exception" else "")


def patterns(threshold: float, least: bool) -> list[tuple[str, tuple[str, ...], float]]:
    """(locator, matches, score): what pairs have in common that reach the threshold, at least. locator: same, one (alone) or other.

    More matches never score less. least: only such as need all of their matches to reach the threshold; else those whose score needs them all.
    """
    found = {}
    for locator, (x, y) in {"same": ("l", "l"), "one": ("l", ""), "other": ("l", "m")}.items():
        for n in range(len(MATCHES) + 1):
            for some in combinations(MATCHES, n):
                b = ["s" if "step" in some else "t", "e" if "exception" in some else "f", y, "b" if "body" in some else "c", "f" if "frame" in some else "g", True]
                found[locator, some] = score(("s", "e", x, "b", "f", True), tuple(b))
    reached = {k: v for k, v in found.items() if v >= threshold}
    fewer = lambda locator, some: (reached.get((locator, tuple(m for m in some if m != gone))) for gone in some)
    return [(loc, some, v) for (loc, some), v in reached.items() if all(f is None or not least and f < v for f in fewer(loc, some))]


def nearest(of: DataFrame, among: DataFrame, locator: str, some: tuple[str, ...]) -> DataFrame:
    """(report_id, first, rival): for each of the distinct parts `of`, the least first of those `among` that match it so; by aggregates over keys, without pairs."""
    keys = ["report_id", *(MATCHES[m] for m in some)]
    for m in some:
        of, among = of.where(says_something(m)), among.where(says_something(m))
    if locator == "same":
        keys, seen = [*keys, "locator"], among
    elif locator == "one":
        of, seen = of.withColumn("_bare", F.col("locator") != ""), among.withColumn("_bare", F.col("locator") == "")
        keys = [*keys, "_bare"]
    if locator != "other":
        return of.join(seen.groupBy(*keys).agg(F.min("first").alias("rival")), keys).select("report_id", "first", "rival")
    each = among.where("locator <> ''").groupBy(*keys, "locator").agg(F.min("first").alias("f"))
    best = each.groupBy(*keys).agg(F.min(F.struct("f", "locator")).alias("best"))
    second = each.join(best, keys).where(F.col("locator") != F.col("best.locator")).groupBy(*keys).agg(F.min("f").alias("second"))
    both = of.where("locator <> ''").join(best, keys).join(second, keys, "left")
    return both.select("report_id", "first", F.when(F.col("best.locator") != F.col("locator"), F.col("best.f")).otherwise(F.col("second")).alias("rival")).where("rival IS NOT NULL")


def leading(kinds: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct parts (report_id, PARTS, first) that lead: no leader before them reaches the threshold with them.

    In rounds: who has no open rival before it leads, and who has a leader before it follows; until none is open. Each round is written.
    """
    least = patterns(threshold, True)
    rivals = lambda of, among: reduce(DataFrame.unionByName, [nearest(of, among, loc, some) for loc, some, _ in least]).groupBy("report_id", "first").agg(F.min("rival").alias("rival"))
    open_, led = written(kinds, "kinds"), kinds.where("false")
    while not open_.isEmpty():
        free = open_.join(rivals(open_, open_), ["report_id", "first"], "left").where("rival IS NULL OR rival >= first").drop("rival")
        free = written(free, "leaders")
        led = led.unionByName(free)
        held = rivals(open_, free).select("report_id", "first")  # leaders match themselves
        open_ = written(open_.join(held, ["report_id", "first"], "left_anti").join(free.select("report_id", "first"), ["report_id", "first"], "left_anti"), "open")
    return led


def led_groups(parts: DataFrame, threshold: float) -> DataFrame:
    """Groups by the leader rule. A failure joins the best earlier leader that reaches the threshold, else leads.

    No pair scores more than equal parts do, so of parts that reach the threshold with themselves the first failure alone can lead, and later ones
    join the last leader before them that is better than all leaders before it. Of the leaders that match alike only the first can be that.
    """
    rows = parts.select("report_id", "failure_idx", *PARTS)
    kinds = written(rows.where(score_columns("", "")["score"] >= threshold).groupBy("report_id", *PARTS).agg(F.min("failure_idx").alias("first")), "kinds")
    led = leading(kinds, threshold)
    told = reduce(DataFrame.unionByName, [nearest(kinds, led, loc, some).withColumn("score", F.lit(v)) for loc, some, v in patterns(threshold, False)])
    best = told.groupBy("report_id", "first", "rival").agg(F.max("score").alias("score")).groupBy("report_id", "first").agg(F.array_sort(F.collect_list(F.struct("rival", "score"))).alias("r"))
    better = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x["score"] > F.element_at(a, -1)["score"], F.array_append(a, x)).otherwise(a)
    none = F.array().cast("array<struct<rival:bigint,score:double>>")
    chains = best.select("report_id", "first", F.aggregate("r", none, better)["rival"].alias("leaders"))
    same = F.struct("report_id", *PARTS).alias("_same")
    by_kind = kinds.join(chains, ["report_id", "first"]).select(same, "leaders")
    joined = rows.select("report_id", "failure_idx", same).join(by_kind, "_same", "left")
    before = F.array_max(F.filter("leaders", lambda i: i <= F.col("failure_idx")))
    return joined.select("report_id", "failure_idx", F.coalesce(before, "failure_idx").alias("group_idx"))


def keyed_groups(parts: DataFrame, keys: list[str], alone) -> DataFrame:
    """Groups that are equal in keys; failures that match nothing stay alone. A sum over few columns, and a join that Spark may split."""
    salt = F.when(alone, F.col("failure_idx"))
    rows = parts.select("report_id", "failure_idx", F.xxhash64(*keys).alias("_h"), *[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(salt, F.lit(-1)).alias("_alone"))
    rows = written(rows, "keys")  # the join reads them again: the patterns behind them are looked for once
    on = ["report_id", "_h", *[f"_{k}" for k in keys], "_alone"]
    first = rows.groupBy(*on).agg(F.min("failure_idx").alias("group_idx"))
    return rows.join(first, on).select("report_id", "failure_idx", "group_idx")


def group_failures(parts: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(report_id, failure_idx, group_idx): leader clustering of each report in order; a group is named by its first failure.

    parts: text.components(failures). As a pair's score takes few values, most thresholds come down to equality of keys:

    (0.78, 0.85]  step, exception and locator equal, with a step and a known exception
    (0.88, 1.0]   those whose error bodies are equal too, with an error
    above 1.0     every failure alone
    others        the leader rule, in rounds over distinct parts
    """
    alone = (F.col("step") == "") | (F.col("exception") == "UNKNOWN")
    three = ["step", "exception", "locator"]
    if threshold > 1.0:
        return parts.select("report_id", "failure_idx", F.col("failure_idx").alias("group_idx"))
    if threshold > 0.88:
        return keyed_groups(parts, [*three, "error_body"], alone | ~F.col("has_error"))
    if 0.78 < threshold <= 0.85:
        return keyed_groups(parts, three, alone)
    return led_groups(parts, threshold)


def representatives(groups: DataFrame, failures: DataFrame) -> DataFrame:
    """(report_id, group_idx, representative_idx, members): the first member with an image, else the first."""
    image = failures.select("report_id", "failure_idx", T.blank(F.col("failure_image")).alias("bare"))
    return (
        groups.join(image, ["report_id", "failure_idx"])
        .groupBy("report_id", "group_idx")
        .agg(F.min_by("failure_idx", F.struct("bare", "failure_idx")).alias("representative_idx"), F.count("*").alias("members"))
    )


def exact_groups(failures: DataFrame) -> DataFrame:
    """(report_id, exact_groups): how many groups the older exact signature gives."""
    signature = T.exact_signature(F.col("failed_step_line"), F.col("error_message"))
    return failures.select("report_id", signature.alias("s")).groupBy("report_id").agg(F.countDistinct("s").alias("exact_groups"))


def report_metrics(failures: DataFrame, groups: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row a report: failures, groups by either rule, model calls (one a group, even if history answers) and calls avoided.

    calls: (report_id, group_idx, attempt, vision, total_ms), adds retries, text and vision calls, and time.
    """
    found = groups.groupBy("report_id").agg(F.count("*").alias("failures"), F.countDistinct("group_idx").alias("groups"))
    out = found.join(exact_groups(failures), "report_id").withColumns({"calls": F.col("groups"), "calls_avoided": F.col("failures") - F.col("groups")})
    if calls is None:
        return out
    each = calls.groupBy("report_id", "group_idx").agg(F.count("*").alias("n"), F.min_by("vision", "attempt").alias("vision"), F.sum("total_ms").alias("ms"))
    sums = each.groupBy("report_id").agg(
        F.sum(F.col("n") - 1).alias("retries"), F.count_if(~F.col("vision")).alias("text_calls"), F.count_if("vision").alias("vision_calls"), F.sum("ms").alias("total_ms")
    )
    return out.join(sums, "report_id", "left").na.fill(0, ["retries", "text_calls", "vision_calls", "total_ms"])
