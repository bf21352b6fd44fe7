"""Requests that share an id, in order: each finds what those before it recorded, and is asked only if that can't be reused.

Done one after the other, a request looks its id up, reuses the record or asks a model, and an answer that can be read becomes the record. settle() gives
the same by aggregates and one ordered pass:

* A record that has a request's picture came from the last request before it that had one and left a record (a `setter`; forced requests are setters
  too). Whether that one asked or reused, its picture is the record's. So a request with a picture reuses if the last setter had the same one and its
  answer is complete, or if the record of history matches and no other setter came before.
* A request without picture reuses any complete record. If the last setter's isn't, the first such request after it asks, and the others do if that
  answer isn't complete either.
* A record found by the legacy id only counts from the first such request on, and if nothing was recorded before.

The ordered pass is cut into pieces by ranges of (id, order), so a frequent id is spread over tasks; what comes before a piece is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagewright.functions import text as T
from triagewright.operators import history as H
from triagewright.plans.shared import written


def picture(c: Column) -> Column:
    return F.lower(T.screenshot_hash(c))


def asks_of(matched: DataFrame, order: list[str]) -> DataFrame:
    """(failure_id, picture, ask, request columns): the first request of each id and picture. `ask` names the two."""
    keyed = matched.withColumn("picture", picture(F.col("failure_image")))
    rest = [c for c in matched.columns if c != "failure_id" and not c.startswith("fb_")]
    first = keyed.groupBy("failure_id", "picture").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select("failure_id", "picture", F.concat_ws("#", "failure_id", "picture").alias("ask"), "r.*")


def answers_of(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """answers by `ask`: those with the ask's picture in screenshot_hash, or else those of its id without any. given_for: that picture or null."""
    if "screenshot_hash" not in answers.columns:
        answers = answers.withColumn("screenshot_hash", F.lit(None).cast("string"))
    answers = answers.withColumn("given_for", F.lower(T.filled(F.col("screenshot_hash"))))
    both = asks.select("failure_id", "picture", "ask").join(answers, "failure_id").where("given_for IS NULL OR given_for = picture")
    best = both.groupBy("ask").agg(F.max(F.col("given_for").isNotNull()).alias("_own"))
    return both.join(best, "ask").where(F.col("_own") == F.col("given_for").isNotNull()).drop("_own", "picture", "screenshot_hash")


def before(rows: DataFrame, key: str, order: str, **wanted: Column) -> DataFrame:
    """rows with, for each name, the last value that isn't null of the rows before, by key and order (a struct).

    Rows are cut by ranges, so that no key has to fit a task; a piece gets what the last one before it had.
    """
    cut = written(rows.withColumns({f"_{n}": c for n, c in wanted.items()}).repartitionByRange(key, order).withColumn("_piece", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_piece", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(key, "_piece").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_{n}") for n in wanted])
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_piece", *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_carried_{n}") for n in wanted])
    own = cut.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(inside) for n in wanted})
    both = own.join(carried, [key, "_piece"])
    return both.withColumns({n: F.coalesce(n, f"_carried_{n}") for n in wanted}).drop("_piece", *[f"_{n}" for n in wanted], *[f"_carried_{n}" for n in wanted])


def settle(matched: DataFrame, told: DataFrame, order: list[str]) -> DataFrame:
    """For each request (of match_history(); named by `order`, which has to be unique): (order, failure_id, picture, origin, record, source).

    told: (failure_id, picture, complete, seen) of the answers that can be read. origin: ASKED, HISTORY (answered by the record of history) or REPEAT (by
    what an earlier request recorded). record: the picture of the answer that it gets. source: what the response is called.
    """
    forced = F.coalesce("force_reanalysis", F.lit(False)) if "force_reanalysis" in matched.columns else F.lit(False)
    kept = F.struct(
        F.coalesce(H.is_complete("fb_"), F.lit(False)).alias("complete"),
        F.coalesce(~T.blank(F.col("fb_screenshot_observation")), F.lit(False)).alias("seen"), F.lower("fb_screenshot_hash").alias("picture"),
    )
    rows = matched.select("failure_id", F.struct(*order).alias("at"), picture(F.col("failure_image")).alias("picture"), forced.alias("forced"), "matched_by", F.when(F.col("matched_by").isNotNull(), kept).alias("kept"))
    key = F.struct("failure_id", "picture").alias("_key")
    known = told.select(key, F.lit(True).alias("ok"), "complete", "seen")
    rows = rows.withColumn("_key", key).join(known, "_key", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    image = F.col("picture").isNotNull()
    rows = rows.select("failure_id", "at", "picture", "forced", "matched_by", "kept", *map(no, ("ok", "complete", "seen")))
    rows = written(rows.withColumn("sets", F.col("ok") & (F.col("forced") | image)), "repeats")

    # what history has under the id, from when on, and until which setter it stands
    each = rows.groupBy("failure_id").agg(
        F.max(F.when(F.col("matched_by") == "exact", F.col("kept"))).alias("exact"),
        F.min(F.when(F.col("matched_by") == "legacy", F.struct("at", "kept"))).alias("legacy"),
        F.min(F.when(F.col("ok"), F.col("at"))).alias("first_ok"),
    )
    alias = F.col("exact").isNull() & (F.col("first_ok").isNull() | (F.col("first_ok") >= F.col("legacy.at")))
    each = each.select("failure_id", "first_ok", F.coalesce("exact", F.when(alias, F.col("legacy.kept"))).alias("past"), F.when(alias, F.col("legacy.at")).alias("since"))
    kinds = rows.where("sets").groupBy("failure_id", "picture", "forced").agg(F.min("at").alias("at")).join(each, "failure_id")
    broken = kinds.where(F.col("forced") | ~F.col("picture").eqNullSafe(F.col("past.picture"))).groupBy("failure_id").agg(F.min("at").alias("until"))
    each = each.join(broken, "failure_id", "left")

    bares = ~F.col("forced") & ~image
    told_before = before(
        rows, "failure_id", "at",
        setter=F.when(F.col("sets"), F.struct("picture", "complete", "seen", "at")),
        bare_last=F.when(F.col("sets") | bares, ~F.col("sets")),
    ).join(each, "failure_id")
    has_past = F.col("past").isNotNull() & (F.col("since").isNull() | (F.col("at") >= F.col("since")))
    stands = lambda at: F.col("until").isNull() | (at < F.col("until"))
    by_past = F.coalesce(has_past & stands(F.col("at")) & F.col("past.complete") & F.col("past.seen") & (F.col("past.picture") == F.col("picture")), F.lit(False))
    by_setter = F.coalesce((F.col("setter.picture") == F.col("picture")) & F.col("setter.complete") & F.col("setter.seen"), F.lit(False))
    # without a picture: is the record complete, and whose is it?
    past_now = has_past & F.col("past.complete") & (F.col("setter").isNull() | (stands(F.col("setter.at")) & F.col("past.seen")))
    setter_now = F.col("setter").isNotNull() & F.col("setter.complete")
    repeat_bare = F.coalesce("bare_last", F.lit(False)) & F.col("ok") & F.col("complete")
    origin = F.when(F.col("forced"), "ASKED").when(
        image, F.when(by_past, "HISTORY").when(by_setter, "REPEAT").otherwise("ASKED")
    ).otherwise(F.when(F.coalesce(past_now, F.lit(False)), "HISTORY").when(setter_now | repeat_bare, "REPEAT").otherwise("ASKED"))
    asked = F.col("origin") == "ASKED"
    record = F.when(asked | image, F.col("picture")).when(setter_now, F.col("setter.picture"))
    found = has_past | (F.col("first_ok") < F.col("at"))
    source = F.when(F.col("forced"), "AI").when(~asked, "HISTORICAL").when(F.coalesce(found, F.lit(False)), "AI_ENRICHED").otherwise("AI")
    out = told_before.withColumn("origin", origin).withColumn("record", F.when(F.col("origin") != "HISTORY", record)).withColumn("source", source)
    return out.select("at.*", "failure_id", "picture", "origin", "record", "source")
