"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is cut into units: runs of up to three letters or digits of a lower-cased word, or one other visible character. A
closed syncmer is a run of K units whose least run of S units (by hash) stands at one of its edges. Whether a run is one
depends on that run alone, so an edit moves no anchor elsewhere, and every 2K - S - 1 units hold one. The fingerprint is
the anchors' hashes in the order of the text, 8 hex digits each; likeness is the Jaccard likeness of two fingerprints' sets.

Null texts count as empty. A text without units has an empty fingerprint, and two such are alike (1.0); one with units but no
anchor has the hash of all its units. A text with one anchor has one step, the anchor alone; steps that occur again count once. Repeated rows, and rows with one doc_id and several texts, follow each other in the order of
their texts; a row without doc_id comes last. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagewright.llm import common

UNIT = r"[\p{L}\p{M}\p{N}]{1,3}|[^\p{L}\p{M}\p{N}\s]"
K, S = 7, 2
#: Most ranges that the rows are cut into for finding the next document.
MAX_RANGES = 20_000
LEAST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """A text's closed syncmers in order, as array<struct<h, gap>>: the hash (32 bits, as a long), and units since the one before."""
    units = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))

    def of(u: Column) -> Column:
        one = F.transform(u, lambda x: F.xxhash64(x))
        n = F.size(u)
        at = lambda a, i, j: F.get(a, i + j)
        inner = lambda h: F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[at(h, i, j) for j in range(s)]))
        last = k - s

        def chosen(h: Column) -> Column:
            edge = lambda m: F.filter(
                F.sequence(F.lit(0), n - k),
                lambda i: F.least(at(m, i, 0), at(m, i, last)) <= F.least(*[at(m, i, j) for j in range(1, last)]),
            )
            anchor = lambda x: lambda i, m: F.struct(
                F.xxhash64(*[at(h, i, j) for j in range(k)]).bitwiseAND(0xFFFFFFFF).alias("h"), F.least(i - F.coalesce(F.get(x, m - 1), F.lit(0)), F.lit(255)).alias("gap")
            )
            return let(let(inner(h), edge), lambda x: F.transform(x, anchor(x)))

        whole = F.array(F.struct(F.xxhash64(F.array_join(u, " ")).bitwiseAND(0xFFFFFFFF).alias("h"), F.lit(0).alias("gap")))
        many = F.when(n >= k, let(one, chosen)).otherwise(F.array().cast("array<struct<h:bigint,gap:int>>"))
        return let(many, lambda a: F.when((F.size(a) == 0) & (n > 0), whole).otherwise(a))

    return let(units, of)


def as_text(found: Column) -> Column:
    """10 hex digits for each anchor."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(F.shiftleft(x["h"], 8) + x["gap"]), 10, "0")), ""))


def steps(found: Column) -> Column:
    """Each anchor with its neighbour and their distance, hashed."""
    first = lambda a: F.transform(a, lambda x: x["h"])
    pairs = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.xxhash64(F.get(a, i - 1)["h"], F.get(a, i)["h"], F.get(a, i)["gap"]))
    return let(found, lambda a: F.when(F.size(a) > 1, pairs(a)).otherwise(first(a)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of steps; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, 1.0).otherwise(both / n))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than key, looked up in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.lit(bounds[step - 1 :: step]), F.lit(bounds)
    below = lambda a: F.size(F.filter(a, lambda b: b < key))
    return let(below(coarse), lambda c: c * step + below(F.slice(fine, c * step + 1, step)))


def with_next(docs: DataFrame, key: str, text: str, made: dict[str, Column]) -> DataFrame:
    """docs with the columns of `made`, and next_<name> of text and of each of them: those of the row after it by descending key, at the end those of the first.

    Rows are dealt by ranges of the key, each bounded by a key that occurs; the row there goes to the range before it as well, so
    that text moves once and no task sees all rows.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(key), F.lit(LEAST))
    n = docs.count()
    ranges = int(min(MAX_RANGES, max(1, n // 200, 4 * common.partitions(spark) if n > 4000 else 1)))
    found = docs.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 10 * ranges)).alias("q"), F.max(order).alias("m")).first()
    bounds = sorted({*(found.q or [] if ranges > 1 else []), found.m} - {None}) or [LEAST]
    own = range_of(F.col("_key"), bounds)
    ahead = F.when(F.array_contains(F.lit(bounds), F.col("_key")), (F.col("_range") + 1) % len(bounds))
    spots = F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("extra")), F.when(ahead.isNotNull(), F.struct(ahead.alias("r"), F.lit(True).alias("extra")))))
    laid = (
        docs.withColumn("_key", order).withColumn("_range", own)
        .withColumn("_spot", F.explode(spots))
        .repartition(max(1, min(len(bounds), 4 * common.partitions(spark)) if len(bounds) > 1 else 1), "_spot.r")
        .select(*docs.columns, "_key", F.col("_spot.r").alias("_range"), F.col("_spot.extra").alias("_extra"))
    )
    seq = Window.partitionBy("_range").orderBy("_extra", F.desc("_key"), text)
    out = laid.withColumns(made)
    return out.withColumns({f"next_{c}": F.lead(c).over(seq) for c in [text, *made]}).where(~F.col("_extra")).drop("_key", "_range", "_extra")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = let(anchors(F.col("text")), lambda a: F.struct(as_text(a).alias("fingerprint"), steps(a).alias("steps")))
    rows = with_next(docs, "doc_id", "text", {"found": found})
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("other", let(anchors(F.col("edited")), lambda a: F.struct(as_text(a).alias("fingerprint"), steps(a).alias("steps"))))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("found.fingerprint").alias("fingerprint"), F.col("other.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("found.steps"), F.col("other.steps")).alias("near_edited"), likeness(F.col("found.steps"), F.col("next_found.steps")).alias("near_next"),
    )
