"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte that a run of `window` bytes covers which starts anywhere else too is removed. Sorting every suffix isn't needed:
each run has an anchor, the start of the gram with the least hash in its first `passage` bytes, and equal runs have it at the same
offset; so suffixes are sorted at the anchors alone, of which there are some two in `passage` bytes. An anchor's context is what the runs
through it can hold. Runs of `passage` bytes (shorter ones than `window`, some 45 words) are told too, but not removed. The steps:

1. Texts are told apart by 128 bits of hash; equal ones count as one, which is removed whole if it has `window` bytes.
2. (gram, context) pairs are counted. A context that occurs twice is repeated whole. A gram with one context is done.
3. Tasks cut the other contexts from the texts, each once, and emit them as sorted, front-coded runs of suffixes, dealt by gram into
   buckets of about `bucket` contexts, however many there are, and at most `group` of each gram.
4. Each bucket's runs are merged by a loser tree that never compares known prefixes again. From the prefixes that neighbours
   share, and those of the reversed bytes before the anchors, follows which runs two contexts share, without pairs.
5. Offsets come back by context, are merged per text and cut out.

The contexts of a gram have to meet in step 4. Where it has more than `group` of them (a passage of a third of all documents, each with other
words around it) its contexts are dealt, with those of all such grams, over as many buckets of `bucket` as that takes (their merged order isn't used), and what they share is found by splitting the gram by longer strings:
first by what all runs of a block of offsets have in common and by all they cover, and where the one occurs twice but not the other by the runs themselves. Spark sums
those up anywhere.

Null texts count as empty. Shorter texts than `window` keep all. Repeated rows are copies of each other. An empty table gives an empty table.
Other columns of the input aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from triagewright.llm import common
from triagewright.llm import suffixes as X

WINDOW, PASSAGE, GRAM, GROUP, BUCKET = 400, 256, 32, 100_000, 50_000
#: Bytes of contexts that a task holds before it emits its runs.
HELD = 48_000_000
#: Offsets in a block of a split gram; tasks that what one string counts is dealt to.
WIDTH, SALTS = 16, 32
EMPTY = hashlib.sha256(b"").hexdigest()
OFFSETS = "array<struct<first:int,last:int>>"


def context_hash(text: bytes, at: int, before: int, window: int) -> int:
    import xxhash

    left = min(at, before)
    return xxhash.xxh3_64_intdigest(text[at - left : at + window], left) - (1 << 63)


def marked(docs: DataFrame, keep: list[str], text: str, window: int, passage: int, gram: int) -> DataFrame:
    """docs' kept columns with sha256 and the anchors: (gram hash, context hash, position)."""
    out = StructType([docs.schema[k] for k in keep] + StructType.fromDDL("sha string, anchors array<struct<h:long,c:long,at:int>>").fields)
    schema, before = to_arrow_schema(out), passage - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas, sizes, h, c, at = [], [0], [], [], []
            for t in b.column(text).cast(pa.binary()).to_pylist():
                shas.append(hashlib.sha256(t).hexdigest())
                pos, marks = X.anchors(t, passage, gram)
                where = pos.tolist()
                at += where
                h.append(marks.view(np.int64))
                c += [context_hash(t, i, before, window) for i in where]
                sizes.append(len(at))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(h) if h else []).cast(pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32())], fields=list(schema.field("anchors").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat).cast(schema.field("anchors").type)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(shas, pa.string()), lists], schema=schema)

    return docs.select(*keep, text).mapInArrow(run, out)


def bucket_of(h: int, c: int, spread: int, buckets: int) -> int:
    return buckets + (h ^ c) % spread if spread else h % buckets


def runs_of(texts: DataFrame, buckets: int, window: int, before: int) -> DataFrame:
    """(bucket, shared, rest, before, c, n): sorted runs of contexts. texts: text, wanted (array of h, c, at, n, spread).

    Grams go to the buckets by their hash. The contexts of those that are split go, all alike, to the `spread` buckets after these.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, found in sorted(held.items()):
                found.sort(key=lambda x: x[0])
                shared, rest = X.front_coded([x[0] for x in found])
                columns = [pa.array([v], t) for v, t in (
                    (bucket, pa.int64()), (shared, pa.list_(pa.int32())), (rest, pa.list_(pa.binary())),
                    ([x[1] for x in found], pa.list_(pa.binary())), ([x[2] for x in found], pa.list_(pa.int64())), ([x[3] for x in found], pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "shared", "rest", "before", "c", "n"])
            held.clear()

        for b in batches:
            for t, wanted in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist()):
                for w in wanted:
                    at, h = w["at"], w["h"]
                    suffix = (h + (1 << 63)).to_bytes(8) + t[at : at + window]
                    ahead = t[max(0, at - before) : at][::-1]
                    held.setdefault(bucket_of(h, w["c"], w["spread"], buckets), []).append((suffix, ahead, w["c"], w["n"]))
                    size += len(suffix) + len(ahead)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(run, "bucket long, shared array<int>, rest array<binary>, before array<binary>, c array<long>, n array<long>")


def compared(runs: DataFrame, buckets: int, windows: tuple[int, int]) -> DataFrame:
    """(h, c, n, offsets, passages, ahead, rest): which windows of either size another context holds too, as inclusive spans of bytes before the anchor;
    of grams that are split, the bytes before and after the anchor instead."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("offsets", kind), ("passages", kind), ("ahead", pa.binary()), ("rest", pa.binary())])
    number = lambda suffix: int.from_bytes(suffix[:8]) - (1 << 63)

    def of(group: Iterator[tuple[bytes, int, tuple]]) -> Iterator[tuple]:
        suffix, shared, lefts, loads = b"", [], [], []

        def close() -> Iterator[tuple]:
            if len(loads) > 1:
                h = number(suffix)
                for (c, n), spans, passages in zip(loads, *X.repeated([0, *shared[1:]], lefts, windows)):
                    if n == 1 and (spans or passages):
                        listed = [[{"first": a, "last": b} for a, b in x] for x in (spans, passages)]
                        yield h, c, n, *listed, None, None

        for s, k, (before, c, n) in group:
            if k < 8:
                yield from close()
                suffix, shared, lefts, loads = s, [], [], []
            shared.append(max(0, k - 8))
            lefts.append(before)
            loads.append((c, n))
        yield from close()

    def apart(group: Iterator[tuple[bytes, int, tuple]]) -> Iterator[tuple]:
        for s, _, (before, c, n) in group:
            yield number(s), c, n, None, None, before[::-1], s[8:]

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket's runs are merged at a time."""
        bucket, runs = -1, []

        def close() -> Iterator[pa.RecordBatch]:
            ready = []
            for row in (of if bucket < buckets else apart)(X.merged([X.decoded(r["shared"], r["rest"], zip(r["before"], r["c"], r["n"])) for r in runs])):
                ready.append(row)
                if len(ready) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*ready), schema)], schema=schema)
                    ready = []
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*ready), schema)], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != bucket:
                    yield from close()
                    bucket, runs = r["bucket"], []
                runs.append(r)
        yield from close()

    return runs.mapInArrow(merge, f"h long, c long, n long, offsets {OFFSETS}, passages {OFFSETS}, ahead binary, rest binary")


def strings_of(contexts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(h, c, n, size, k, low, high): a 128-bit hash, by gram and offset, of what the windows of each block of offsets have in common and (size negative) of all
    they cover, or of each window of the wanted blocks alone. contexts: h, c, n, ahead, rest, and wanted (array of size, k) for single windows."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("k", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])

    def parts(left: int, right: int, wanted: list[dict] | None) -> Iterator[tuple[int, int, int, int]]:
        """(size, k, start, end) from the anchor."""
        for size in sizes if wanted is None else ():
            o = range(max(0, size - right), left + 1)
            for k in range(o.start // WIDTH, -(-o.stop // WIDTH)) if len(o) else ():
                low, high = k * WIDTH, k * WIDTH + WIDTH - 1
                yield size, k, -low, size - high
                if o.start <= low and high < o.stop:
                    yield -size, k, -high, size - low
        for w in wanted or ():
            size, k = w["size"], w["k"]
            for i in range(max(0, size - right, k * WIDTH), min(left + 1, (k + 1) * WIDTH)):
                yield size, i, -i, size - i

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            held = []
            for r in b.to_pylist():
                text, left, h = r["ahead"] + r["rest"], len(r["ahead"]), r["h"]
                for size, k, start, end in parts(left, len(r["rest"]), r.get("wanted")):
                    d = xxhash.xxh3_128_intdigest(text[left + start : left + end], ((h * 1009 + size) * 1009 + k) % (1 << 64))
                    held.append((h, r["c"], r["n"], size, k, d % (1 << 64) - (1 << 63), (d >> 64) - (1 << 63)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)

    return contexts.mapInArrow(run, "h long, c long, n long, size int, k int, low long, high long")


def twice(strings: DataFrame) -> DataFrame:
    """Those strings that other contexts hold too; `leads` is true for one of the contexts of each. However often one occurs, it is counted and joined in SALTS parts."""
    salt = F.pmod(F.col("c"), F.lit(SALTS)).cast("int")
    rows = common.written(strings, "strings")
    each = rows.groupBy("low", "high", salt.alias("salt")).agg(F.sum("n").alias("n"), F.min("c").alias("lead"))
    some = each.groupBy("low", "high").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), F.collect_list("salt").alias("salts")).where("n > 1")
    found = some.select("low", "high", "lead", F.explode("salts").alias("salt"))
    return rows.withColumn("salt", salt).join(found, ["low", "high", "salt"]).select("h", "c", "n", "size", "k", (F.col("c") == F.col("lead")).alias("leads"))


def split(contexts: DataFrame, window: int, passage: int) -> DataFrame:
    """As compared(), for grams with too many contexts. contexts: h, c, n, ahead, rest, written.

    Contexts that share all that a block's windows cover share each of them: only one of these goes on to single windows, where others may find it.
    """
    sizes = tuple({window, passage})
    k, listed = F.col("k"), lambda when: F.collect_list(F.when(when, F.struct(F.abs("size").alias("size"), "k")))
    held = twice(strings_of(contexts, sizes)).groupBy("h", "c", "n")
    blocks = held.agg(listed(F.col("size") > 0).alias("common"), listed(F.col("size") < 0).alias("whole"), listed((F.col("size") < 0) & ~F.col("leads")).alias("led"))
    blocks = common.written(blocks.select("h", "c", "n", "whole", F.array_except("common", "led").alias("wanted")), "blocks")
    open_ = blocks.where(F.size("wanted") > 0).select(F.col("h").alias("_h"), F.col("c").alias("_c"), "wanted")
    again = contexts.join(open_, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))).drop("_h", "_c")
    single = twice(strings_of(again, sizes)).where("n = 1").select("h", "c", "size", k.alias("first"), k.alias("last"))
    whole = blocks.where("n = 1").select("h", "c", F.explode("whole").alias("w")).select("h", "c", "w.*")
    found = single.unionByName(whole.select("h", "c", "size", (k * WIDTH).alias("first"), (k * WIDTH + WIDTH - 1).alias("last")))
    spans = lambda size: F.collect_list(F.when(F.col("size") == size, F.struct("first", "last")))
    return found.groupBy("h", "c").agg(spans(window).alias("offsets"), spans(passage).alias("passages"))


def cut_out(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """docs' kept columns with n_removed, n_spans, kept_sha256 and the text that stays (as bytes). docs: also spans."""
    out = StructType([docs.schema[k] for k in keep] + StructType.fromDDL("spans array<struct<start:long,end:long>>, n_removed long, n_spans long, kept_sha256 string, kept binary").fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                spans = X.covered((s["start"], s["end"]) for s in found)
                rest = X.without(t, spans)
                rows.append(([{"start": a, "end": e} for a, e in spans], len(t) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            columns = [pa.array([r[i] for r in rows], schema.field(len(keep) + i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *columns], schema=schema)

    return docs.mapInArrow(run, out)


def same_rows(texts: DataFrame, found: DataFrame, row: str) -> DataFrame:
    """texts joined with what was found for the same row and text; null rows match too."""
    other = found.select(F.col(row).alias("_r"), F.col("a").alias("_a"), F.col("b").alias("_b"), *[c for c in found.columns if c not in (row, "a", "b")])
    return texts.join(other, F.col(row).eqNullSafe(F.col("_r")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).drop("_r", "_a", "_b")


def laid(spans: Column, size: int) -> Column:
    """Byte spans of a text's windows from offsets of its anchor. Columns: at, n_bytes."""
    clip = lambda s: F.struct(
        (F.col("at") - F.least(s["last"], F.col("at"))).cast("long").alias("start"),
        F.least(F.col("at").cast("long") - s["first"] + size, F.col("n_bytes")).alias("end"),
    )
    return F.filter(F.transform(spans, clip), lambda s: s["end"] - s["start"] >= size)


def union_bytes(spans: Column) -> Column:
    """How many bytes the spans cover together."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["at"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["end"], a["at"]).alias("at")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def repeated_spans(docs: DataFrame, text: str, row: str, window: int, passage: int, gram: int, group: int, bucket: int) -> DataFrame:
    """Each row of docs with its text's hashes a and b, n_bytes, sha256, copies, and the byte spans that are repeated; n_repeated counts those of passages.
    docs: `row` tells rows apart as far as their texts differ."""
    spark, before = docs.sparkSession, passage - gram
    hashed = [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")]
    slim = docs.select(row, text, *hashed, F.octet_length(text).cast("long").alias("n_bytes"))
    marks = common.written(marked(slim, [row, "a", "b", "n_bytes"], text, window, passage, gram), "marks")
    texts = marks.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(row).alias(row), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"))
    texts = common.written(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    places = texts.select("t", "n_bytes", F.explode("anchors").alias("x")).select("t", "n_bytes", "x.*")
    contexts = common.written(places.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("t", "at")).alias("place")), "contexts")
    grams = contexts.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    grams = common.written(grams.select("h", "m"), "grams")  # so that both sides of the join are dealt for it, and Spark may split a frequent gram
    told = grams.agg(F.sum("m").alias("all"), F.sum(F.when(F.col("m") > group, F.col("m"))).alias("apart")).first()
    spread = F.when(F.col("m") > group, -(-(told["apart"] or 0) // bucket)).otherwise(0)
    wanted = contexts.join(grams, "h").select("place.t", F.struct("h", "c", F.col("place.at").alias("at"), "n", spread.alias("spread")).alias("w"))
    holders = wanted.groupBy("t").agg(F.collect_list("w").alias("wanted")).join(texts.select("t", "a", "b", row), "t").select("a", "b", row, "wanted")
    tasks = common.partitions(spark)
    buckets = max(tasks, (told["all"] or 0) // bucket + 1)
    runs = runs_of(same_rows(slim.select(row, "a", "b", F.col(text).alias("text")), holders, row).select("text", "wanted"), buckets, window, before)
    merged = common.written(compared(runs.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket"), buckets, (window, passage)), "merged")
    found = merged.where("offsets IS NOT NULL").select("h", "c", "offsets", "passages")
    if told["apart"]:
        found = found.unionByName(split(merged.where("offsets IS NULL").select("h", "c", "n", "ahead", "rest"), window, passage))
    all_ = F.array(F.struct(F.lit(0).alias("first"), F.lit(before).alias("last")))
    whole = contexts.where("n > 1").select("h", "c", all_.alias("offsets"), all_.alias("passages"))
    offsets = common.written(found.unionByName(whole), "offsets")
    common.discard(contexts, grams, merged)
    both = places.join(offsets, ["h", "c"]).select("t", laid(F.col("offsets"), window).alias("s"), laid(F.col("passages"), passage).alias("p")).where((F.size("s") > 0) | (F.size("p") > 0))
    spans = both.groupBy("t").agg(F.flatten(F.collect_list("s")).alias("spans"), F.flatten(F.collect_list("p")).alias("passages"))
    spans = texts.join(spans, "t", "left").select("a", "b", "copies", "spans", union_bytes(F.coalesce("passages", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("n_repeated"))
    out = common.written(marks.select(row, "a", "b", "n_bytes", "sha").join(spans, ["a", "b"]), "spans")
    common.discard(marks, texts, offsets)
    return out


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, passage: int | None = None, group: int = GROUP, bucket: int = BUCKET
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_repeated), a row for each of docs; n_repeated: bytes that a string of `passage` bytes (PASSAGE, or
    the window if that is less) covers which starts anywhere else too. cut_out() gives what stays."""
    common.small_batches(docs.sparkSession)
    passage = passage or min(PASSAGE, window)
    base = docs.select(F.col(key).alias("_row"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = repeated_spans(base, "_text", "_row", window, passage, gram, group, bucket)
    several = F.col("copies") > 1
    gone = several & (F.col("n_bytes") >= window)
    some = ~gone & (F.size(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))) > 0)
    rows = rows.withColumn("n_repeated", F.when(several & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.col("n_repeated")))
    plain = rows.where(~some).select("_row", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.when(gone, EMPTY).otherwise(F.col("sha")).alias("kept_sha256"), "n_repeated")
    texts = base.select("_row", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(7), "_text").alias("b"), "_text")
    cut = same_rows(texts, rows.where(some).select("_row", "a", "b", "n_bytes", "n_repeated", "spans"), "_row")
    cut = cut_out(cut.select("_row", "n_bytes", "n_repeated", "_text", "spans"), ["_row", "n_bytes", "n_repeated"], "_text").drop("kept", "spans")
    return plain.unionByName(cut.select(plain.columns)).withColumnRenamed("_row", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
