"""Scoring texts with language models of the corpus: context-tree weighting over bytes, beside a count of words.

Both are learnt from the rows that `learn` marks, all of them, and score all rows. Texts are lower-cased in A-Z. The context trees (context_trees.py)
give log10 of a text's probability, its end included; the plain model that of its words (split at ASCII white space) and one end, each (c + 1) / (N + V + 1).

1. Each task counts its grams (five bytes of context and a byte) and words, in blocks, and sends each once; Spark sums them up.
2. Grams meet by their nearest three context bytes, sorted, so a task works through whole contexts, one after the other, and holds some hundred
   thousand grams (2^24 of one such context at the very most). Depths 5 to 3 come out; the nodes of depths 2 to 0, under five million in any UTF-8 text
   (167 * 154 + 64 * 115 contexts of fewer than 160 nodes), go through the driver to all tasks.
3. Every gram that occurs anywhere, in training or not, gets its log probability.
4. Texts are read again: frequent grams and words are looked up in broadcast tables of bounded size, the rest leaves as (row, gram, times)
   and is joined. No bound drops anything: results don't depend on how many are frequent.

Null texts count as empty: an end alone. A row whose `learn` is null isn't learnt from. Without training rows each bit has 1/2 and c, N and V are 0.
Repeated rows count and are scored each. An empty table gives an empty table. Columns of docs that are named like added ones are dropped, and so is the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common
from triagewright.llm import context_trees as T

#: Bytes of text a task counts at once, distinct entries that it keeps before it sends them, and rows of a batch that it sends.
BLOCK, HELD, SENT = 8_000_000, 3_000_000, 200_000
#: A broadcast table's entries at most.
GRAMS, WORDS = 1_000_000, 300_000
ADDED = ("n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def batches_of(columns: list[np.ndarray | list], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + SENT]) for c in columns], names=names)


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, learn) rows to (key, n, m): times of each gram in training rows and in all."""
    waiting: dict[bool, list[bytes]] = {True: [], False: []}
    size, parts, held = 0, [], 0

    def count() -> None:
        nonlocal size, held
        for learn, texts in waiting.items():
            if texts:
                blob, own = T.blob_of(texts)
                keys = T.grams(blob)[own]
                keys.sort()
                start = T.runs(keys)
                m = np.diff(np.r_[start, len(keys)])
                parts.append((keys[start], m if learn else np.zeros_like(m), m))
                held += len(start)
            texts.clear()
        size = 0

    def send() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if parts:
            keys, n, m = T.summed(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()
            held = 0
            yield from batches_of([keys.astype(np.int64), n, m], ["key", "n", "m"])

    for batch in batches:
        for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting[learn].append(t := lowered(text))
            size += len(t) + 1
            if size > BLOCK:
                count()
                if held > HELD:
                    yield from send()
    count()
    yield from send()


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, learn) rows to (word, n, m), as count_grams(). The end is the empty word."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def send() -> Iterator[pa.RecordBatch]:
        learnt, other = seen[True], seen[False]
        words = list(learnt.keys() | other.keys())
        n = [learnt.get(w, 0) for w in words]
        m = [k + other.get(w, 0) for w, k in zip(words, n)]
        learnt.clear()
        other.clear()
        if words:
            yield from batches_of([[w.decode() for w in words], n, m], ["word", "n", "m"])

    for batch in batches:
        for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[learn].update(lowered(text).split())
            seen[learn][b""] += 1
        if len(seen[True]) + len(seen[False]) > HELD // 6:
            yield from send()
    yield from send()


def local_trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, m) rows, of a key maybe several, to rows of two kinds: grams (key, n, m, q) and nodes of depth 2 (key, zeros, ones, below), summed up by the run."""
    parts = ((batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()) for batch in batches if batch.num_rows)
    none = lambda kind, n: pa.nulls(n, kind)
    names = ["kind", "key", "n", "m", "q", "zeros", "ones", "below"]
    for keys, n, m in T.whole_contexts(parts, 24, 300_000):
        start = T.runs(keys)
        keys, n, m = keys[start], np.add.reduceat(n, start), np.add.reduceat(m, start)
        q, nodes = T.deep(keys, n, 3)
        for i in range(0, len(keys), SENT // 4):
            own = slice(i, i + SENT // 4)
            rows = len(keys[own])
            packed = pa.Array.from_buffers(pa.binary(64), rows, [None, pa.py_buffer(np.ascontiguousarray(q[own]).tobytes())]).cast(pa.binary())
            real = none(pa.float64(), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int8)), pa.array(keys[own].astype(np.int64)), pa.array(n[own]), pa.array(m[own]), packed, real, real, real], names=names)
        short = ((nodes["key"] >> np.uint64(16)) << np.uint64(8)) | (nodes["key"] & np.uint64(255))
        key, zeros, ones, below = T.summed(short, nodes["zeros"], nodes["ones"], nodes["below"])
        rows, whole = len(key), none(pa.int64(), len(key))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows, np.int8)), pa.array(key.astype(np.int64)), whole, whole, none(pa.binary(), rows), pa.array(zeros), pa.array(ones), pa.array(below)], names=names)


def gram_scores(docs: DataFrame) -> DataFrame:
    """(key, m, lp): all grams of docs (text, learn), how often they occur and ln of their probability."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(count_grams, "key long, n long, m long")
    near = counted.repartition(F.shiftright("key", 24)).sortWithinPartitions("key")
    both = common.written(near.mapInArrow(local_trees, "kind byte, key long, n long, m long, q binary, zeros double, ones double, below double"), "trees")
    nodes = both.where("kind = 1").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    shallow = T.Shallow(nodes["key"].to_numpy().astype(np.uint64), *(nodes[c].to_numpy() for c in ("zeros", "ones", "below")))
    sent = spark.sparkContext.broadcast(shallow)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, 8)
                lp = sent.value.log_probability(batch.column(0).to_numpy().astype(np.uint64), q)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["key", "m", "lp"])

    out = common.written(both.where("kind = 0").select("key", "m", "q").mapInArrow(final, "key long, m long, lp double"), "grams")
    common.discard(both)
    return out


def frequent(table: DataFrame, entries: int) -> DataFrame:
    """The rows that occur most often (m), `entries` at most: those from a count on that a histogram of counts gives."""
    grade = F.floor(F.log2("m") * 8)
    steps = table.groupBy(grade.alias("grade")).agg(F.count("*").alias("rows")).orderBy(F.desc("grade")).collect()
    total, least = 0, None
    for r in steps:
        total += r.rows
        if total > entries:
            break
        least = r.grade
    return table.where(F.lit(False) if least is None else grade >= least)


def score_texts(docs: DataFrame, learn: Column, text: str = "text", grams: int = GRAMS, words: int = WORDS) -> DataFrame:
    """docs without its text, with ADDED: n_tokens words and end, n_known of them learnt, train_tokens (N), base_score, score (log10), and the trees' code length."""
    spark = docs.sparkSession
    common.small_batches(spark)
    slim = docs.select(F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    by_gram = gram_scores(slim)
    by_word = common.written(slim.mapInArrow(count_words, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "words")
    total = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    over = float(np.log10(total.n + total.v + 1))

    top = frequent(by_gram, grams).select("key", "lp").toArrow().sort_by("key")
    top_words = frequent(by_word, words).select("word", "n").toArrow()
    logs = dict(zip((w.encode() for w in top_words["word"].to_pylist()), np.log10(top_words["n"].to_numpy() + 1.0).tolist()))
    told = spark.sparkContext.broadcast((top["key"].to_numpy().astype(np.uint64), top["lp"].to_numpy(), logs))

    keep = [c for c in docs.columns if c not in (text, *ADDED)]
    packed = common.packed(docs.select(*[common.quoted(c) for c in keep], F.col(text).alias("text")) if text not in keep else docs, ("text",), text=F.col("text"))
    rows = packed.withColumn("uid", F.monotonically_increasing_id())
    added = "n_bytes long, n_tokens long, known long, base double, lp double, word array<string>, word_times array<long>, key array<long>, key_times array<long>"
    scored = common.written(common.with_arrow(rows, lambda: scorer(told.value), ["doc", "uid"], "text", added), "scored")

    left = lambda c: scored.select("uid", F.inline(F.arrays_zip(c, F.col(f"{c}_times").alias("times"))))
    of_words, of_grams = left("word").join(by_word.where("n > 0"), "word"), left("key").join(by_gram, "key")
    zero = F.lit(0.0)
    more = of_words.select("uid", (F.col("times") * F.log10(F.col("n") + 1)).alias("base"), zero.alias("lp"), F.col("times").alias("known"))
    more = more.unionByName(of_grams.select("uid", zero.alias("base"), (F.col("times") * F.col("lp")).alias("lp"), F.lit(0).cast("long").alias("known")))
    more = more.groupBy("uid").agg(*[F.sum(c).alias(f"more_{c}") for c in ("base", "lp", "known")])
    both = scored.drop("word", "word_times", "key", "key_times").join(more, "uid", "left")
    plus = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    score = plus("lp") / F.lit(float(np.log(10)))
    return both.select(
        *common.unpacked(keep), "n_bytes", "n_tokens", plus("known").alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (plus("base") - F.col("n_tokens") * over).alias("base_score"), score.alias("score"), (-plus("lp") / F.lit(T.LN2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def scorer(told: tuple) -> Callable[[str], tuple]:
    """What one text gives: sums over what the tables hold, and what they lack."""
    keys, lps, logs = told

    def of(text: str) -> tuple:
        low = lowered(text)
        seen = Counter(low.split())
        seen[b""] += 1
        base, known, unknown = 0.0, 0, []
        for w, times in seen.items():
            log = logs.get(w)
            if log is None:
                unknown.append(w)
            elif log:  # 0: not in training
                base += times * log
                known += times
        blob, _ = T.blob_of([low])
        found = T.grams(blob)
        found.sort()
        start = T.runs(found)
        times = np.diff(np.r_[start, len(found)])
        found = found[start]
        i = np.searchsorted(keys, found)
        i[i == len(keys)] = 0
        hit = keys[i] == found if len(keys) else np.zeros(len(found), bool)
        lp = float((times[hit] * lps[i[hit]]).sum())
        return len(low) + 1, sum(seen.values()), known, base, lp, [w.decode() for w in unknown], [seen[w] for w in unknown], found[~hit].astype(np.int64), times[~hit]

    return of


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 7 isn't 2, scores all."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score_texts(docs.withColumn("held_out", held), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
