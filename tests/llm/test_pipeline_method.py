"""The near-dedup stage keeps one document of each of op8's components."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from triagewright.llm import simhash as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_keeps_one_of_each_component_of_op8(spark):
    rng = random.Random(4)
    texts = [None, "", "one two", "ONE  two"]
    for _ in range(12):
        w = [f"word{rng.randrange(2000)}" for _ in range(200)]
        texts += [" ".join(w), " ".join([*w[:-1], "last"]), " ".join(w[:150] + [rng.choice(w) for _ in range(50)])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    classes = M.near_classes(M.fingerprints(docs.select("doc_id", "text")))
    want = sorted(r[0] for r in classes.select("component_id").distinct().collect())
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == want and len(want) < len(texts)


def test_texts_of_one_fingerprint_are_one_component(spark):
    """A line that repeats decides every bit; by their sets of shingles these texts are far from 0.8 alike."""
    w = [f"word{i}" for i in range(3000)]
    line = "again and again the same few words stand in this line of text".split()
    texts = [" ".join(w[:20] + line * 300), " ".join(w[100:120] + line * 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    assert M.fingerprints(docs.select("doc_id", "text")).select("fingerprint").distinct().count() == 1
    assert [r.doc_id for r in P.near_dedup(spark, docs, "").collect()] == [0]


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "g h"), (None, "g h"), (None, "i j"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = M.near_deduped(docs).select(F.coalesce("doc_id", F.lit(0)), "text").collect()
    assert sorted(map(tuple, got)) == [(0, "g h"), (0, "i j"), (1, "a b c d")]
    assert M.near_deduped(docs.limit(0)).collect() == []


def test_copies_are_counted_and_not_written_out(spark, monkeypatch):
    """Ten copies of a document are one row that says so; the whole mixture is in the sums."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(4)], COLUMNS)
    mixed = docs.withColumns({"n_tokens": F.lit(5).cast("long"), "rate": F.col("doc_id") * 5.0, "copies": F.col("doc_id") * 5})
    monkeypatch.setattr(P, "mix", lambda *_: mixed)
    rows = P.mixing(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.copies, r.copy) for r in rows) == [(1, 5, 1), (2, 10, 1), (3, 15, 1)]
