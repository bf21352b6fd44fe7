"""Held-out accuracy of what is learned."""

import zlib


from triagewright.llm import language as L
from triagewright.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = L.op9_language(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(out) >= 0.97 * len(out)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_language(docs, train_rows=300)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the thing and the other " * 30_000), (4, "x"), (5, "\U0001d49e")]
    out = L.identify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang_score int"), model)
    got = sorted((r.doc_id, r.lang_pred, r.lang_rejected) for r in out.collect())
    assert [g[:2] for g in got[:3]] == [(1, "und"), (2, "und"), (3, "und")] and all(g[2] for g in got[:3])
    assert got[3][1] in model.langs and L.identify(docs.limit(0), model).collect() == []
    none = L.fit_language(docs.where("lang = 'xx'"))
    assert none is None and {r.lang_pred for r in L.identify(docs.limit(3), none).collect()} == {"und"}


def test_parts_of_a_long_text_count_once():
    table, text = L.letters(), "the quick brown fox jumps over the lazy dog " * 9000
    model = L.train([("the and of", "en"), ("der die das und", "de")] * 12)
    whole = L.features(L.codes_of(text, table))
    assert abs(len(whole) - 2 * len(text)) < len(text)
    assert L.score_batch([text, "the and", "der und"], model, table)[0] == ["en", "en", "de"]


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = X.op7_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
    out = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    right = sum((s >= 0.5) == bool(y) for y, s in out)
    assert right >= 0.9 * len(out)
    clean = [s for y, s in out if not y]
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark):
    rows = [(i, f"you are an awful person number {i}" if i % 4 == 0 else f"a quiet word about item {i}", i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "an awful person " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in X.score(docs, X.fit_toxicity(docs, labels)).collect()}
    assert got[902] > 0.5 and got[900] == got[901] and max(got[i] for i, _, y in rows if not y) < 0.5 < min(got[i] for i, _, y in rows if y)
    none = X.fit_toxicity(docs, labels.limit(0))
    assert max(r.toxic_score for r in X.score(docs, none).collect()) < 1e-9 and X.score(docs.limit(0), none).collect() == []


def test_label_model_discounts_voters_that_repeat_each_other():
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y)
    one = noisy(0.8)
    v = np.stack([one, one, one, noisy(0.85), noisy(0.85)], 1) * 2 - 1
    m = X.fit_label_model(v, 0.2)
    assert m.weight[:3].max() < m.weight[3:].min()
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.88
