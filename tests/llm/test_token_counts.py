import random

import pytest

from triagewright.llm import token_counts as T

PARTS = [" ", "  ", "\n", "a", "the", "▁", "é", "<s>", "\t", "中", " b", "\n\n", "word", "ß", " \n", "\r\n", "　", "\x00", "<0x0A>", "</s>", "thh entionea"]


def test_pretokens_add_up_to_the_library():
    sp, rng = T.encoder(T.model_path()), random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        found = T.units(t)
        assert (sum(T.lengths(sp, found)) if found else 0) == len(sp.encode(t)), t


def test_table(spark):
    sp = T.encoder(T.model_path())
    texts = [None, "", " ", "a b\nc", "the the the", "the the the", "é" * 3000 + " x" * 6000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.token_counts(df, entries=2).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}
    assert T.token_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    sp = T.encoder(T.model_path())
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in T.op5_token_counts(spark, d).collect()}
    assert got == want
