"""Context-tree weighting against a plain recursion, and the word model against sums."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagewright.llm import lm

DEPTH = 5


def nodes_of(data):
    """counts[(context bytes, bits so far)] = [zeros, ones], of all depths."""
    counts = {}
    for context, byte in data:
        for d in range(DEPTH + 1):
            for k in range(8):
                at = counts.setdefault((context[:d], byte >> (8 - k) | 1 << k), [0, 0])
                at[byte >> (7 - k) & 1] += 1
    return counts


def steps(text):
    low = (text or "").encode().lower()
    padded = b"\xff" * DEPTH + low + b"\xff"
    return [(bytes(reversed(padded[i : i + DEPTH])), padded[i + DEPTH]) for i in range(len(low) + 1)]


def kt(z, o):
    return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)


def plain_model(texts):
    counts = nodes_of([s for t in texts for s in steps(t)])
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    below = {}

    def weight(key):
        own = kt(*counts[key])
        if len(key[0]) == DEPTH:
            return own
        below[key] = sum(weight(c) for c in children[key])
        return math.log(0.5 * math.exp(own - below[key]) + 0.5) + below[key] if own - below[key] < 500 else own - math.log(2)

    for key in list(counts):
        if not key[0]:
            weight(key)

    def log_probability(text):
        total = 0.0
        for context, byte in steps(text):
            for k in range(8):
                node, bit, said = byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1, None
                for d in range(DEPTH, -1, -1):
                    key = (context[:d], node)
                    if key in counts:
                        z, o = counts[key]
                        estimate = ((o if bit else z) + 0.5) / (z + o + 1)
                        if said is None:
                            said = estimate
                        else:
                            ratio = math.exp(kt(z, o) - below[key])
                            said = (ratio * estimate + said) / (1 + ratio)
                total += math.log10(0.5 if said is None else said)
        return total

    return log_probability


def base_score(text, learnt):
    c = Counter(w for t in learnt for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    own = [*(text or "").encode().lower().split(), b""]
    return sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), len(own), sum(c[w] > 0 for w in own), n


@pytest.mark.parametrize("grams, words", [(10**6, 10**5), (40, 5), (0, 0)])
def test_scores_equal_a_plain_recursion(spark, grams, words):
    rng = random.Random(5)
    vocabulary = ["ab", "Abc", "été", "x y", "日本", "a", "zz\x0bq", "𝄞", "the"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "the " * 500, "  the\t\n the\x1cthe", "the", "the"]
    rows = [(i if i % 9 else None, t, i % 4 != 2 if i % 11 else None, "n", float(i)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score string, uid double").repartition(3)
    got = {int(r.uid): r for r in lm.score_texts(docs, F.col("learn"), grams=grams, words=words).collect()}
    learnt = [t for _, t, own, _, _ in rows if own]
    model = plain_model(learnt)
    assert len(got) == len(rows)
    for i, (_, text, _, _, _) in enumerate(rows):
        base, n, known, train = base_score(text, learnt)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(model(text), rel=1e-9)


def test_probabilities_of_the_next_byte_sum_to_one():
    import numpy as np

    from triagewright.llm import context_trees as T

    blob, own = T.blob_of([b"abracadabra", b"cadab", b"aaaa"])
    learnt = T.grams(blob)[own]
    for context in {*(learnt >> np.uint64(8)).tolist(), 0x7A7A7A7A7A, int.from_bytes(b"aaaaz", "big"), int.from_bytes(b"azzzz", "big")}:
        asked = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        keys, n = T.summed(np.r_[learnt, asked], np.r_[np.ones(len(learnt), np.int64), np.zeros(256, np.int64)])
        q, nodes = T.deep(keys, n, 3)
        short = ((nodes["key"] >> np.uint64(16)) << np.uint64(8)) | (nodes["key"] & np.uint64(255))
        lp = T.Shallow(*T.summed(short, nodes["zeros"], nodes["ones"], nodes["below"])).log_probability(keys, q)
        assert np.exp(lp[np.isin(keys, asked)]).sum() == pytest.approx(1)


def test_nothing_learnt_and_nothing_there(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-24 * math.log10(2)) and got[2].score == pytest.approx(-8 * math.log10(2))
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].n_tokens == 2 and got[1].train_tokens == 0
    assert lm.score_texts(docs.where("false"), F.lit(True)).count() == 0


def test_blocks_and_whole_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([(t, i % 3 > 0) for i, t in enumerate(texts)], "text string, learn boolean").coalesce(1)
    want = [r.score for r in lm.score_texts(docs, F.col("learn")).collect()]
    model = plain_model([t for i, t in enumerate(texts) if i % 3])
    assert sorted(want) == pytest.approx(sorted(map(model, texts)))


def test_contexts_are_never_split():
    import numpy as np

    from triagewright.llm import context_trees as T

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 30, 5000).astype(np.uint64))
    parts = [(keys[i : i + 97], np.ones(len(keys[i : i + 97]), np.int64)) for i in range(0, len(keys), 97)]
    out = list(T.whole_contexts(parts, 24, 300))
    assert np.array_equal(np.concatenate([k for k, _ in out]), keys) and len(out) > 3
    for (a, _), (b, _) in zip(out, out[1:]):
        assert a[-1] >> np.uint64(24) != b[0] >> np.uint64(24)


def test_query_counts_as_stated(spark):
    out = {r.doc_id: r for r in lm.op13_lm_scores(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    learnt = [d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2]
    assert len(out) == len(docs)
    for d in docs[::7]:
        base, n, known, train = base_score(d.text, learnt)
        r = out[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, zlib.crc32(str(d.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
