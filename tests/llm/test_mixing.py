import random

import numpy as np
import regex
from pyspark.sql import functions as F

from triagewright.llm import mixing as M


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(1)
    p, w, b = rng.dirichlet([0.5, 0.3, 0.2], 500), rng.integers(1, 400, 500), np.array([0.2, 0.7, 0.1])
    soft = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(w, p)], "n_tokens long, p array<double>").cache()
    steps = M.solve(soft, list(b))
    got = np.array([r.r for r in soft.select(M.rate(F.col("p"), steps).alias("r")).collect()])
    share = w / w.sum()
    assert got.min() >= 0 and np.abs((share * got) @ p - b).max() < 2e-5
    r = np.ones(500)  # plain projected gradient
    own = share @ p**2
    for _ in range(5000):
        r = np.maximum(0, r - 0.3 * p @ (((share * r) @ p - b) / own))
    assert np.abs((share * r) @ p - b).max() < 1e-3


def test_targets_out_of_reach_stay_nonnegative(spark):
    soft = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.5, 0.5]), (0, [0.0, 1.0])], "n_tokens long, p array<double>")
    steps = M.solve(soft, [0.0, 1.0])
    r = [x.r for x in soft.select(M.rate(F.col("p"), steps).alias("r")).collect()]
    assert min(r) >= 0 and r[0] < 1e-2
    assert M.solve(soft.limit(0), [0.5, 0.5]) == []


def test_table(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 3 else ["bad", "worse"]) + rng.choice(["", "x"]) for _ in range(30)), "s", 0.5) for i in range(300)]
    rows += [(301, None, "s", 0.5), (302, "", None, 0.5), (303, "a" * 50_000, "s", 0.5), (1, rows[1][1], "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
    labels = spark.createDataFrame([(i, "up" if i % 3 else "down") for i in range(200)], "doc_id long, domain string")
    out = M.mix(docs, labels, {"up": 0.2, "down": 0.8})
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:3] == ["doc_id", "text", "source"]
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    tokens = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens * r.posterior["down"] for r in got) / tokens - 0.8) < 1e-3
    right = [(r.posterior["up"] > 0.5) == bool(r.doc_id % 3) for r in got if r.doc_id < 300]
    assert sum(right) > 0.95 * len(right)
    assert M.mix(docs.limit(0), labels, {"up": 1.0}).collect() == []
    assert {tuple(r.posterior) for r in M.mix(docs, labels.limit(0), {}).collect()} == {("unknown",)}


def test_rare_domains_and_no_other_way_than_zero_rates(spark):
    """A domain of a thousandth, and one to be emptied."""
    rng = np.random.default_rng(4)
    p, w = rng.dirichlet([8, 0.01, 1.0], 3000), rng.integers(1, 900, 3000)
    soft = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(w, p)], "n_tokens long, p array<double>").cache()
    b = np.array([0.98, 0.001, 0.019])
    steps = M.solve(soft, list(b))
    got = np.array([r.r for r in soft.select(M.rate(F.col("p"), steps).alias("r")).collect()])
    assert got.min() >= 0 and np.abs((w / w.sum() * got) @ p - b).max() < 1e-4 and len(steps) < 60


def test_query_meets_its_targets(spark):
    """The rates against numpy's, from the query's own posteriors; and the posteriors against a plain classifier."""
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = M.op10_mixing(spark, d).collect()
        w = np.array([r.n_tokens for r in got], float)
        w /= w.sum()
        p = np.array([[r[f"p_{x}"] for x in M.DOMAINS] for r in got])
        b = np.array([M.TARGETS[x] for x in M.DOMAINS])
        rates = np.array([r.rate for r in got])
        assert np.abs(p.sum(1) - 1).max() < 1e-6 and np.abs((w * rates) @ p - b).max() < 1e-4
        r = np.ones(len(got))  # projected gradient in numpy
        for _ in range(M.ROUNDS):
            live = (p * (w * (r > 0))[:, None]).T @ p
            if np.abs((w * r) @ p - b).max() < 1e-6:
                break
            r = np.maximum(0, r - p @ np.linalg.solve(live + 1e-9 * np.trace(live) * np.eye(3), (w * r) @ p - b))
        assert np.abs(r - rates).max() < 1e-3 * max(1.0, r.max())


def test_posteriors_against_a_plain_classifier(spark):
    import xxhash

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = M.fit_domains(docs, M.label_domains(spark.read.parquet(f"{d}/labels.parquet")))
    some = docs.orderBy("doc_id").limit(60)
    bags = {r.doc_id: (r.f, r.t) for r in some.select("doc_id", M.features(M.words(F.col("text")), F.coalesce("text", F.lit(""))).alias("f"), "text").withColumnRenamed("text", "t").collect()}
    for r in M.posteriors(some, model).collect():
        f, t = bags[r.doc_id]
        words = [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
        assert r.n_tokens == len(words)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        assert {signed(xxhash.xxh64_intdigest(x.encode(), 42)) % M.BUCKETS for x in words} <= set(f) and len(f) == len(set(words)) + 6 and min(f[-6:]) >= M.BUCKETS and max(f) < M.SLOTS
        z = np.array([float(f"{b:.17g}") for b in model["prior"]]) + np.array([sum(float(f"{o[j]:.5g}") for j in f) for o in model["odds"]])
        e = np.exp(z - z.max())
        assert np.abs(np.array(r.p) - e / e.sum()).max() < 1e-6


def test_held_out_domains(spark):
    """Most held-out documents of each domain are told, by a model of the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    known = M.label_domains(labels).where(M.common.held_out(F.col("doc_id")))
    model = M.fit_domains(docs.select("doc_id", "text"), M.label_domains(labels))
    got = M.posteriors(docs.select("doc_id", "text").join(known, "doc_id"), model).collect()
    for name, least in (("clean", 0.93), ("low", 0.7), ("toxic", 0.75)):
        own = [model["domains"][max(range(3), key=lambda i: r.p[i])] == name for r in got if r.domain == name]
        assert sum(own) > least * len(own), (name, sum(own), len(own))
