import hashlib

import regex
from pyspark.sql import functions as F

from triagewright.llm import fingerprints as P


def with_edits(rows):
    """(doc_id, text) in descending order, each with its edited text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        nxt = rows[(n + 1) % len(rows)][1]
        k = len(t) // 3
        out.append((i, t, t[: len(t) - k] + nxt[:k]))
    return out


def syncmers(text, k=P.K, s=P.S):
    """Closed syncmers in plain Python: (hash, units since the one before)."""
    from pyspark.sql import SparkSession

    units = regex.findall(r"[\p{L}\p{M}\p{N}]{1,3}|[^\p{L}\p{M}\p{N}\s]", text.lower())
    if not units:
        return []
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").select("i", F.xxhash64("u").alias("h"))
    h = [r.h for r in sorted(frame.collect())]
    tuples = [(n, i, *h[i : i + n]) for n in (s, k) for i in range(len(h) - n + 1)]
    deep = {}
    for n in (s, k):
        rows = [t[1:] for t in tuples if t[0] == n]
        if rows:
            names = [f"c{j}" for j in range(n)]
            got = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} long" for c in names)).select("i", F.xxhash64(*names).alias("x")).collect()
            deep[n] = [r.x for r in sorted(got)]
    at = [i for i in range(len(h) - k + 1) if min(deep[s][i], deep[s][i + k - s]) <= min(deep[s][i + 1 : i + k - s])]
    return [(deep[k][i] & 0xFFFFFFFF, min(255, i - (at[n - 1] if n else 0))) for n, i in enumerate(at)]


def hashes(found):
    return [x.h for x in found]


def test_against_plain_syncmers(spark):
    texts = ["The quick brown fox jumps over the lazy dog, and again over the lazy dog.", "Élan vital: 12,345 ünïts! " * 4, "one two three four five six seven"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.anchors(F.col("t")).alias("a")).collect()
    for r in got:
        want = syncmers(texts[r.i])
        assert [(x.h, x.gap) for x in r.a] == want or (not want and len(r.a) == 1)


def test_syncmers_are_context_free(spark):
    a = " ".join(f"word{i * 7919 % 1000}" for i in range(200))
    rows = [(0, a), (1, "zzz " + a), (2, a + " tail"), (3, a.upper()), (4, ""), (5, " \n"), (6, None), (7, "a b"), (8, "é" * 100_000)]
    got = {r.i: hashes(r.a) for r in spark.createDataFrame(rows, "i int, t string").select("i", P.anchors(F.col("t")).alias("a")).collect()}
    assert got[0] == got[3] and len(got[0]) > 60
    assert got[1][-len(got[0]) + 2 :] == got[0][2:] and got[2][: len(got[0]) - 2] == got[0][:-2]
    assert got[4] == got[5] == got[6] == [] and len(got[7]) == 1 and got[8]


def test_order_and_distance_count(spark):
    parts = [" ".join(f"w{i * (n + 3) * 7919 % 4001}" for i in range(60)) for n in range(4)]
    a, b = " ".join(parts), " ".join(reversed(parts))
    moved = " ".join(w for i in range(60) for w in (parts[0].split()[i], "x" * (i % 3)))
    rows = [(a, a), (a, b), (a, a + " tail"), (parts[0], moved), ("", None), ("", "word")]
    near = P.likeness(P.steps(P.anchors(F.col("a"))), P.steps(P.anchors(F.col("b"))))
    got = [r.n for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", near.alias("n")).orderBy("i").collect()]
    assert got[0] == 1 and 0.7 < got[1] < 1 and got[2] > 0.95 and got[3] < 0.5 and got[4:] == [1, 0], got


def test_every_window_has_an_anchor(spark):
    t = " ".join(f"w{i * i % 97}" for i in range(3000))
    u = spark.createDataFrame([(" ".join(t.split()[i : i + 12]),) for i in range(0, 2900, 7)], "t string")
    whole = set(hashes(spark.createDataFrame([(t,)], "t string").select(P.anchors(F.col("t")).alias("a")).first().a))
    for r in u.select(P.anchors(F.col("t")).alias("a")).collect():
        assert r.a and set(hashes(r.a)) <= whole


def test_next_document(spark):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(5000)] + [(7, "again"), (7, "again"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = sorted((r.doc_id, r.text, r.next_text) for r in P.with_next(df, "doc_id", "text", {}).collect())
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    assert got == sorted((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    one = P.with_next(df.limit(1), "doc_id", "text", {}).collect()
    assert len(one) == 1 and one[0].next_text == one[0].text
    assert P.with_next(df.limit(0), "doc_id", "text", {}).collect() == []


def plain_likeness(a, b):
    """Of two fingerprints as text, each anchor with its neighbour and distance."""
    sets = []
    for f in (a, b):
        x = [f[j : j + 10] for j in range(0, len(f), 10)]
        sets.append({(p[:8], q) for p, q in zip(x, x[1:])} if len(x) > 1 else {p[:8] for p in x})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in P.op1_fingerprints(spark, d).collect()}
    assert len(got) == len(docs)
    for i, t, e in with_edits(docs):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
    order = sorted(got, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]]):
        assert abs(got[i].near_next - plain_likeness(got[i].fingerprint, got[j].fingerprint)) < 1e-9
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > 0.3 for r in long) > 0.95 * len(long)
