import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagewright.llm import suffix_dedup as D


def marked(data, w):
    """For each byte, whether a run of w bytes covers it that starts anywhere else too: every run is counted."""
    seen = Counter(b[i : i + w] for b in data for i in range(len(b) - w + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out.append(gone)
    return out


def plain(texts, w, passage):
    data, out = [(t or "").encode() for t in texts], []
    for b, gone, short in zip(data, marked(data, w), marked(data, passage)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(short)))
    return out


def texts(rng, n, w):
    words = ["ab", "cd", "e", "fgh", "é", "ijkl", "m"] + [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(w // 5, w))) for _ in range(6)]
    out = [None, "", "x", "a" * 5 * w, "ab" * 4 * w, passages[0], passages[0]]
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, w // 2))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 5) : len(p) - rng.randint(0, w // 2)])
        out.append(" ".join(parts))
    for t in out[8:16]:
        i = len(t) // 2
        out += [t[:i] + "#" + t[i + 1 :], t, t[:i] + "##" + t[i:]]
    return out


@pytest.mark.parametrize("group, bucket, passage", [(10_000, 50_000, 40), (10_000, 7, 24), (2, 5, 24), (2, 50_000, 40)])
def test_against_every_run(spark, group, bucket, passage):
    rng = random.Random(group + bucket)
    found = texts(rng, 60, 40)
    df = spark.createDataFrame([(i if i != 20 else None, t) for i, t in enumerate(found)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.remove_repeats(df, window=40, gram=8, passage=passage, group=group, bucket=bucket).collect()}
    assert got == {(i if i != 20 else None): x for i, x in enumerate(plain(found, 40, passage))}


def test_one_passage_in_most_documents(spark):
    """A gram of more than half of all rows, each with other words around it, in buckets of a few contexts."""
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(12))
    around = lambda n: " ".join(f"{rng.randint(0, 99999)}" for _ in range(n))
    found = [f"{around(rng.randint(0, 9))} {passage} {around(rng.randint(0, 9))}" if i % 3 else around(20) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.remove_repeats(df, window=40, gram=8, passage=24, group=10, bucket=8).collect()}
    assert got == dict(enumerate(plain(found, 40, 24)))


def test_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(600))
    df = spark.createDataFrame([(1, t), (1, t), (2, "y" + t), (1, "short")], "doc_id long, text string")
    got = sorted(tuple(r) for r in D.remove_repeats(df).collect())
    assert got == sorted((i, *x) for i, x in zip([1, 1, 2, 1], plain([t, t, "y" + t, "short"], 400, 256)))
    assert D.remove_repeats(df.limit(0)).collect() == []


def test_clashing_columns(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(600))
    names = ["a", "b", "c", "h", "n", "spans", "copies", "n_bytes", "n_repeated", "at", "_row", "_text", "t"]
    df = spark.createDataFrame([(1, t), (2, "y" + t), (3, "short")], "doc_id long, text string")
    odd = df.select("*", *[F.lit("x").alias(c) for c in names])
    assert sorted(map(tuple, D.remove_repeats(odd).collect())) == sorted(map(tuple, D.remove_repeats(df).collect()))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in D.op3_suffix_dedup(spark, d).collect()}
    assert got == {i: x for (i, _), x in zip(docs, plain([t for _, t in docs], 400, 256))}


@pytest.mark.parametrize("hot", [2, 8, 32])
def test_buckets_of_split_grams_stay_bounded(hot):
    """However many grams are split, each with just over the contexts that one task may compare: no bucket holds more than some `bucket` contexts."""

    rng, group, bucket = random.Random(hot), 200, 500
    contexts = [(h, rng.getrandbits(64) - (1 << 63)) for h in (rng.getrandbits(63) for _ in range(hot)) for _ in range(group + 50)]
    spread = -(-len(contexts) // bucket)
    sizes = Counter(D.bucket_of(h, c, spread, 7) for h, c in contexts)
    assert min(sizes) >= 7 and len(sizes) == spread and max(sizes.values()) < 1.3 * bucket


def test_split_grams_count_single_windows_only_where_blocks_differ(spark, monkeypatch):
    """A passage of 240 bytes in 60 texts, each with other words around it: most blocks of offsets are settled as a whole."""
    rng, w, passage, seen = random.Random(6), 120, 100, []
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = word(240)
    found = [f"{word(80)}{common}{word(80)}" for _ in range(60)]
    strings_of = D.strings_of

    def counted(contexts, sizes):
        out = strings_of(contexts, sizes)
        seen.append(contexts.agg(F.sum(F.size("wanted"))).first()[0] if "wanted" in contexts.columns else D.twice(out).where("size > 0").count())
        return out

    monkeypatch.setattr(D, "strings_of", counted)
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.remove_repeats(df, window=w, gram=8, passage=passage, group=5).collect()}
    assert got == dict(enumerate(plain(found, w, passage)))
    shared, single = seen
    assert 0 < 2 * single < shared
