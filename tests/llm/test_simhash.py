import random

import numpy as np
import pytest
import xxhash

from triagewright.llm import simhash as S
from triagewright.llm.components import components


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, bits=2):
    """prints: list of (doc_id, fingerprint)."""
    left, out = set(range(len(prints))), {}
    while left:
        todo, part = [left.pop()], []
        while todo:
            i = todo.pop()
            part.append(i)
            near = {j for j in left if (prints[i][1] ^ prints[j][1]).bit_count() <= bits}
            left -= near
            todo += near
        for i in part:
            out[i] = min(prints[j][0] for j in part)
    return [out[i] for i in range(len(prints))]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_join_finds_every_pair(bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(12)}
    fp = np.array(sorted(fps), np.uint64)
    i, j = S.trie_pairs(np.zeros(len(fp), np.int64), fp, bits)
    got = {frozenset(map(int, p)) for p in zip(fp[i], fp[j])}
    assert len(got) == len(i)
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(300)] + [(-5, -5), (1000, -9), (1000, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_table(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    texts = [None, "", " \t", "one", "One two", "a" * 200_000]
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        texts += [b, b.upper()]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").select("doc_id", "text")
    prints = S.fingerprints(df)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_classes(prints).collect()}
    want = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: f & (1 << 64) - 1 for i, (f, _) in got.items()} == dict(want)
    assert [got[i][1] for i in range(len(texts))] == plain_classes(want)
    assert S.near_classes(prints.limit(0)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = [(i, plain_fingerprint(t)) for i, t in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op8_simhash(spark, d).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(want, plain_classes(want))}
