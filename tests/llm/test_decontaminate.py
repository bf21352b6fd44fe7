import random
import re

import pytest

from triagewright.llm import decontaminate as D


def plain(text, items, size):
    """(n_words, n_hit, ids) by looking for each window at each word."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for win in {tuple(x[j : j + size]) for j in range(max(1, len(x) - size + 1))} if x else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("slice_bytes", [1_000_000, 30])
def test_against_plain_search(spark, slice_bytes):
    rng = random.Random(4)
    vocab = ["a", "b", "C", "dé", "E5", "f-g"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, make(rng.randint(1, 9))) for i in range(12)] + [(50, None), (51, "..."), (3, make(5))]
    docs = [(i, make(rng.randint(0, 60)), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (62, "a " * 30_000, "x"), (62, "a " * 30_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.decontaminate(df, bench, size=4, slice_bytes=slice_bytes).collect())
    assert got == sorted((i, *plain(t, items, 4)) for i, t, _ in docs)


def test_spans_lie_in_the_original(spark):
    df = spark.createDataFrame([(1, "Ünd: One, TWO three; four – five")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three"), (8, "five")], "item_id long, text string")
    r = D.decontaminate(df, bench).first()
    assert ["Ünd: One, TWO three; four – five"[s.start : s.end] for s in r.spans] == ["One, TWO three", "five"] and list(r["items"]) == ["7", "8"]
    assert D.decontaminate(df, bench.limit(0)).first().n_hit == 0 and D.decontaminate(df.limit(0), bench).collect() == []
    assert D.decontaminate_texts(df, bench).first().text.startswith("Ünd")
