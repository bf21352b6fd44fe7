"""Groups, links and counts against plain loops over whole-text tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from triagewright.llm import alignment as A
from triagewright.llm.token_counts import encoder, model_path


def plain_tokens(texts):
    """Tokens of whole texts, without units: (id, bytes) of A and of B, or none."""
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(model_path(A.A_MODEL)), encoder(model_path(A.B_MODEL))
    a.encode_special_tokens = True
    letters = A.byte_of_letter()
    for t in texts:
        if not t:
            yield [], []
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        of_a = [(i, bytes(letters[c] for c in token)) for i, token in zip(e.ids, e.tokens)]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        raw = (" " + t).encode()
        same = all(b"".join(x for _, x in side) == raw for side in (of_a, of_b))
        yield (of_a, of_b) if same else ([], [])


def spans(side):
    at = 0
    for i, raw in side:
        yield i, at, at + len(raw)
        at += len(raw)


def plain_alignment(texts):
    out = []
    for a, b in plain_tokens(texts):
        sa, sb = list(spans(a)), list(spans(b))
        links = [(i, j) for i, s, e in sa for j, t, f in sb if max(s, t) < min(e, f)]
        groups, ga, gb = [], [], []
        ends = {e for _, _, e in sa} & {e for _, _, e in sb}
        for end in sorted(ends):
            ga = [str(i) for i, _, e in sa if e <= end and e > (groups[-1][2] if groups else 0)]
            gb = [str(i) for i, _, e in sb if e <= end and e > (groups[-1][2] if groups else 0)]
            groups.append((ga, gb, end))
        out.append((len(sa), len(sb), len(groups), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y, _ in groups)))
    counts = Counter(p for *_, links, _ in out for p in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (na, nb, ng, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), text, hashlib.sha256(text.encode()).hexdigest() if text else "")
        for na, nb, ng, links, text in out
    ]


TEXTS = [
    "The quick  brown fox, isn't it?\n\n  indented\tTabs", "the quick brown fox", "naïve Überraschung — 東京 𝄞x", "a", " ", "\n", " leading and trailing ", "", None,
    "<|endoftext|> <s> </s> <unk> [INST]", "x▁y", "nul \x00 and \x1c \x85 nbsp end", "é" * 70 + " " + "ab" * 90, "don't we'll  'S 12345 3.14!!", "the quick brown fox", "ﬁ ligature ½",
]


@pytest.mark.parametrize("pairs", [10**6, 7, 0])
def test_alignment_equals_plain_loops(spark, pairs):
    rng = random.Random(2)
    alphabet = list("ab eé.\n'1 東") + ["th", " the ", "  "]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([(i % 5 or None, i, t, "old") for i, t in enumerate(texts)], "doc_id long, uid long, text string, n_a string").repartition(3)
    got = {r.uid: r for r in A.align(docs, pairs=pairs, groups=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_alignment(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.groups_sha256) == want, texts[i]


def test_pointers_double_to_the_end_of_their_chain():
    rng = random.Random(4)
    for _ in range(20):
        p = np.array([rng.randrange(i, min(i + 3, 200)) for i in range(200)])
        for i, end in enumerate(A.jumped(p)):
            while p[i] != i:
                i = p[i]
            assert i == end


def test_long_chain_in_one_group():
    """Tokens that never end together but at the end: one component, however long."""
    n = 5000
    a = A.Aligned(np.zeros(n, np.int32), np.zeros(n + 1, np.int32), np.full(n, 2), np.r_[1, np.full(n - 1, 2), 1], np.array([n]), np.array([n + 1]))
    assert a.groups == 1 and a.link_count.tolist() == [2 * n] and set(a.a_group) == set(a.b_group) == {0}


def test_small_blocks_and_caches_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, A.align(docs).collect()))
    for name, value in (("BLOCK", 10), ("CACHE", 3), ("LONGEST", 2), ("LATIN", "a"), ("HELD", 5)):
        monkeypatch.setattr(A, name, value)
    both = A.Pair(model_path(A.A_MODEL), model_path(A.B_MODEL))
    texts = TEXTS * 3
    rows = [r for lo, hi in A.blocks(texts) for r in A.aligned(both, texts[lo:hi]).written(both.names)]
    assert [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in rows] == [w[-1] for w in want]


def test_empty_table(spark):
    out = A.align(spark.createDataFrame([], "doc_id long, text string, groups string"))
    assert out.count() == 0 and out.columns == ["doc_id", *A.ADDED]


def test_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, plain_alignment([d.text[:400] for d in docs]))}
    table = spark.createDataFrame([(d.doc_id, d.text[:400]) for d in docs], "doc_id long, text string")
    for r in A.align(table).collect():
        assert tuple(r)[1:] == (*want[r.doc_id][:6], want[r.doc_id][7])
    assert A.op12_token_alignment(spark, "/root/testdata/sf0.001").count() == len(docs)


def test_each_text_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(TEXTS)), 3).map(told), "doc_id long, text string")
    assert A.align(docs, pairs=5).count() == len(TEXTS) == seen.value


def test_links_of_many_ids(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(map(tuple, A.align(docs, pairs=5).collect()))
    assert A.link_type(model_path(A.A_MODEL), model_path(A.B_MODEL)) == "u4"
    monkeypatch.setattr(A, "link_type", lambda *_: "i8")
    assert sorted(map(tuple, A.align(docs, pairs=5).collect())) == want
