import random

import pytest

from triagewright.llm import near_texts as N


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """Groups of (doc_id, text) by all pairs; each doc_id with its group's least."""
    left, out = list(range(len(rows))), {}
    sets = [grams(t) for _, t in rows]
    like = lambda i, j: (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    while left:
        todo, part = [left.pop()], []
        while todo:
            i = todo.pop()
            part.append(i)
            near = [j for j in left if like(i, j)]
            left = [j for j in left if j not in near]
            todo += near
        for i in part:
            out[i] = min(rows[j][0] for j in part)
    return out


@pytest.mark.parametrize("full", [64, 3])
def test_one_of_each_group_stays(spark, full):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(2000)]
    texts = [None, "", "", "one two", "one two", "x" * 100_000]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    groups = plain_groups(rows)
    want = {rows[i][0] for i, g in groups.items() if rows[i][0] == g}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first int")
    got = N.near_deduped(df, full=full)
    assert got.columns == df.columns
    got = [r.doc_id for r in got.collect()]
    if full > 3:
        assert sorted(got) == sorted(want)
    else:  # large blocks give two candidates a text: no group is split but where all its blocks miss the link
        assert want <= set(got) and len(got) <= 1.05 * len(want) and len(set(got)) == len(got)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h"), (None, "g h"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in N.near_deduped(df).collect()) == [(0, "g h"), (1, "a b c d e f")]
    assert N.near_deduped(df.limit(0)).collect() == []


def kept(spark, texts, **more):
    return sorted(r.doc_id for r in N.near_deduped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect())


def plain(texts):
    return sorted(set(plain_groups(list(enumerate(texts))).values()))


def test_equal_fingerprints_are_candidates(spark):
    """Copies that differ in case or white space alone, or in one word of 3,000, have equal fingerprints; a third text meets two such ones."""
    rng = random.Random(3)
    draw = lambda n: [f"word{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for n in (60, 200, 3000):
        w = draw(n)
        texts += [" ".join(w), " ".join(w).upper(), "  ".join(w)]
        w[n // 2] = "another"
        texts.append(" ".join(w))
    w = draw(3000)
    texts += [" ".join(w), " ".join(w[:-1] + ["last"])]
    assert kept(spark, texts) == plain(texts) == [0, 4, 8, 12]


def test_repeats_do_not_hide_a_copy(spark):
    """A line that repeats turns many bits of a fingerprint, but hardly changes the set of shingles."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        w = [f"word{rng.randrange(3000)}" for _ in range(300)]
        texts += [" ".join(w), " ".join(w[:100] + w[100:116] * 150 + w[116:])]
    assert kept(spark, texts) == plain(texts) == list(range(0, 24, 2))


def test_large_blocks_are_whole(spark):
    """Texts around one passage share their minima; copies among them are found, as by all pairs, however small a block counts as large."""
    rng = random.Random(11)
    draw = lambda n: [f"word{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = draw(200), []
    for _ in range(50):
        w = passage + draw(60)
        again = list(w)
        for at in rng.sample(range(len(w)), 4):
            again[at] = "other"
        texts += [" ".join(w), " ".join(again)]
    rng.shuffle(texts)
    assert kept(spark, texts, full=3) == plain(texts)


def test_across_gives_all_similar_pairs_of_different_roots(spark):
    rng = random.Random(13)
    sets = []
    for _ in range(8):
        base = sorted(rng.sample(range(-(2**31), 2**31), 40))
        sets += [sorted({*rng.sample(base, 38), *rng.sample(range(100), rng.randint(0, 4))}) for _ in range(6)]
    root = [i if i % 3 else 0 for i in range(len(sets))]
    df = spark.createDataFrame([(i, root[i], s) for i, s in enumerate(sets)], "id long, root long, s array<int>")
    rows = N.prefixes(df, 0.8).join(df.select("id", "root"), "id")
    close = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and close(sets[i], sets[j])}
    for piece in (2, 1000):
        got = {(r.a, r.b) for r in N.across(rows, 0.8, piece).collect()}
        assert want and want <= got and all(root[a] != root[b] for a, b in got)
