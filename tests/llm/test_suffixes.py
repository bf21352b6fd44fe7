import random
import sys

import numpy as np

from triagewright.llm import suffixes as X


def strings(rng, n):
    return [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_merge_keeps_order_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(400):
        parts = [sorted(strings(rng, rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
        runs = [X.decoded(*X.front_coded(p), [i] * len(p)) for i, p in enumerate(parts)]
        got = list(X.merged(runs))
        assert [g[0] for g in got] == sorted(s for p in parts for s in p)
        assert [g[1] for g in got[1:]] == [X.common_prefix(a[0], b[0]) for a, b in zip(got, got[1:])]


def test_anchor_is_the_windows_own():
    rng = random.Random(5)
    for n in (39, 40, 41, 300):
        text = bytes(rng.choice(b"abc ") for _ in range(n))
        at, h = X.anchors(text, 40, 8)
        g = X.gram_hashes(np.frombuffer(text, np.uint8), 8)
        want = sorted({i + min(range(33), key=lambda j: (int(g[i + j]) >> 20, j)) for i in range(n - 39)})
        assert at.tolist() == want and (h == g[at]).all()


def test_repeated_windows_against_all_pairs():
    rng = random.Random(8)
    for _ in range(300):
        m, w = rng.randint(2, 9), 10
        ctx = sorted({(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 10))), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))) for _ in range(m)})
        rights = [0, *(X.common_prefix(a[0], b[0]) for a, b in zip(ctx, ctx[1:]))]
        [got, short] = X.repeated(rights, [c[1] for c in ctx], (w, 6))
        for i, (r, l) in enumerate(ctx):
            for found, w in ((got, 10), (short, 6)):
                want = {o for o in range(w + 1) if o <= len(l) and w - o <= len(r) and any(j != i and l2[:o] == l[:o] and r2[: w - o] == r[: w - o] and len(l2) >= o and len(r2) >= w - o for j, (r2, l2) in enumerate(ctx))}
                assert {o for a, b in found[i] for o in range(a, b + 1)} == want


def nested(m, seed=2):
    """Contexts of which each shares another number of bytes with its neighbours on both sides, as (sorted bytes after, reversed bytes before)."""
    sizes = list(range(m))
    random.Random(seed).shuffle(sizes)
    return sorted((b"a" * (m + i) + b"b", b"c" * k + b"d") for i, k in enumerate(sizes))


def neighbours(ctx):
    return [0, *(X.common_prefix(a[0], b[0]) for a, b in zip(ctx, ctx[1:]))]


def test_nested_contexts_against_all_pairs():
    for m, w in ((20, 30), (60, 90), (60, 65)):
        ctx = nested(m)
        shares = lambda a, b, o: min(len(a[1]), len(b[1])) >= o and a[1][:o] == b[1][:o] and min(len(a[0]), len(b[0])) >= w - o and a[0][: w - o] == b[0][: w - o]  # noqa: B023, E731
        for c, found in zip(ctx, X.repeated(neighbours(ctx), [c[1] for c in ctx], (w,))[0]):
            assert {o for a, b in found for o in range(a, b + 1)} == {o for o in range(w + 1) if any(shares(c, other, o) for other in ctx if other is not c)}


def test_work_does_not_grow_with_the_depth_of_nesting():
    """Calls made for four times the contexts, nested four times as deep: near four times as many, not sixteen."""

    def calls(m):
        ctx, n = nested(m), 0
        rights, lefts = neighbours(ctx), [c[1] for c in ctx]

        def count(*_):
            nonlocal n
            n += 1

        sys.setprofile(count)
        try:
            X.repeated(rights, lefts, (m + m // 2, m))
        finally:
            sys.setprofile(None)
        return n

    assert calls(400) < 7 * calls(100)
