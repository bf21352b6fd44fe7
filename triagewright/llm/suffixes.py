"""Sorted suffixes: anchors, front-coded runs, loser-tree merging and what their common prefixes tell.

Helpers of suffix_dedup that run inside tasks, on bytes of bounded length.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator

import numpy as np

#: Gram starts handled at once, so that memory doesn't grow with a text; positions take the low 20 bits of a key.
STEP = 1 << 19
LOW = np.uint64((1 << 20) - 1)
BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes; gram is a power of two."""
    h, width = BYTES[data], 1
    power = BASE
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, key
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(key) - width + 1], out[width - reach :]) if width > reach else out


def anchors(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): for each run of `window` bytes, where its gram with the least hash starts, the leftmost of equals.

    The choice depends on the bytes of the run alone, so equal runs have their anchor at the same offset.
    """
    width, n = window - gram + 1, len(text)
    if n < window:
        return np.array([], np.int64), np.array([], np.uint64)
    data, at, marks = np.frombuffer(text, np.uint8), [], []
    for start in range(0, n - window + 1, STEP):
        h = gram_hashes(data[start : start + STEP + window - 1], gram)
        low = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), width) & LOW
        own = low[np.concatenate([[True], low[1:] != low[:-1]])].astype(np.int64)
        at.append(own + start)
        marks.append(h[own])
    at, marks = np.concatenate(at), np.concatenate(marks)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    return at[first], marks[first]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree and aren't compared again."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as (bytes shared with the one before, the rest)."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:]))][: len(strings)]
    return shared, [s[k:] for s, k in zip(strings, shared)]


Item = tuple[bytes, int, object]


def decoded(shared: Iterable[int], rest: Iterable[bytes], loads: Iterable) -> Iterator[Item]:
    """(string, bytes shared with the one before, load) of a front-coded run."""
    last = b""
    for k, r, load in zip(shared, rest, loads):
        last = last[:k] + r
        yield last, k, load


def merged(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """One sorted run from many, by a loser tree; again with the bytes shared with the string before.

    Each loser keeps how much it shares with the last winner on its path. Of two heads, the one that shares more with the last
    output is the lesser; only if both share as much are they compared, and only beyond that.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[Item | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size  # bytes that a head shares with the winner it last met
    tree = [0] * size  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), the lower run first on ties."""
        x, y = heads[a], heads[b]
        if y is None or x is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x[0], y[0]
        k = common_prefix(s, t, known[a])
        less = k == len(s) and (k < len(t) or a < b) or k < len(s) and k < len(t) and s[k] < t[k]
        winner, loser = (a, b) if less else (b, a)
        known[loser] = k
        return winner, loser

    winners = list(range(size))
    while len(winners) > 1:
        base, up = len(winners) // 2, []
        for i in range(base):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            tree[base + i] = loser
            up.append(w)
        winners = up
    best = winners[0]
    while (head := heads[best]) is not None:
        yield head[0], known[best], head[2]
        heads[best] = after = next(runs[best], None)
        known[best] = after[1] if after else 0
        node = (best + size) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


def repeated(rights: list[int], lefts: list[bytes], windows: tuple[int, ...]) -> list[list[list[tuple[int, int]]]]:
    """For contexts around one gram, sorted by what follows, and each size of window: the offsets (first, last) of windows that another context holds too.

    rights[i]: bytes that follow in both context i and i - 1; lefts[i]: the reversed bytes before the anchor. Two contexts that share `right` bytes
    after the anchor and `left` before it share the windows that start window - right to left bytes before it. Neighbours in the right order are
    joined to groups, those that share most first, the smaller into the larger. Who is joined meets its neighbours in the left order alone: with
    any other of the group one of the two shares no more than with a context nearer to it. That makes m log m meetings, however deep the prefixes nest.
    """
    m = len(lefts)
    order = sorted(range(m), key=lefts.__getitem__)
    ahead = [lefts[i] for i in order]
    close = [0, *map(common_prefix, ahead, ahead[1:])]
    place = sorted(range(m), key=order.__getitem__)
    held = [[p] for p in place]  # at both ends of a group: its places in the left order, ascending
    ends = list(range(m))  # at either end of a group: the other end
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in range(m)] for _ in windows]
    best, least, most = [-1] * m, min(windows), max(close)

    def meet(p: int, q: int, right: int) -> None:
        """Of places p < q. As `right` only falls, who shares no more to the left than before adds nothing."""
        left = min(close[p + 1], close[q])  # at most
        if left < least - right or left <= best[p] and left <= best[q]:
            return
        if q > p + 1:
            left = common_prefix(ahead[p], ahead[q])
        for x in (p, q):
            if left > best[x]:
                best[x] = left
                for window, spans in zip(windows, found):
                    first, last, own = max(0, window - right), min(left, window), spans[x]
                    if first <= last:
                        if own and first <= own[-1][1] + 1:
                            first = own.pop()[0]
                        own.append((first, last))

    for i in sorted(range(1, m), key=rights.__getitem__, reverse=True):
        right = rights[i]
        if most < least - right:
            break
        group, other, start, end = held[i - 1], held[i], ends[i - 1], ends[i]
        if len(group) < len(other):
            group, other = other, group
        for p in other:
            j = bisect(group, p)
            if j:
                meet(group[j - 1], p, right)
            if j < len(group):
                meet(p, group[j], right)
            group.insert(j, p)
        held[start] = held[end] = group
        ends[start], ends[end] = end, start
    return [[spans[p] for p in place] for spans in found]


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive spans, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, those that meet as one."""
    return [(a, b + 1) for a, b in joined((a, b - 1) for a, b in spans if a < b)]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
