"""Context-tree weighting over bytes, in numpy: what one task works out of a sorted run of grams.

A gram is six bytes, the five before a byte (nearest first) and the byte: c1..c5, s, as one integer. Bytes are decided bit by bit: the node of a
bit is its context and the bits of s before it (with a leading 1, so 1 to 255). Each node of each depth counts zeros and ones; its block
probability is Krichevsky and Trofimov's (kt), its weighted one half that and half the product of its children's, those of one byte
more context. The probability of a bit mixes the estimates of all depths by these weights, from the deepest context seen upwards;
contexts that never occurred in training have no estimate and no say.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

DEPTH = 5
#: Ends a text and stands before its start; no byte of UTF-8.
END = 0xFF
LN2 = float(np.log(2.0))


def grams(blob: np.ndarray) -> np.ndarray:
    """The gram of each byte of blob from the sixth on. blob: DEPTH marks, then texts, each followed by END and by DEPTH - 1 further marks or the blob's end."""
    n = len(blob) - DEPTH
    key = np.zeros(max(n, 0), np.uint64)
    for back in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | blob[DEPTH - back : DEPTH - back + n]
    return (key << np.uint64(8)) | blob[DEPTH : DEPTH + n]


def blob_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(blob, own): texts between marks, and which of grams(blob) predict a byte of a text or its end (the rest predict padding)."""
    pad = bytes([END]) * DEPTH
    blob = np.frombuffer(pad + pad.join(texts) + bytes([END]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    own = np.ones(len(blob) - DEPTH, bool)
    if len(texts) > 1:  # after a text's end come the next one's marks
        after = np.cumsum(sizes + DEPTH - 1)[:-1]
        for i in range(1, DEPTH):
            own[after - i] = False
    return blob, own


def owner(texts: list[bytes]) -> np.ndarray:
    """For each gram that blob_of() owns: which text it is of."""
    return np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series, eight steps up."""
    y = x + 8.0
    rise = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    inv = 1.0 / y
    i2 = inv * inv
    series = inv * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(rise)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1.0)


def weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - LN2


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


class Level:
    """The contexts of one depth over distinct (context, byte) keys, sorted: counts, and for each bit its nodes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.n = keys, n.astype(np.float64)
        self.node, self.first, self.zeros, self.ones, self.bit = [], [], [], [], []
        for k in range(8):
            of = keys >> np.uint64(8 - k)  # context and the bits before this one
            start = runs(of)
            node = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(of)]))
            bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64)
            ones = np.bincount(node, self.n * bit, len(start))
            self.node.append(node)
            self.first.append(start)
            self.bit.append(bit)
            self.ones.append(ones)
            self.zeros.append(np.bincount(node, self.n, len(start)) - ones)

    def estimate(self, k: int) -> np.ndarray:
        """What this depth says of bit k of each key."""
        z, o = self.zeros[k][self.node[k]], self.ones[k][self.node[k]]
        return (np.where(self.bit[k] > 0, o, z) + 0.5) / (z + o + 1.0)

    def seen(self, k: int) -> np.ndarray:
        return (self.zeros[k] + self.ones[k])[self.node[k]] > 0


def without_farthest(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys whose farthest context byte is dropped: (sorted distinct keys, counts, where each old key went)."""
    short = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
    order = np.argsort(short, kind="stable")
    ordered = short[order]
    start = runs(ordered)
    to = np.empty(len(keys), np.int64)
    to[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(ordered)]))
    return ordered[start], np.bincount(to, n, len(start)), to


def mixed(ratio: np.ndarray, estimate: np.ndarray, below: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A depth's estimate and what the deeper ones say, by their weights; the estimate alone where nothing deeper was seen."""
    return np.where(known, (ratio * estimate + below) / (1.0 + ratio), estimate)


def ratio_of(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(own - below, -700.0, 700.0))


def deep(keys: np.ndarray, n: np.ndarray, upto: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """From sorted distinct grams with all grams of their first `upto` context bytes: what depths DEPTH to `upto` say.

    (q, nodes): q[i, k] is the probability of bit k of gram i by these depths, -1 where none has seen it; nodes are those of depth `upto`: key (context, node),
    zeros, ones and ln of their weighted probability.
    """
    level = Level(keys, n)
    below = [level.estimate(k) for k in range(8)]
    known = [level.seen(k) for k in range(8)]
    weight = [kt(level.zeros[k], level.ones[k]) for k in range(8)]
    at = np.arange(len(keys))  # each gram's place among this depth's keys
    for _ in range(DEPTH - upto):
        upper_keys, upper_n, to = without_farthest(level.keys, level.n)
        upper = Level(upper_keys, upper_n)
        at = to[at]
        for k in range(8):
            parent = upper.node[k][to[level.first[k]]]
            children = np.bincount(parent, weight[k], len(upper.first[k]))
            own = kt(upper.zeros[k], upper.ones[k])
            weight[k] = weighted(own, children)
            node = upper.node[k][at]
            here = upper.seen(k)[at]
            said = mixed(ratio_of(own, children)[node], upper.estimate(k)[at], below[k], known[k])
            below[k], known[k] = said, known[k] | here
        level = upper
    q = np.stack([np.where(known[k], below[k], -1.0) for k in range(8)], axis=1) if len(keys) else np.zeros((0, 8))
    key, zeros, ones, lw = [], [], [], []
    for k in range(8):
        head = level.keys[level.first[k]]
        node = (np.uint64(1) << np.uint64(k)) | ((head & np.uint64(255)) >> np.uint64(8 - k))
        key.append(((head >> np.uint64(8)) << np.uint64(8)) | node)
        zeros.append(level.zeros[k])
        ones.append(level.ones[k])
        lw.append(weight[k])
    nodes = {"key": np.concatenate(key), "zeros": np.concatenate(zeros), "ones": np.concatenate(ones), "below": np.concatenate(lw)}
    return q, nodes


class Shallow:
    """Depths 2, 1 and 0, from the nodes of depth 2 (key, zeros, ones, and the sum of their children's ln weighted probability)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        self.tables = []
        for depth in (2, 1, 0):
            order = np.argsort(key)
            key, zeros, ones, below = key[order], zeros[order], ones[order], below[order]
            own = kt(zeros, ones)
            self.tables.append((key, zeros, ones, ratio_of(own, below)))
            if depth:
                short = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))
                weight = weighted(own, below)
                key, to = np.unique(short, return_inverse=True)
                zeros, ones, below = (np.bincount(to, x, len(key)) for x in (zeros, ones, weight))

    def log_probability(self, keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """ln of each gram's probability: the product over its bits of all depths' mixture. q: deep()'s, for upto = 3."""
        total = np.zeros(len(keys))
        s = keys & np.uint64(255)
        for k in range(8):
            node = (np.uint64(1) << np.uint64(k)) | (s >> np.uint64(8 - k))
            bit = (s >> np.uint64(7 - k)) & np.uint64(1) > 0
            below, known = q[:, k], q[:, k] >= 0
            for depth, (key, zeros, ones, ratio) in zip((2, 1, 0), self.tables):
                want = ((keys >> np.uint64(48 - 8 * depth)) << np.uint64(8)) | node
                z, o, r = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
                if len(key):
                    i = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    hit = key[i] == want
                    z, o, r = np.where(hit, zeros[i], 0.0), np.where(hit, ones[i], 0.0), np.where(hit, ratio[i], 0.0)
                here = z + o > 0
                estimate = (np.where(bit, o, z) + 0.5) / (z + o + 1.0)
                below = np.where(here, mixed(r, estimate, below, known), np.where(known, below, 0.5))
                known = known | here
            total += np.log(below)
        return total


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    start = runs(keys[order])
    return keys[order][start], *(np.add.reduceat(c[order], start) if len(start) else c for c in counts)


def whole_contexts(parts: Iterable[tuple[np.ndarray, ...]], shift: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted parts of (keys, counts...), put together so that grams that agree above `shift` bits are never split; at least `least` rows each but the last."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= least:
            whole = tuple(np.concatenate(x) for x in zip(*held))
            context = whole[0] >> np.uint64(shift)
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield tuple(x[:cut] for x in whole)
            held = [tuple(x[cut:] for x in whole)]
            size = len(held[0][0])
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))
