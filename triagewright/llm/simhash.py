"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is 1 if more than half of the hashes of a text's word shingles have it. Equal fingerprints collapse to one
class first. Two classes are linked if their fingerprints differ in at most `max_bits` bits.

The trie is cut into sub-tries that can be joined apart: of max_bits + 1 blocks of a fingerprint, two linked ones agree in
one, and of max_bits + 1 blocks of the other bits again in one. Each fingerprint so goes to (max_bits + 1)^2 sub-tries, whose
members agree in some 35 of 64 bits, so that even a third of all documents can't meet in one: a fingerprint occurs once, and
has at most some thousand others within two bits. A sub-trie is a sorted array, its nodes are ranges. Pairs of nodes go
down together, bit by bit, in numpy; each carries the bits in which its sides differ, and is dropped beyond max_bits.
A pair is reported by the first sub-trie that holds it, and only links that join two parts of a sub-trie are kept.

Null and empty texts have no words: fingerprint zero, linked like any other. Repeated documents are rows of their own
with the same class. A component is named by its least non-null doc_id. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common
from triagewright.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of `size` words, repeats included; a shorter text is one shingle. bytes: lower() and split() know ASCII alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :])]


def hashes(found: list[bytes], seed: int = SEED) -> np.ndarray:
    import xxhash

    of = xxhash.xxh64_intdigest
    return np.fromiter((of(s, seed) for s in found), np.uint64, len(found))


def fingerprint(h: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed long."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """docs without its text, with fingerprint as a long."""
    common.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "fingerprint")]
    return common.with_arrow(docs, lambda: lambda t: (fingerprint(hashes(shingles(t, size))),), keep, text, "fingerprint long")


def cut(bits: list[int], parts: int) -> list[list[int]]:
    at = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:])]


def tables(max_bits: int) -> list[tuple[int, int]]:
    """(mask of the first block, mask of both blocks) of each sub-trie's table, in order."""
    mask = lambda bits: sum(1 << b for b in bits)
    every = list(range(64))
    return [(mask(one), mask(one + two)) for one in cut(every, max_bits + 1) for two in cut([b for b in every if b not in one], max_bits + 1)]


def trie_pairs(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of equal key that differ in at most max_bits bits. Rows are sorted by key, then fingerprint."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
    ends = np.concatenate([starts[1:], [len(key)]])
    big = ends - starts > 1
    lo, hi = starts[big], ends[big]
    a0, a1, b0, b1, wrong = lo, hi, lo, hi, np.zeros(len(lo), np.int64)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same, cross = a0 == b0, wrong < max_bits
        sides = [(a0, am, b0, bm, wrong), (am, a1, bm, b1, wrong), (a0, am, bm, b1, wrong + 1, cross), (am, a1, b0, bm, wrong + 1, cross & ~same)]
        down = [[], [], [], [], []]
        for s in sides:
            ok = (s[0] < s[1]) & (s[2] < s[3]) & ~((s[0] == s[2]) & (s[1] - s[0] < 2))
            ok = ok & s[5] if len(s) > 5 else ok
            for x, y in zip(down, s):
                x.append(y[ok])
        a0, a1, b0, b1, wrong = map(np.concatenate, down)
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        left.append(a0[leaf])
        right.append(b0[leaf])
        a0, a1, b0, b1, wrong = (x[~leaf] for x in (a0, a1, b0, b1, wrong))
    i, j = (np.concatenate(x) if x else np.array([], np.int64) for x in (left, right))
    close = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
    return i[close], j[close]


def spanning(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join two parts."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(classes: DataFrame, max_bits: int = MAX_BITS, batch: int = 1 << 18) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every component whole. classes: one row a fingerprint."""
    masks = tables(max_bits)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keyed = classes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("k")) for i, (_, m) in enumerate(masks)])).alias("s"), "fingerprint").select("s.t", "s.k", "fingerprint")
    dealt = keyed.repartition(common.partitions(classes.sparkSession), "t", "k").sortWithinPartitions("t", "k", "fingerprint")

    def join(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, k, t))
        t, k, fp = t[order], k[order], fp[order]
        group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
        i, j = trie_pairs(group, fp, max_bits)
        x, first = fp[i] ^ fp[j], np.full(len(i), -1)
        for n in range(len(masks) - 1, -1, -1):
            first[(x & np.uint64(masks[n][1])) == 0] = n
        own = first == t[i]
        found = spanning(zip(fp[i[own]].view(np.int64).tolist(), fp[j[own]].view(np.int64).tolist()))
        return pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.int64()) for n in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins whole sub-tries, about `batch` rows at a time."""
        held = [np.array([], kind) for kind in (np.int64, np.int64, np.uint64)]
        for b in batches:
            new = [b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= batch:
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                end = int(np.argmax(same))  # the last sub-trie may go on
                if end:
                    yield join(*(x[:end] for x in held))
                    held = [x[end:] for x in held]
        yield join(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_classes(prints: DataFrame, key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """prints with component_id (in place of a column of that name). prints: (key, fingerprint, ...), read twice, so it should be written or cheap."""
    prints = prints.drop("component_id")
    classes = common.written(prints.groupBy("fingerprint").agg(F.min(key).alias("first")), "classes")
    roots = components(links(classes, max_bits), "a", "b")
    joined = common.written(classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(joined.join(named, "root").select("fingerprint", "component_id"), "fingerprint")


def near_deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay: of each component the one with the least key (null keys last); of rows of equal key and text one."""
    held = F.coalesce(common.quoted(text), F.lit(""))
    named = {"key": common.quoted(key), "ha": F.xxhash64(held), "hb": F.xxhash64(F.lit(7), held)}
    prints = fingerprints(docs.select(*[c.alias(n) for n, c in named.items()], held.alias("text")))
    best = F.struct(F.col("key").isNull().alias("none"), "key", "ha", "hb")
    kinds = common.written(prints.groupBy("fingerprint").agg(F.min(best).alias("best")), "kinds")
    roots = components(links(kinds, max_bits), "a", "b")
    each = kinds.join(roots, kinds.fingerprint == roots.node, "left").select("best", F.coalesce("root", "fingerprint").alias("root"))
    kept = each.groupBy("root").agg(F.min("best").alias("b")).select(F.col("b.key").alias("k"), F.col("b.ha").alias("a"), F.col("b.hb").alias("b"))
    rows = common.packed(docs, **named)
    rows = rows.join(kept, (F.col("ha") == F.col("a")) & (F.col("hb") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")))
    return rows.dropDuplicates(["a", "b", "k"]).select(*common.unpacked(docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = common.written(fingerprints(docs), "prints")
    return near_classes(prints).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
