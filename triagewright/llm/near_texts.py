"""Near-duplicate texts at a Jaccard similarity of word shingles, over minima of their hashes.

At a similarity of 0.8 two 64-bit SimHash fingerprints differ in some 9 bits, but as repeats count there and not in the similarity, no
number of bits bounds it. So no fingerprint decides: two texts share a block if two of BLOCKS minima of their hashed shingles agree, which
0.8 alike texts fail to do once in 10,000. Of a block's pairs those whose sets' sizes rule the similarity out are dropped, and the rest
are checked by the exact similarity. A block of more than `full` texts isn't joined there: each of its texts is paired with the
block's first and with its neighbour in an order that puts equal minima together, which links most of a group of any size.

What such blocks leave open are pairs of texts in different groups so far. An exact prefix join decides them all (across()): in one
order of all shingles, rare ones first, two sets of the similarity share one of the first n - ceil(similarity * n) + 1 shingles of each.
Texts meet at those shingles. First each meets about SOME others, by which most groups grow together; then all pairs of different groups are
decided. A shingle whose texts are one group already is done, and the others are cut into tiles of PIECE texts by PIECE.

Equal texts are one class first. Null and empty texts are equal texts; a text of fewer words than a shingle is one
shingle. Of each connected group one row stays, that with the least doc_id (null ids last); of rows that are equal in all columns, one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagewright.llm import common
from triagewright.llm.components import components
from triagewright.llm.simhash import hashes, shingles

SHINGLE, SIMILARITY, BLOCKS, PIECE, SOME, BUCKETS = 5, 0.8, 8, 1024, 8, 18
ODD = ["odd0", "odd1", "odd2", "odd3"]
MIX = [((2 * i + 1) * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(1, BLOCKS + 1)]


def numbers(h: np.ndarray) -> np.ndarray:
    """Distinct hashes as 32-bit numbers, sorted."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def sketch(text: str, size: int) -> tuple[int, list[int]]:
    """(number of distinct shingles, minima)"""
    h = hashes(shingles(text, size))
    if not len(h):
        return 0, []
    low = []
    for m in MIX:
        x = h * np.uint64(m)
        low.append(int((x ^ (x >> np.uint64(31))).min().view(np.int64)))
    return len(numbers(h)), low


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text as 32-bit numbers, sorted."""
    return numbers(hashes(shingles(text, size)))


def may_be(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity: it is the ratio of the sizes at most."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def candidates(blocks: DataFrame, full: int, similarity: float) -> DataFrame:
    """(a, b, large), numbers of texts that may be alike, a < b, and whether a large block gave them: all texts of such blocks are in one. blocks: (k, id, n, sort), n the sizes of sets, dealt and sorted by k, sort."""

    def join(k: np.ndarray, i: np.ndarray, n: np.ndarray, cut: int | None) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.array([], np.int64)
        size = np.diff(np.concatenate([start, [len(k)]]))
        first, many = np.repeat(start, size), np.repeat(size, size) > full
        many |= k == cut if cut is not None else False
        rest = np.flatnonzero(many & (np.arange(len(k)) != first))
        pairs = [(rest, first[rest]), (rest, rest - 1)]
        for d in range(1, full):
            at = np.flatnonzero(~many[d:] & (first[d:] == first[:-d]))
            if not len(at):
                break
            pairs.append((at, at + d))
        x, y = np.concatenate([p[0] for p in pairs]).astype(np.int64), np.concatenate([p[1] for p in pairs]).astype(np.int64)
        near = many[x] | may_be(n[x], n[y], similarity)
        x, y, large = i[x[near]], i[y[near]], many[x[near]]
        found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), large], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2] > 0)], names=["a", "b", "large"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = [np.array([], np.int64) for _ in range(3)], None
        for b in batches:
            held = [np.concatenate([x, b.column(c).to_numpy()]) for c, x in enumerate(held)]
            if len(held[0]) > 1 << 18:
                end = int(np.argmax(held[0] == held[0][-1])) or len(held[0])  # a block larger than all this is cut; its parts share texts
                yield join(*(x[:end] for x in held), cut)
                whole = end < len(held[0])
                cut = None if whole else held[0][0]  # what is left of a cut block is part of a large one, however short
                held = [x[end if whole else end - 1 :] for x in held]
        yield join(*held, cut)

    return blocks.select("k", "id", "n").mapInArrow(run, "a long, b long, large boolean")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have at least that Jaccard similarity. sets: (id, s)."""
    side = lambda n: sets.select(F.col("id").alias(n), F.col("s").alias(f"s_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    n = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(n >= similarity * (F.size("s_a") + F.size("s_b") - n)).select("a", "b")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, summed up in 2^BUCKETS buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKETS, np.int64)
        for b in batches:
            s = b.column(0).flatten().to_numpy().view(np.uint32) >> np.uint32(32 - BUCKETS)
            n += np.bincount(s, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    out = np.zeros(1 << BUCKETS, np.int64)
    for r in sets.select("s").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out


def bits(s: np.ndarray) -> np.ndarray:
    """256 bits: whether a set has an odd number of shingles in a bucket. Two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount(s.view(np.uint32) & np.uint32(255), minlength=256) & 1).view(np.int64)


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, id, n, odd): the first shingles of each set, of which similar sets share one; and bits(). sets: (id, s)."""
    often = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = often.value
        for b in batches:
            found = [(np.array([], np.int32), *[np.array([], np.int64)] * 6)]
            for i, x in zip(b.column("id").to_numpy(), b.column("s")):
                x = x.values.to_numpy()
                size, odd = len(x), bits(x)
                x = x[np.lexsort((x, n[x.view(np.uint32) >> np.uint32(32 - BUCKETS)]))][: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
                found.append((x, *[np.full(len(x), c) for c in (i, size, *odd)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["token", "id", "n", *ODD])

    return sets.select("id", "s").mapInArrow(run, "token int, id long, n long, " + ", ".join(f"{c} long" for c in ODD))


def across(rows: DataFrame, similarity: float, piece: int = PIECE, some: bool = False) -> DataFrame:
    """(a, b), a < b: candidates for all similar pairs of different roots, or some: about `piece` for each text at each shingle. rows: prefixes() with root."""
    spark = rows.sparkSession
    each = rows.groupBy("token", "root").agg(F.count("*").alias("n"))
    live = each.groupBy("token").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    pieces = lambda n: F.ceil(n / F.lit(piece))
    live = live.select("token", "top", pieces(F.col("all")).alias("p"), F.lit(1).cast("long").alias("q") if some else pieces(F.col("all") - F.col("most")).alias("q"))
    met = common.written(rows.join(live, "token"), "met")  # all texts meet those that are not of the most frequent root
    own = lambda n: F.pmod(F.xxhash64("id", "token"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = met.select("token", own(F.col("p")).alias("x"), every("q").alias("y"), F.lit(0).cast("long").alias("side"), "id", "root", "n", *ODD)
    at = F.pmod(F.xxhash64("token", "id"), F.col("p")) if some else every("p")
    right = met.where("root <> top").select("token", at.alias("x"), own(F.col("q")).alias("y"), F.lit(1).cast("long").alias("side"), "id", "root", "n", *ODD)
    tiles = left.unionByName(right).withColumn("tile", F.xxhash64("token", "x", "y"))
    dealt = tiles.select("tile", "side", "id", "root", "n", *ODD).repartition(common.partitions(spark), "tile").sortWithinPartitions("tile", "side")

    def join(tile: np.ndarray, side: np.ndarray, i: np.ndarray, root: np.ndarray, n: np.ndarray, *odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.array([], np.int64)
        found, ready = [], 0
        for s, e in zip(start, [*start[1:], len(tile)]):
            m = s + int(np.searchsorted(side[s:e], 1))
            x, y = np.nonzero((root[s:m, None] != root[None, m:e]) & may_be(n[s:m, None], n[None, m:e], similarity))
            x, y = s + x, m + y
            close = sum(np.bitwise_count((o[x] ^ o[y]).view(np.uint64)).astype(np.int64) for o in odd) <= (n[x] + n[y]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            x, y = i[x[close]], i[y[close]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            ready += len(x)
            if ready and (ready > 1 << 19 or e == len(tile)):
                out = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, c]) for c in (0, 1)], names=["a", "b"])
                found, ready = [], 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], np.int64) for _ in range(5 + len(ODD))]
        for b in batches:
            held = [np.concatenate([x, b.column(c).to_numpy()]) for c, x in enumerate(held)]
            end = int(np.argmax(held[0] == held[0][-1])) if len(held[0]) > 1 << 14 else 0  # the last tile may go on
            if end:
                yield from join(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        yield from join(*held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes_of(docs: DataFrame, key: str, text: str, size: int, similarity: float, full: int) -> DataFrame:
    """(a, b, first): for each distinct text, by two hashes, the least key of its group."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), text, F.xxhash64(text).alias("ha"), F.xxhash64(F.lit(7), text).alias("hb"))
    drawn = common.written(common.with_arrow(slim, lambda: lambda t: sketch(t, size), ["key", "ha", "hb"], text, "n long, low array<long>"), "sketches")
    kinds = drawn.groupBy("ha", "hb").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("low").alias("low"))
    kinds = common.written(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    keys = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.get("low", F.lit(i)), F.get("low", F.lit(j))) for i, j in combinations(range(BLOCKS), 2)])
    blocks = kinds.where(F.size("low") > 0).select(F.explode(keys).alias("k"), "id", "n", F.xxhash64("low").alias("sort"))
    dealt = blocks.repartition(common.partitions(spark), "k").sortWithinPartitions("k", "sort", "id")
    pairs = common.written(candidates(dealt, full, similarity).groupBy("a", "b").agg(F.max("large").alias("large")), "pairs")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(kinds.select("id", "key", "ha", "hb"), "id")
    asked = asked.select("id", F.col("key").alias("_k"), F.col("ha").alias("_a"), F.col("hb").alias("_b"))
    texts = slim.join(asked, (F.col("ha") == F.col("_a")) & (F.col("hb") == F.col("_b")) & F.col("key").eqNullSafe(F.col("_k"))).select("id", text)
    sets = common.written(common.with_arrow(texts, lambda: lambda t: (shingle_set(t, size),), ["id"], text, "s array<int>"), "sets")
    close = common.written(alike(pairs, sets, similarity), "close")
    roots = components(close, "a", "b")
    hot = pairs.where("large")
    hot = hot.select(F.col("a").alias("id")).unionByName(hot.select(F.col("b").alias("id"))).distinct()
    if not hot.isEmpty():
        firsts = common.written(prefixes(sets.join(hot, "id"), similarity), "prefixes")
        for piece, some in ((SOME, True), (PIECE, False)):  # most groups grow together by a few pairs a text; then all that is left open is decided
            now = firsts.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", "n", *ODD, F.coalesce("root", "id").alias("root"))
            rest = common.written(across(now, similarity, piece, some), "rest")
            close = common.written(close.unionByName(alike(rest, sets, similarity)), "close")
            roots = components(close, "a", "b")
    rooted = common.written(kinds.select("ha", "hb", "key", "id").join(roots, kinds.id == roots.node, "left").select("ha", "hb", "key", F.coalesce("root", "id").alias("root")), "groups")
    return rooted.join(rooted.groupBy("root").agg(F.min("key").alias("first")), "root").select("ha", "hb", "key", "first")


def near_deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, full: int = 64) -> DataFrame:
    """The rows of docs that stay: one of each group of texts that are alike."""
    common.small_batches(docs.sparkSession)
    held = F.coalesce(common.quoted(text), F.lit(""))
    found = classes_of(docs.select(common.quoted(key).alias("key"), held.alias("text")), "key", "text", size, similarity, full)
    kept = found.where(F.col("key").eqNullSafe(F.col("first"))).select(F.col("ha").alias("a"), F.col("hb").alias("b"), F.col("key").alias("k")).distinct()
    rows = common.packed(docs, ha=F.xxhash64(held), hb=F.xxhash64(F.lit(7), held), key=common.quoted(key))
    rows = rows.join(kept, (F.col("ha") == F.col("a")) & (F.col("hb") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")))
    return rows.dropDuplicates(["a", "b", "k"]).select(*common.unpacked(docs.columns))
