"""Aligning the tokens of two tokenizers over the same text, by pointer jumping, and counting which tokens meet.

A is a byte-level tokenizer file (tokenizers), read with a blank before the text; B a sentencepiece file, which puts that blank itself. Both give
tokens that cover the same bytes. Every token points to the token that overlaps it and ends farthest right (of equal ends, to A's); pointers are
doubled until none changes, so each ends at the last token of its component. Components are the groups: the bytes where tokens of both end
cut the text into them. A link is a pair of overlapping tokens; links between two ids are counted by documents.

Texts go by units, split at blanks between two other characters, which no token spans (checked when the files are loaded); a worker keeps the tokens of
recent units. Units of Latin letters go through a quicker library with A's vocabulary and merges, if these allow it. Every text is read once: its links are written, sorted, 4 bytes each (8 where ids are many). They are read back for the counts, summed up by
task, then to be weighed. Counts of frequent pairs lie in a broadcast table of bounded size; what a text links besides leaves as (row, pair, times) and is
joined, so no result depends on that size.

Texts that are null or empty, or whose tokens don't spell the text (sentencepiece reads U+2581 as a blank), have no tokens: zeros, and an empty
string for the hash. Repeated rows count each, as documents. Columns of docs that are named like added ones are dropped, and so is the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common
from triagewright.llm import context_trees as T
from triagewright.llm.lm import batches_of, frequent
from triagewright.llm.token_counts import encoder, model_path

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
SAFE, SPANS = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\S ")
#: Letters below this one are of the same classes in every library's Unicode tables; units with others are left to the tokenizer itself.
LATIN = "\u0250"
#: Units that a worker keeps (twice as many at most), and the longest of them; bytes of text aligned at once; pairs a task keeps before it sends them; pairs broadcast at most.
CACHE, LONGEST, BLOCK, HELD, PAIRS = 400_000, 64, 2_000_000, 3_000_000, 1_000_000
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the letters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the tokens of recent units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), encoder(b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_of_letter(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters.get(c, 63) for c in token)
        if any(SPANS.search(t.decode(errors="ignore")) for t in self.a_bytes):
            raise ValueError("tokens span a blank after a word; texts can't be read by units")
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.fast = quick(a_path, self.a_bytes)
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        #: How a token is written in the groups, whether last of its side in its group (odd) or not.
        self.names = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in ids for c in ",;"]

    def read(self, units: list[str]) -> None:
        """Keeps the tokens of units, as bytes of their ids; of units that the tokens don't spell, ()."""
        plain, other = [], []
        for u in units:
            quick = self.fast and u and (u.isascii() and u[0] > " " and u[-1] > " " or max(u) < LATIN and not u[0].isspace() and not u[-1].isspace())
            (plain if quick else other).append(u)
        if plain:  # all in one text, which no token spans from one unit to the next
            whole = " " + " ".join(plain)
            ids = np.array(self.fast.encode_ordinary(whole), np.int32)
            self.keep(plain, whole.encode(), ids, np.cumsum([len(u.encode()) + 1 for u in plain]))
        if other:
            found = [e.ids for e in self.a.encode_batch([" " + u for u in other], add_special_tokens=False)]
            ids = np.array([i for f in found for i in f], np.int32)
            self.keep(other, b"".join([(" " + u).encode() for u in other]), ids, np.cumsum([len(u.encode()) + 1 for u in other]))

    def keep(self, units: list[str], raw: bytes, a_ids: np.ndarray, cuts: np.ndarray) -> None:
        """units with their bytes one after the other, A's ids of all, and where each unit ends in raw."""
        b_ids = self.b.encode(units, num_threads=1)
        b_flat, b_at = np.fromiter((i for f in b_ids for i in f), np.int32), np.cumsum([len(f) for f in b_ids])
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a_ids, b_flat))]
        same = all(
            len(e) and e[-1] == len(raw) and np.isin(cuts, e).all() and b"".join([of[i] for i in ids.tolist()]) == raw
            for e, of, ids in ((ends[0], self.a_bytes, a_ids), (ends[1], self.b_bytes, b_flat))
        )
        a_raw, b_raw = a_ids.tobytes(), b_flat.tobytes()
        if same:
            a_at = np.searchsorted(ends[0], cuts) + 1
            for u, i, j, k, n in zip(units, [0, *(4 * a_at[:-1]).tolist()], (4 * a_at).tolist(), [0, *(4 * b_at[:-1]).tolist()], (4 * b_at).tolist()):
                self.kept[u] = (a_raw[i:j], b_raw[k:n])
            return
        for u, b in zip(units, b_ids):
            a, own = self.a.encode(" " + u, add_special_tokens=False).ids, (" " + u).encode()
            good = b"".join([self.a_bytes[i] for i in a]) == own and b"".join([self.b_bytes[i] for i in b]) == own
            self.kept[u] = (np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if good else ()

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of each text; of those without tokens, empty ones."""
        if len(self.kept) > CACHE:  # what is used again comes back from the older ones
            self.kept, self.older = {}, self.kept
        split = [units_of(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.kept)
        for u in [u for u in missing if u in self.older]:
            self.kept[u] = self.older[u]
            missing.discard(u)
        if missing:
            self.read(list(missing))
        out = []
        for units in split:
            found = list(map(self.kept.__getitem__, units))
            sides = zip(*found) if found and () not in found else ((), ())
            out.append(tuple(np.frombuffer(b"".join(side), np.int32) for side in sides))
        for u in missing:
            if len(u) > LONGEST:
                del self.kept[u]
        return out


def units_of(text: str) -> list[str]:
    """SAFE.split(text), faster where each white space is one blank or line feed between other characters."""
    return text.split(" ") if len(text.split()) == text.count(" ") + text.count("\n") + 1 else SAFE.split(text)


def quick(path: str, tokens: list[bytes]):
    """The same tokenizer in a quicker library, if the file is a byte-level one with the known pattern whose merges are in the order of their ids; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, letters = file["model"], byte_of_letter()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = min((model["vocab"][a + b] for a, b in merges), default=0)
    known = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    in_order = all(model["vocab"][a + b] == first + i for i, (a, b) in enumerate(merges)) and not model.get("ignore_merges")
    if file["normalizer"] or file["pre_tokenizer"] != known or not in_order:
        return None
    ranks = {tokens[i]: i for t, i in model["vocab"].items() if set(t) <= letters.keys()}
    return tiktoken.Encoding("pair", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def jumped(pointers: np.ndarray) -> np.ndarray:
    """Where each pointer's chain ends: pointers are doubled until none changes."""
    while not np.array_equal(further := pointers[pointers], pointers):
        pointers = further
    return pointers


class Aligned:
    """Groups and links of texts, given one after the other: a_ids and b_ids of equal bytes, and how many of them each text has."""

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> None:
        self.a_ids, self.b_ids, self.a_count, self.b_count = a_ids, b_ids, a_count, b_count
        na, nb = len(a_ids), len(b_ids)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        a_at, b_at = np.repeat(np.arange(na), a_size), np.repeat(np.arange(nb), b_size)  # the token of each byte
        last_b, last_a = b_at[a_end - 1], a_at[b_end - 1]
        pointers = np.r_[np.where(b_end[last_b] > a_end, na + last_b, np.arange(na)), last_a]
        end = jumped(pointers)
        number = np.cumsum(end[:na] == np.arange(na)) - 1
        self.a_group, self.b_group = number[end[:na]], number[end[na:]]
        self.groups = int(number[-1]) + 1 if na else 0
        text = np.repeat(np.arange(len(a_count)), a_count)
        self.group_count = np.bincount(text, end[:na] == np.arange(na), len(a_count)).astype(np.int64)
        cut = np.zeros((int(a_end[-1]) if na else 0) + 1, bool)
        cut[a_end] = cut[b_end] = True
        byte = np.flatnonzero(cut) - 1  # each stretch between two ends is one link
        self.link_a, self.link_b = a_at[byte], b_at[byte]
        self.link_text = text[self.link_a]
        self.link_count = np.bincount(self.link_text, minlength=len(a_count))

    def written(self, names: list[str]) -> list[str]:
        """The groups of each text, `a1,a2|b1;a3|b2,b3`."""
        in_a, in_b = np.bincount(self.a_group, minlength=self.groups), np.bincount(self.b_group, minlength=self.groups)
        at_a = np.arange(len(self.a_ids)) + (np.cumsum(in_b) - in_b)[self.a_group]
        at_b = np.arange(len(self.b_ids)) + np.cumsum(in_a)[self.b_group]
        last = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool)
        code = np.empty(len(at_a) + len(at_b), np.int64)
        a_names = len(names) - 2 * self.b_vocabulary
        code[at_a] = self.a_ids.astype(np.int64) * 2 + last(self.a_group)
        code[at_b] = a_names + self.b_ids.astype(np.int64) * 2 + last(self.b_group)
        bounds = np.r_[0, np.cumsum(self.a_count + self.b_count)]
        return ["".join(map(names.__getitem__, code[lo:hi].tolist()))[:-1] for lo, hi in zip(bounds[:-1], bounds[1:])]

    b_vocabulary = 0

    def links(self, kind: str) -> list[bytes]:
        """The pairs of ids that are linked in each text, as numbers of that type: in order, each as often as it is linked."""
        pair = self.a_ids[self.link_a].astype(np.int64) * self.b_vocabulary + self.b_ids[self.link_b]
        key = (self.link_text.astype(np.int64) << 40) | pair
        key.sort()
        raw, bounds = (key & ((1 << 40) - 1)).astype(kind).tobytes(), np.dtype(kind).itemsize * np.r_[0, np.cumsum(self.link_count)]
        return [raw[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def link_type(a_path: str, b_path: str) -> str:
    """The type of number that holds every pair of ids."""
    from tokenizers import Tokenizer

    pairs = (max(Tokenizer.from_file(a_path).get_vocab().values()) + 1) * encoder(b_path).get_piece_size()
    return "u4" if pairs <= 1 << 32 else "i8"


def pairs_of(links: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times): which ids are linked in each text, in order. links: as Aligned.links() gives them."""
    pair = np.frombuffer(b"".join(links), kind).astype(np.int64)
    text = np.repeat(np.arange(len(links)), np.array([len(x) for x in links], np.int64) // np.dtype(kind).itemsize)
    start = T.runs((text << 40) | pair)
    return text[start], pair[start], np.diff(np.r_[start, len(pair)])


def aligned(pair: Pair, texts: list[str | None]) -> Aligned:
    found = pair.tokens(texts)
    a, b = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int32)]) for side in (0, 1))
    out = Aligned(a, b, pair.sizes[0][a], pair.sizes[1][b], *(np.array([len(f[side]) for f in found], np.int64) for side in (0, 1)))
    out.b_vocabulary = len(pair.b_bytes)
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of BLOCK bytes or so, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def link_counts(linked: DataFrame, kind: str, width: int) -> DataFrame:
    """(pair, a, b, n, best): ids that are linked, in how many rows, and whether no other b is linked with that a in more. linked: (links); width: b's ids."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            links = batch.column(0).to_pylist()
            for lo, hi in blocks(links):
                _, found, _ = pairs_of(links[lo:hi], kind)
                parts.append(T.summed(found, np.ones(len(found), np.int64)))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [T.summed(*(np.concatenate(x) for x in zip(*parts)))]
                if (held := len(parts[0][0])) > HELD // 2:
                    yield from batches_of(list(parts[0]), ["pair", "n"])
                    parts, held = [], 0
        if parts:
            yield from batches_of(list(T.summed(*(np.concatenate(x) for x in zip(*parts)))), ["pair", "n"])

    by = F.lit(width).cast("long")
    summed = linked.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = common.written(summed.select("pair", F.floor(F.col("pair") / by).alias("a"), (F.col("pair") % by).alias("b"), "n"), "links")
    most = summed.groupBy("a").agg(F.max("n").alias("most"))
    return summed.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", pairs: int = PAIRS, groups: bool = False) -> DataFrame:
    """docs without its text, with ADDED; with `groups` also the groups themselves, as text. Paths: tokenizer files, the same on every executor."""
    spark = docs.sparkSession
    common.small_batches(spark)
    a_path, b_path = a_path or model_path(A_MODEL), b_path or model_path(B_MODEL)
    kind, width = link_type(a_path, b_path), encoder(b_path).get_piece_size()
    keep = [c for c in docs.columns if c not in (text, *ADDED, "groups")]
    packed = common.packed(docs.select(*[common.quoted(c) for c in keep], F.col(text).alias("text")) if text not in keep else docs, ("text",), text=F.col("text"))
    rows = packed.withColumn("uid", F.monotonically_increasing_id())
    first = [rows.schema["doc"], rows.schema["uid"], *common.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string").fields]
    read_schema = common.StructType([*first, *common.StructType.fromDDL("links binary").fields])
    out = common.StructType([*first, *common.StructType.fromDDL("best long, total long, pair array<long>, times array<long>").fields])
    read_arrow, schema = common.to_arrow_schema(read_schema), common.to_arrow_schema(out)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(a_path, b_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in blocks(texts):
                found = aligned(both, texts[lo:hi])
                written = found.written(both.names)
                hashes = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                columns = [found.a_count, found.b_count, found.group_count, found.link_count, hashes, written if groups else [None] * (hi - lo), found.links(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *[pa.array(c, f.type) for c, f in zip(columns, list(read_arrow)[2:])]], schema=read_arrow)

    linked = common.written(rows.select("doc", "uid", "text").mapInArrow(read, read_schema), "linked")
    counts = common.written(link_counts(linked, kind, width), "pairs")
    top = frequent(counts.withColumn("m", F.col("n")), pairs).select("pair", "n", "best").toArrow().sort_by("pair")
    told = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy()))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = told.value
        for batch in batches:
            links = batch.column(len(first)).to_pylist()
            for lo, hi in blocks(links):
                of, pair, times = pairs_of(links[lo:hi], kind)
                at = np.searchsorted(known, pair)
                at[at == len(known)] = 0
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                sums = lambda x: np.bincount(of[hit], times[hit] * x[at[hit]], hi - lo).astype(np.int64)
                bounds = np.searchsorted(of[~hit], np.arange(hi - lo + 1))
                lists = [pa.array([x[~hit][i:j] for i, j in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64())) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i)[lo:hi] for i in range(len(first))], pa.array(sums(best)), pa.array(sums(n)), *lists], schema=schema)

    scored = common.written(linked.mapInArrow(weigh, out), "aligned")
    common.discard(linked)  # the links: what was read of them is written
    left = scored.select("uid", F.inline(F.arrays_zip("pair", "times"))).join(counts, "pair")
    more = left.groupBy("uid").agg(F.sum(F.col("times") * F.col("n")).alias("more_total"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"))
    both = scored.drop("pair", "times").join(more, "uid", "left")
    plus = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return both.select(
        *common.unpacked(keep), "n_a", "n_b", "n_groups", "n_links", plus("best").alias("n_best"), plus("total").alias("count_sum"), "groups_sha256", *(["groups"] if groups else []),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
