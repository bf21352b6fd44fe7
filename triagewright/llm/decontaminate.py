"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark texts (10 consecutive normalised words, or a whole shorter text) become the patterns of one
automaton, which reads each normalised document once. Ends of matches are kept as word numbers, and those map back to
offsets in the original text. The automaton is broadcast as its patterns, whose size is checked: windows beyond
`slice_bytes` go to further automata, each of which reads the documents once, and the hits are merged per document.

Null and empty texts have no words and no hits; an item without words has no window; repeated items all count; repeated
documents are scanned each. An empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common

#: A-Z is lower-cased first; any character beyond ASCII belongs to a word.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of the windows of one automaton (its nodes take some 50 times that in a worker).
SLICE_BYTES = 4_000_000


def ascii_lower(text: str) -> str:
    return text if text.isascii() and text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(window, n, ids): each distinct window of the items with its number of words and the ids of its items, sorted as strings."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    w = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower), F.lit(WORD_SQL), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    return (
        items.select(F.col(key).cast("string").alias("id"), w.alias("w")).where(F.size("w") > 0)
        .select("id", F.explode(cut).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )


def slices(windows: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows in lists of bounded size, fetched one partition at a time."""
    part, held = [], 0
    for r in windows.toLocalIterator():
        part.append((r.window, list(r.ids)))
        held += len(r.window.encode())
        if held >= slice_bytes:
            yield part
            part, held = [], 0
    if part:
        yield part


def matcher(patterns: list[tuple[str, list[str]]]) -> Callable[[str], list[tuple[int, int, int]]]:
    """A function that gives (first word, last word + 1, pattern's number) of each occurrence in a normalised text."""
    import ahocorasick

    if not patterns:
        return lambda joined: []
    automaton = ahocorasick.Automaton()
    for i, (window, _) in enumerate(patterns):
        automaton.add_word(f" {window} ", (i, window.count(" ") + 1))
    automaton.make_automaton()

    def occurrences(joined: str) -> list[tuple[int, int, int]]:
        found, at, seen = [], 0, 0
        for end, (i, n) in automaton.iter(joined):
            seen += joined.count(" ", at, end + 1)
            at = end + 1
            found.append((seen - 1 - n, seen - 1, i))
        return found

    return occurrences


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, patterns: list[tuple[str, list[str]]], keep: list[str], text: str) -> DataFrame:
    """docs' kept columns with n_words, hit word runs, their spans in the original text, and the items found."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def make() -> Callable[[str], tuple]:
        own = shared.value
        occurrences = matcher(own)

        def of(t: str) -> tuple:
            found = words(t)
            if not found:
                return 0, [], [], []
            hits = occurrences(f" {' '.join(found)} ")
            if not hits:
                return len(found), [], [], []
            runs = merged([(a, b) for a, b, _ in hits])
            at = [m.span() for m in WORD.finditer(ascii_lower(t))]
            ids = sorted({x for i in {i for _, _, i in hits} for x in own[i][1]})
            return len(found), [{"from": a, "to": b} for a, b in runs], [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs], ids

        return of

    added = "n_words long, runs array<struct<from:long,to:long>>, spans array<struct<start:long,end:long>>, items array<string>"
    return common.with_arrow(docs, make, keep, text, added)


def decontaminate(
    docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", key: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """docs without its text, with n_words, n_hit, spans (code points of the original text) and items (found item ids)."""
    common.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "runs", "spans", "items")]
    parts = list(slices(item_windows(items, key, item_text, size), slice_bytes)) or [[]]
    if len(parts) == 1:
        found = scan(docs, parts[0], keep, text)
    else:
        found = several(docs, parts, keep, text)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminate_texts(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """docs with their texts, with n_words, n_hit, spans and items, in place of columns of those names."""
    added = ["n_words", "n_hit", "spans", "items"]
    columns = [c for c in docs.columns if c not in added]
    found = decontaminate(common.packed(docs.select(*map(common.quoted, columns)), text=common.quoted(text)), items, text="text", **settings)
    return found.select(*common.unpacked(columns), *added)


def several(docs: DataFrame, parts: list, keep: list[str], text: str) -> DataFrame:
    """scan() for a benchmark of more than one slice: each slice reads the documents once, hits meet per document."""
    rows = docs.select(*keep, text, F.monotonically_increasing_id().alias("_row"))
    rows = common.written(rows, "scanned")  # the row numbers have to hold for every slice
    found = None
    for part in parts:
        one = scan(rows, part, [*keep, "_row"], text)
        found = one if found is None else found.unionByName(one)

    def union(name: str, a: str, b: str):
        """Overlapping or touching spans of all slices as one."""
        laid = F.array_sort(F.flatten(F.collect_list(name)))

        def add(acc, s):
            last = F.element_at(acc, -1)
            joins = (F.size(acc) > 0) & (s[a] <= F.try_element_at(acc, F.lit(-1))[b])
            wide = F.struct(last[a].alias(a), F.greatest(last[b], s[b]).alias(b))
            return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(laid, F.array().cast(f"array<struct<{a}:bigint,{b}:bigint>>"), add)

    first = [F.first(c).alias(c) for c in [*keep, "n_words"]]
    merged_runs = found.groupBy("_row").agg(*first, union("runs", "from", "to").alias("runs"), union("spans", "start", "end").alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged_runs.drop("_row")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, bw.n, bw.id FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
