"""Token counts by a two-tier lookup on the map side.

A subword encoder that never merges over a blank or a line feed gives a text as many tokens as its pre-tokens have in
sum. The lengths of the pre-tokens that are frequent in the whole corpus go to every task as one broadcast table of
bounded size; others are encoded where they occur and kept in a bounded cache of the worker. No pre-token is shuffled:
the first pass sends at most `per_task` summed candidates from each task, the second only looks up.

Empty and null texts have 0 bytes and 0 tokens. Repeated rows are counted each. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common

MODEL = "piece_bpe_32k.model"
SLOW = re.compile("  | \n|[ ▁]$|^[ \n▁]|▁")
UNITS = re.compile(r"\n+[^ \n]*| +[^ \n]*|[^ \n]+")
#: Entries of a worker's cache, and the longest pre-token kept there.
CACHE, LONGEST = 400_000, 64


def encoder(path: str):
    """The encoder of a model file, checked to be additive over pre-tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("the model merges over blanks or line feeds; its counts are not sums over pre-tokens")
    return sp


def units(text: str) -> list[str]:
    """Pre-tokens of a text: a word with its blanks before it, or with its line feeds before it.

    A word after a single blank is given bare; one after line feeds starts with them. The first word counts as after a blank.
    """
    if not text:
        return []
    if not SLOW.search(text):
        return text.replace("\n", " \n").split(" ")
    found = UNITS.findall(" " + text.replace("▁", " "))
    return [u[1:] if u[0] == " " else u for u in found]


def lengths(sp, found: list[str]) -> list[int]:
    """Tokens of each pre-token: a bare blank has one; after a line feed, the blank that the library puts first is taken off."""
    return [len(ids) - (u[:1] == "\n") + (not u) for u, ids in zip(found, sp.encode(found, num_threads=1))]


def frequent(docs: DataFrame, text: str, entries: int, per_task: int) -> list[str]:
    """The pre-tokens with the highest counts over all texts; each task sends at most per_task of its own."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.split(" "))
            if len(seen) > 50 * per_task:
                seen = Counter(dict(seen.most_common(10 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if n > 1 and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    found = docs.select(F.col(text)).mapInArrow(count, "unit string, n long")
    top = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(entries)
    return [r.unit for r in top.collect()]


def token_counts(
    docs: DataFrame, model: str | None = None, text: str = "text", entries: int = 20_000, per_task: int = 4_000
) -> DataFrame:
    """docs without its text, with n_bytes and n_tokens. model: a sentencepiece file's path, the same on every executor."""
    spark = docs.sparkSession
    common.small_batches(spark)
    model = model or model_path()
    top = frequent(docs, text, entries, per_task)
    known = spark.sparkContext.broadcast(dict(zip(top, lengths(encoder(model), top))) if top else {})

    def make() -> Callable[[str], tuple]:
        sp = encoder(model)
        first, second = known.value, {}

        def of(t: str) -> tuple:
            found, total, missed = units(t), 0, []
            for u in found:
                n = first.get(u)
                if n is None:
                    n = second.get(u)
                    if n is None:
                        missed.append(u)
                        continue
                total += n
            if missed:
                if len(second) > CACHE:
                    second.clear()
                for u, n in zip(missed, lengths(sp, missed)):
                    total += n
                    if len(u) <= LONGEST:
                        second[u] = n
            return (total,)

        return of

    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))
    sized = slim.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), text)
    return common.with_arrow(sized, make, [*keep, "n_bytes"], text, "n_tokens long")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
