"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Features are the letter bigrams and trigrams of the lower-cased text, with word edges, hashed to BUCKETS rows of an
embedding; their mean goes through a softmax layer. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (`train_rows`, about that many, 1.5 times at most). A part of the sample is kept for calibration: a scale of the scores that depends on
the number of features (a short text tells less), and the score below which a prediction is rejected. As nothing stands
between embedding and softmax, tasks get their product, one row of class scores a bucket, whose size is fixed.

Every whole text is scored. Texts that are null or have no letter get `und` with score 0. Without labelled rows all do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from triagewright.llm import common

BUCKETS, DIM = 1 << 15, 16
TRAIN_ROWS = 3000
#: Code points of one step of scoring, so that memory doesn't grow with a text.
STEP = 1 << 18


def letters() -> np.ndarray:
    """For each code point, itself if a letter, else 0: an edge."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def features(codes: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams and trigrams of code points; those that hold no letter are left out."""
    c = codes.astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F) + np.uint64(1)
    out = np.concatenate([two[(c[:-1] | c[1:]) > 0], three[(c[:-2] | c[1:-1] | c[2:]) > 0]])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def codes_of(text: str, table: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[np.uint32(0)], table[raw], [np.uint32(0)]])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages
    scale: tuple[float, float]
    floor: float

    def probabilities(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = mean * np.exp(self.scale[0] + self.scale[1] * np.log1p(n))[:, None]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 4, seed: int = 5) -> Model | None:
    """rows: (text, lang). Every tenth row is kept for calibration."""
    langs, table, rng = sorted({lang for _, lang in rows}), letters(), np.random.default_rng(seed)
    if not langs:
        return None
    order = {lang: i for i, lang in enumerate(langs)}
    bags, held = [], []
    for k, (text, lang) in enumerate(rows):
        codes = codes_of(text, table)
        cut = int(rng.integers(0, max(1, len(codes) - 60)))
        for part in (codes, np.concatenate([[0], codes[cut : cut + 60], [0]])):  # short pieces, as short texts occur too
            f, n = np.unique(features(part), return_counts=True)
            if len(f):
                (held if k % 10 == 9 else bags).append((f, (n / n.sum()).astype(np.float32), int(n.sum()), order[lang]))
    if not bags:
        return None
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    for epoch in range(epochs):
        rate = np.float32(2.0 * (1 - epoch / epochs))
        for i in rng.permutation(len(bags)):
            f, w, _, y = bags[i]
            mean = w @ emb[f]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            emb[f] -= rate * len(f) ** 0.5 * w[:, None] * back[None, :]
    scores = emb @ out
    model = Model(langs, scores.astype(np.float32), (0.0, 0.0), 0.0)
    return calibrated(model, held or bags)


def calibrated(model: Model, bags: list, kept: float = 0.999) -> Model:
    """The scale with the least log loss on held-back rows, and the floor under which all but `kept` of the right ones stay."""
    mean = np.array([w @ model.scores[f] for f, w, _, _ in bags])
    n, y = np.array([b[2] for b in bags]), np.array([b[3] for b in bags])
    best, loss = model.scale, np.inf
    for a in np.linspace(-4, 3, 29):
        for b in np.linspace(0, 0.6, 7):
            model.scale = (a, b)
            p = model.probabilities(mean, n)[np.arange(len(y)), y]
            if (now := -np.log(np.maximum(p, 1e-9)).mean()) < loss:
                best, loss = (a, b), now
    model.scale = best
    p = model.probabilities(mean, n)
    right = p.max(1)[p.argmax(1) == y]
    model.floor = float(min(np.quantile(right, 1 - kept), 0.5)) if len(right) else 0.0
    return model


def score_batch(texts: list[str | None], model: Model, table: np.ndarray) -> tuple[list[str], list[float]]:
    """Texts are laid end to end with edges between, in steps of bounded size; sums of class scores per text."""
    sums = np.zeros((len(texts), len(model.langs)))
    counts = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if text:
            for at in range(0, len(text), STEP):
                codes = codes_of(text[max(0, at - 2) : at + STEP], table)
                codes = codes[1:] if at else codes
                f = features(codes if at + STEP >= len(text) else codes[:-1])
                if len(f) > BUCKETS // 8:
                    seen = np.bincount(f, minlength=BUCKETS)
                    sums[k] += seen @ model.scores
                elif len(f):
                    sums[k] += model.scores[f].sum(0)
                counts[k] += len(f)
    p = model.probabilities(sums / np.maximum(counts, 1)[:, None], counts)
    top = p.argmax(1)
    return [model.langs[t] if c else "und" for t, c in zip(top, counts)], [float(p[i, t]) if c else 0.0 for i, (t, c) in enumerate(zip(top, counts))]


def fit_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from about train_rows labelled rows, none of them held out."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~common.held_out(F.col(key)))
    rows = common.bounded_sample(labelled.select(key, text, lang), key, train_rows, (text, lang)).collect()
    return train([(r[text], r[lang]) for r in sorted(rows, key=lambda r: (r[key], r[text], r[lang]))])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_rejected: und, or a score under the model's floor."""
    common.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    out = StructType([docs.schema[c] for c in keep] + StructType.fromDDL("lang_pred string, lang_score double, lang_rejected boolean").fields)
    schema, shared = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, letters()
        for b in batches:
            n = b.num_rows
            langs, scores = score_batch(b.column(text).to_pylist(), own, table) if own else (["und"] * n, [0.0] * n)
            floor = own.floor if own else 0.0
            rejected = [a == "und" or s < floor for a, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema=schema)

    return docs.select(*keep).mapInArrow(run, out)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
