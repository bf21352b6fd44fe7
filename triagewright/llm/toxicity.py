"""Toxicity by weak supervision.

Many weak voters vote toxic, clean or not at all on each text: fixed lexicons (insults by kind and language, disgust, threats, hate, profanity, spelt
out or disguised), patterns (frames that address someone, shouting, runs of marks), and lexicons of words and word beginnings found in the labelled
sample, for languages that no fixed list covers. A generative label model estimates each voter's accuracy by expectation maximisation, and
the correlations of voters given the label, which discount voters that repeat each other; report() tells them. Its posteriors, not the
given labels, train a linear classifier over words and word beginnings, which scores every whole text.

Models are fitted in numpy on a bounded sample of labelled rows (`train_rows`, about that many, 1.5 times at most), none of
them held out. The labels give the found lexicons, whose words lean further than chance allows, and the prior. The classifier is a table of at most
MAX_FEATURES weights (the sample has some hundreds that lean), and is broadcast. Null and empty texts have no words and get the score of the bias; with
no labelled rows all scores are 0. Repeated documents are scored each; a label row whose doc_id occurs in many documents counts once, with the least text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common

TRAIN_ROWS, MAX_FEATURES, LEXICONS = 4000, 20_000, 12
EDGES = "\"'.,;:!?()[]{}<>|*_-"
#: Fixed lexicons, a voter each. A word that begins with one of them counts, as endings differ.
FIXED = {
    "insults to sense": ("idiot", "moron", "stupid", "dumb", "imbecile", "brainless", "dimwit", "halfwit"),
    "insults to worth": ("loser", "worthless", "pathetic", "good-for-nothing"),
    "insults to person": ("scum", "trash", "clown", "vermin", "creep", "coward"),
    "disgust": ("disgust", "revolting", "repulsive", "vile", "filthy", "sicken"),
    "threats": ("kill you", "murder you", "strangle", "beat you", "hurt you", "drop dead"),
    "hate": ("hate you", "despise", "loathe", "detest"),
    "profanity": ("damn", "crap", "bitch", "bastard", "fuck", "shit", "asshole", "whore", "slut"),
    "german": ("dumm", "trottel", "arschloch", "scheiss", "schei\u00df", "abschaum", "schwachkopf", "versager", "widerlich", "ekelhaft", "wertlos", "m\u00fcll"),
    "french": ("imb\u00e9cile", "cr\u00e9tin", "salaud", "connard", "merde", "putain", "ordure", "d\u00e9go\u00fbtant", "minable", "abruti", "d\u00e9bile"),
    "spanish": ("est\u00fapido", "imb\u00e9cil", "basura", "mierda", "cabr\u00f3n", "puta", "asqueroso", "in\u00fatil", "pat\u00e9tico", "escoria", "gilipollas"),
}
SOLID = {name: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + ")", re.IGNORECASE) for name, words in FIXED.items()}
#: Patterns, a voter each: frames that address someone, disguised spellings, shouting, runs of marks.
PATTERNS = {
    "address": re.compile(r"(?<!\w)(?:you(?:'re| are)? (?:all |such |a |an |so )*(?:idiot|moron|stupid|loser|pathetic|scum|trash|clown|worthless|disgusting)|shut up|go to hell|get lost)", re.IGNORECASE),
    "disguise": re.compile(r"(?<!\w)(?:[a-z]+[*$#!]+[a-z*]+|[a-z]*(?:1d10t|st\*pid|m0ron|l0ser)[a-z]*)(?!\w)", re.IGNORECASE),
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3,}"),
    "marks": re.compile(r"[!?]{3,}"),
}
#: Entries of a worker's cache of words.
CACHE = 500_000


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters."""
    w = word.strip(EDGES)
    return [w, *(f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k)] if w else []


def features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)}


def bucket(feature: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % n


def evidence(n: np.ndarray, hits: np.ndarray, share: float) -> np.ndarray:
    """For features in n texts, of them hits toxic: log likelihood ratio against occurring like any text, negative if rarer."""
    r = hits / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = n * (np.nan_to_num(r * np.log(r / share)) + np.nan_to_num((1 - r) * np.log((1 - r) / (1 - share))))
    return np.where(r > share, g, -g)


def leaning(bags: list[set[str]], toxic: np.ndarray) -> dict[str, float]:
    """Features that occur so unevenly that chance would hardly give one such in all of them; with their evidence."""
    n: Counter = Counter()
    hits: Counter = Counter()
    for bag, y in zip(bags, toxic):
        n.update(bag)
        if y > 0.01:
            for f in bag:
                hits[f] += y
    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    names = list(n)
    g = evidence(np.array([n[f] for f in names], float), np.array([min(hits[f], n[f]) for f in names], float), share)
    return {f: float(x) for f, x in zip(names, g) if abs(x) > np.log(len(names) + 1) + 3}


def lexicons(lean: dict[str, float], groups: int = LEXICONS) -> list[tuple[int, frozenset[str]]]:
    """(vote, features): what leans to toxic texts, dealt into lexicons of words and of beginnings; and what leans to clean ones."""
    half = groups // 2
    words: list[set[str]] = [set() for _ in range(groups)]
    for f in (f for f, x in lean.items() if x > 0):
        words[bucket(f, half) + (half if f.endswith("*") else 0)].add(f)
    good = frozenset(f for f, x in lean.items() if x < 0)
    return [(1, frozenset(w)) for w in words if w] + ([(-1, good)] if good else [])


def fixed_votes(text: str) -> list[int]:
    """Votes of the fixed lexicons and patterns, which need no labels. They know few words, so finding none says nothing."""
    low = text.lower()
    said = [1 if any(w in low for w in FIXED[name]) and SOLID[name].search(text) else 0 for name in FIXED]
    return said + [1 if p.search(text) else 0 for p in PATTERNS.values()]


def voters(lists: list[tuple[int, frozenset[str]]]) -> list[str]:
    return [f"found {i}" if vote == 1 else "found clean" for i, (vote, _) in enumerate(lists)] + [*FIXED, *PATTERNS]


def votes(text: str, bag: set[str], lists: list[tuple[int, frozenset[str]]]) -> list[int]:
    """Votes of all voters: 1 toxic, -1 clean, 0 none. A found toxic lexicon that finds nothing votes clean."""
    out = []
    for vote, words in lists:
        found = not words.isdisjoint(bag)
        out.append((1 if found else -1) if vote == 1 else (-1 if found else 0))
    return out + fixed_votes(text)


@dataclass
class LabelModel:
    prior: float
    #: For each voter, log odds that its vote (clean, none, toxic) adds.
    odds: np.ndarray
    correlation: np.ndarray
    #: What a voter counts, less if others say the same.
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        each = self.odds[np.arange(v.shape[1])[None, :], v + 1]
        z = np.log(self.prior / (1 - self.prior)) + (each * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def report(self, names: list[str], v: np.ndarray) -> list[dict]:
        """For each voter: how often it votes, its estimated accuracy when it does, its weight, and the voter it goes with most."""
        q, out = self.posterior(v), []
        for j, name in enumerate(names):
            said = v[:, j] != 0
            right = np.where(v[:, j] == 1, q, 1 - q)[said]
            others = np.where(np.arange(len(names)) == j, -1, self.correlation[j])
            out.append({"voter": name, "coverage": float(said.mean()) if len(v) else 0.0, "accuracy": float(right.mean()) if said.any() else None, "weight": float(self.weight[j]), "with": names[int(others.argmax())], "correlation": float(others.max())})
        return out


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over votes (rows x voters), begun from the vote's majority."""
    j = v.shape[1]
    prior = float(np.clip(prior, 0.01, 0.99))
    model = LabelModel(prior, np.zeros((j, 3)), np.eye(j), np.ones(j))
    q = np.clip((v == 1).sum(1) / np.maximum((v != 0).sum(1), 1), 0, 1)
    q = np.where(q > np.quantile(q, 1 - prior), 0.95, np.where((v == 1).any(1), 0.5, 0.05)) if len(q) else q
    onehot = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        p1 = (np.tensordot(q, onehot, (0, 0)) + 0.5) / (q.sum() + 1.5)
        p0 = (np.tensordot(1 - q, onehot, (0, 0)) + 0.5) / ((1 - q).sum() + 1.5)
        model.odds = np.log(p1 / p0)
        mean = q[:, None] * (p1[:, 2] - p1[:, 0])[None, :] + (1 - q)[:, None] * (p0[:, 2] - p0[:, 0])[None, :]
        rest = v - mean
        sd = rest.std(0) + 1e-6
        model.correlation = (rest.T @ rest) / max(1, len(v)) / np.outer(sd, sd)
        model.weight = 1 / np.maximum(1, (np.clip(model.correlation, 0, 1)).sum(1))
        q = model.posterior(v)
    return model


def fit_linear(bags: list[set[str]], soft: np.ndarray, lean: dict[str, float], epochs: int = 12) -> tuple[float, dict[str, float]]:
    """Logistic regression on soft labels over the leaning features, by AdaGrad with a small L2."""
    chosen = sorted(lean, key=lambda f: (-abs(lean[f]), f))[:MAX_FEATURES]
    at = {f: i for i, f in enumerate(chosen)}
    rows = [np.array(sorted(at[f] for f in bag if f in at), np.int64) for bag in bags]
    w, g2, bias, b2 = np.zeros(len(chosen)), np.full(len(chosen), 1e-3), 0.0, 1e-3
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            d = 1 / (1 + np.exp(-np.clip(bias + w[r].sum(), -30, 30))) - soft[i]
            g = d + 1e-4 * w[r]
            g2[r] += g * g
            w[r] -= 0.2 * g / np.sqrt(g2[r])
            b2 += d * d
            bias -= 0.2 * d / b2**0.5
    return float(bias), {f: float(x) for f, x in zip(chosen, w) if x}


def apart(bags: list[set[str]], slots: int = 4) -> list[int]:
    """Numbers of the bags without copies of earlier ones: two of four minima of hashed long words agree.

    Copies say the same thing again; counted one by one they would make every word of a copied text look telling.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for i, bag in enumerate(bags):
        long = [w.encode("utf-8", "surrogatepass") for w in bag if len(w) >= 8]
        own = {(k, min(zlib.crc32(w, k * 7919) for w in long)) for k in range(slots)} if long else set()
        if len(own & seen) < 2:
            out.append(i)
            seen |= own
    return out


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]
    labels: LabelModel | None
    #: LabelModel.report() over the sample.
    voters: list[dict] | None = None


def fit(rows: Iterable[tuple[str, int]]) -> Classifier:
    """rows: (text, toxic). The labels give the lexicons and the prior; the posteriors of the votes train the classifier."""
    rows = list(rows)
    if not rows or len({y for _, y in rows}) < 2:
        return Classifier(-30.0 if not any(y for _, y in rows) else 30.0, {}, None)
    bags = [features(t) for t, _ in rows]
    own = apart(bags)
    rows, bags = [rows[i] for i in own], [bags[i] for i in own]
    toxic = np.array([y for _, y in rows])
    lean = leaning(bags, toxic)
    lists = lexicons(lean)
    v = np.array([votes(t, bag, lists) for (t, _), bag in zip(rows, bags)])
    labels = fit_label_model(v, float(toxic.mean()))
    bias, weights = fit_linear(bags, labels.posterior(v), lean)
    return Classifier(bias, weights, labels, labels.report(voters(lists), v))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier from about train_rows labelled rows, none of them held out. The sampled label rows are few, so they are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~common.held_out(F.col(key))).groupBy(key).agg(F.max(label).alias(label))
    some = common.bounded_sample(known, key, train_rows)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(text)).join(F.broadcast(some), key).groupBy(key).agg(F.min(text).alias(text), F.max(label).alias(label)).collect()
    order = sorted(rows, key=lambda r: hashlib.md5(str(r[key]).encode()).digest())
    return fit((r[text], int(r[label])) for r in order)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs without its text, with toxic_score (0 to 1): the classifier over the distinct words of the whole text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[str], tuple]:
        bias, weights = shared.value.bias, shared.value.weights
        known: dict[str, tuple[str, ...]] = {}

        def of(t: str) -> tuple:
            found: set[str] = set()
            for w in set(t.lower().split()):
                own = known.get(w)
                if own is None:
                    own = tuple(f for f in word_features(w) if f in weights)
                    if len(known) > CACHE:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = own
                if own:
                    found.update(own)
            z = bias + sum(weights[f] for f in sorted(found))
            return (float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))),)

        return of

    keep = [c for c in docs.columns if c not in (text, "toxic_score")]
    return common.with_arrow(docs, make, keep, text, "toxic_score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = score(docs, model).withColumnRenamed("toxic_score", "score")
    return out.select("doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
