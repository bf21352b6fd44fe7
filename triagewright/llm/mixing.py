"""Mixing sources to target weights, in DataFrame functions alone.

Soft membership: a classifier learnt from a labelled table gives each document a posterior over domains. Documents then get
nonnegative rates whose expected domain token totals match targets: the least squares problem

    min 1/2 e' M^-1 e,  e_k = sum_d w_d r_d p_dk - b_k,  r >= 0,  w_d = tokens_d / all tokens

is solved by projected gradient steps from r = 1. M_kl = sum of w_d p_dk p_dl over the documents whose rate isn't at zero weighs the domains' errors,
so that a rare domain, or one whose posteriors resemble another's, counts as much as any other; a step that takes no rate to zero is exact then,
and few rounds do. A pass over the slim table of posteriors sums up error and weights (as many numbers as there are domains, and their square);
a rate depends on the posterior and on the steps so far alone, so rates are an expression over a few literals, and no iterate is stored,
shuffled or collected. Rounds end when the totals of the rates are within `close` of the targets, or when they get no closer (targets that no
rates meet).

The classifier is a naive Bayes model over words and over tags of length, word length, repetition, marks and capitals, all hashed to BUCKETS
log odds, counted by Spark on a bounded sample of labelled rows (`train_rows`, about that many, 1.5 times at most), none of them held out.
A word counts for a domain where it is RATIO times as frequent as elsewhere and that far beyond chance (LEAN deviations); common words, which lean a
little with the length of texts, count for none. Every bucket is looked up, so no word is left out for want of room. Plans carry the odds of
the buckets that tell alone, and a bit for each bucket by which their places are counted, as plans are kept and printed many times.

Null and empty texts have no tokens and the domains' shares by their tags alone; their rate is as any other's. Repeated rows each get a
rate. With no labels there is one domain, `unknown`. Targets need not sum to 1; a domain without target has target 0. An empty table gives an
empty table. Other columns stay, whatever their names; those named as what is added are replaced.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common
from triagewright.llm.fingerprints import let

TRAIN_ROWS, BUCKETS, LEAN, RATIO, ROUNDS = 4000, 65_536, 5.0, 2.0, 40
#: Fewer training texts than these tell nothing of a word.
SEEN = 4
#: Slots of a tag, and of all that a document can have.
LEVELS = 24
SLOTS = BUCKETS + 6 * LEVELS
#: Domains of the labels table, and what share of all tokens each should have.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
WORD = r"[^\p{L}\p{N}]+"
ADDED = ("n_tokens", "posterior", "rate", "copies")


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality.isNotNull() | toxic.isNotNull(), "clean")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), "")


def features(w: Column, text: Column) -> Column:
    """Buckets of the distinct words, and after them, in slots of their own, tags: how many words, how long, how often repeated, how much of the text
    is no word or in capitals, how often its lines are repeated. w: the words of text."""
    chars = F.greatest(F.length(text), F.lit(1))
    level = lambda n, x: F.least(x.cast("int"), F.lit(LEVELS - 1)) + (BUCKETS + n * LEVELS)
    lines = F.split(text, "\n")
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))

    def of(n: Column, unique: Column) -> Column:
        some = F.greatest(n, F.lit(1))
        marks = chars - F.length(F.array_join(w, "")) - n
        tags = F.array(
            level(0, F.floor(F.log2(n + F.lit(1.0)))),
            level(1, F.floor(chars / some)),
            level(2, F.floor(F.size(unique) * 10 / some)),
            level(3, F.floor(F.greatest(marks, F.lit(0)) * 20 / chars)),
            level(4, F.floor(capitals * 20 / chars)),
            level(5, let(lines, lambda x: F.floor(F.size(F.array_distinct(x)) * 5 / F.size(x)))),
        )
        return F.concat(F.transform(unique, lambda f: F.pmod(F.xxhash64(f), F.lit(BUCKETS)).cast("int")), tags)

    return let(F.array_distinct(w), lambda u: of(F.size(w), u))


def fit_domains(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """domains, their log priors, and for each domain the log odds of every bucket. labels: (key, domain)."""
    known = labels.where(F.col("domain").isNotNull() & F.col(key).isNotNull() & ~common.held_out(F.col(key))).groupBy(key).agg(F.min("domain").alias("domain"))
    some = common.bounded_sample(known, key, train_rows)
    rows = docs.select(key, text).join(F.broadcast(some), key).select("domain", F.coalesce(text, F.lit("")).alias("t"))
    bags = rows.select("domain", let(words(F.col("t")), lambda w: F.array_distinct(features(w, F.col("t")))).alias("f"))
    sizes = {r.domain: r.n for r in bags.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return {"domains": ["unknown"], "prior": [0.0], "odds": [[0.0] * SLOTS]}
    each = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    odds = [[0.0] * SLOTS for _ in domains]
    counts = bags.select("domain", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *each)
    for r in counts.where((F.col("n") >= SEEN) | (F.col("f") >= BUCKETS)).toLocalIterator():
        for i, d in enumerate(domains):
            n, expected = r[f"n{i}"], r.n * sizes[d] / total
            own = math.log((n + 0.5) / (sizes[d] + 1)) - math.log((r.n + 0.5) / (total + 1))
            telling = r.n >= SEEN and own > math.log(RATIO) and (n - expected) / math.sqrt(expected + 1) > LEAN
            odds[i][r.f] = own if r.f >= BUCKETS or telling else 0.0
    return {"domains": domains, "prior": [math.log(sizes[d] / total) for d in domains], "odds": odds}


def numbers(values: list[float]) -> Column:
    """A constant array. One text literal, as thousands of single ones take long to plan."""
    return F.split(F.lit(",".join(f"{x:.5g}" for x in values)), ",").cast("array<double>")


def places(slots: list[int]) -> tuple:
    """(has, place): functions of a slot's column: whether it is among slots (sorted), and how many are before it. A bit a slot, in words of 32."""
    words = [0] * (SLOTS // 32 + 1)
    for j in slots:
        words[j >> 5] |= 1 << (j & 31)
    before = [0, *accumulate(w.bit_count() for w in words)][:-1]
    whole = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    bits, start = whole(words), whole(before)
    word, at = (lambda j: F.shiftright(j, 5)), (lambda j: j.bitwiseAND(F.lit(31)))
    mask = lambda j: F.call_function("shiftleft", F.lit(1).cast("bigint"), at(j)) - 1
    has = lambda j: F.bit_get(F.get(bits, word(j)), at(j)) == 1
    place = lambda j: (F.get(start, word(j)) + F.bit_count(F.get(bits, word(j)).bitwiseAND(mask(j)))).cast("int")
    return has, place


def once(c: Column) -> Column:
    """c, worked out once a row: the optimizer writes a column out again at every use of it, filters too, but not through a generator."""
    return F.explode(F.array(c))


def posteriors(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns (all but the text, if not given) with n_tokens (words) and p: the domains' probabilities, in the model's order."""
    keep = keep if keep is not None else [c for c in docs.columns if c not in (text, "n_tokens", "p")]
    slots = [j for j, x in enumerate(zip(*model["odds"])) if any(x)]
    odds = [numbers([x[j] for j in slots] or [0.0]) for x in model["odds"]]
    has, place = places(slots)
    held = F.coalesce(common.quoted(text), F.lit(""))
    telling = lambda f: F.transform(F.filter(features(f, held), has), place)
    score = lambda found, i: F.aggregate(found, F.lit(float(model["prior"][i])), lambda a, j: a + F.get(odds[i], j))
    scores = lambda found: F.array(*[score(found, i) for i in range(len(odds))])
    soft = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    p = lambda w: let(let(let(telling(w), scores), soft), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))
    found = let(words(held), lambda w: F.struct(F.size(w).cast("long").alias("n"), p(w).alias("p")))
    return docs.select(*map(common.quoted, keep), once(found).alias("_found")).select(*map(common.quoted, keep), F.col("_found.n").alias("n_tokens"), F.col("_found.p").alias("p"))


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after these steps. A step: for each domain the weighted error."""
    laid = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    dot = lambda g: sum((F.get(p, F.lit(i)) * F.get(g, F.lit(i)) for i in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(laid, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g))) if steps else F.lit(1.0)


def solved(m: list[list[float]], e: list[float]) -> list[float]:
    """x of (m + a little) x = e, for a few domains."""
    k, ridge = len(e), 1e-9 * sum(m[i][i] for i in range(len(e))) or 1.0
    rows = [[*(x + ridge * (i == j) for j, x in enumerate(row)), e[i]] for i, row in enumerate(m)]
    for i in range(k):
        top = max(range(i, k), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for r in range(k):
            if r != i:
                part = rows[r][i] / rows[i][i]
                rows[r] = [a - part * b for a, b in zip(rows[r], rows[i])]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def solve(soft: DataFrame, targets: list[float], rounds: int = ROUNDS, close: float = 1e-6) -> list[list[float]]:
    """The steps whose rates bring the expected shares of soft (n_tokens, p) to the targets. Sums over all rows; a few numbers reach the driver a round."""
    k = len(targets)
    p, steps, best, since = F.col("p"), [], math.inf, 0
    for _ in range(rounds):
        at = soft.select(F.col("n_tokens").cast("double").alias("w"), "p", rate(p, steps).alias("r"))
        part = lambda i: F.get(p, F.lit(i))
        live = F.when(F.col("r") > 0, F.col("w")).otherwise(0.0)
        sums = at.agg(
            F.sum("w").alias("all"), *[F.sum(F.col("w") * F.col("r") * part(i)).alias(f"e{i}") for i in range(k)],
            *[F.sum(live * part(i) * part(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)],
        ).first()
        if not sums["all"]:
            return []
        e = [sums[f"e{i}"] / sums["all"] - targets[i] for i in range(k)]
        worst = max(map(abs, e))
        since = 0 if worst < 0.99 * best else since + 1
        best = min(best, worst)
        if worst < close or since >= 10:
            break
        steps.append(solved([[sums[f"m{max(i, j)}_{min(i, j)}"] / sums["all"] for j in range(k)] for i in range(k)], e))
    return steps


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, train: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, posterior (domain to probability), rate and copies: the rate as a whole number that is right on average, by a hash of key and text.

    labels: (key, domain). train: the documents that labels tell of, if others than docs. Only the slim table of posteriors is written; with keep_text the
    last pass scores the texts again rather than write them twice.
    """
    model = fit_domains(train if train is not None else docs, labels, key, text)
    names, columns = model["domains"], [c for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    spread = F.pmod(F.xxhash64(common.quoted(key), common.quoted(text), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = common.packed(docs.select(*map(common.quoted, dict.fromkeys([*columns, key, text]))), without=() if keep_text else (text,), text=common.quoted(text), spread=spread)
    slim = common.written(posteriors(rows, model, keep=[] if keep_text else ["doc", "spread"]), "posteriors")
    steps = solve(slim.select("n_tokens", "p"), [float(targets.get(n, 0.0)) for n in names], rounds)
    exact = (posteriors(rows, model, keep=["doc", "spread"]) if keep_text else slim).withColumn("rate", once(rate(F.col("p"), steps)))
    copies = (F.floor("rate") + (F.col("spread") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return exact.select(*common.unpacked(columns), "n_tokens", F.map_from_arrays(F.lit(names), F.col("p")).alias("posterior"), "rate", copies.alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mix(docs, label_domains(common.table(spark, sf_dir, "labels")), TARGETS, keep_text=False)
    each = [F.coalesce(F.element_at("posterior", d), F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS]
    return out.select("doc_id", "n_tokens", *each, "rate", "copies")
