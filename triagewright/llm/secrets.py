"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand. Weak candidates (a mixed 40-character token that may be a secret key,
an account name, an endpoint) say little alone, so they are reported only when the parts that complete them stand in the
same scope (a block without a blank line) within `reach` code points: a secret needs an access identifier, an account a
secret, an endpoint both. The parts of a document are joined as intervals by one sweep over their sorted ends, so nothing
is shuffled and no pairs are made.

Null and empty texts have no spans. Spans are code points, end exclusive. Repeated documents are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Every match of ASSIGN holds one of these, in either case.
CUES = ("pass", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak candidates.
KEY = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ACCOUNT = re.compile(r"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|s3)://[^\s\"'<>|]{4,}")
KINDS = ("assign", "access", "hex", "key", "account", "endpoint")
#: What part of a credential each kind is.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
NEEDS = {"key": ("identifier",), "account": ("secret",), "endpoint": ("identifier", "secret")}
REACH = 300

Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    """The spans of the strong patterns. A match whose value is too short is dropped, and what it covered isn't searched again."""
    out: list[Span] = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that no strong span overlaps."""
    found = [("key", *m.span()) for m in KEY.finditer(text) if mixed(m[0])]
    low = text.lower()
    if any(c in low for c in ("user", "login", "account", "client")):
        found += [("account", *m.span()) for m in ACCOUNT.finditer(text)]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # those that begin before b; the furthest end among them counts
        return not i or ends[i - 1] <= a

    return [s for s in found if free(s[1], s[2])]


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def linked(text: str, base: list[Span], loose: list[Span], reach: int) -> list[Span]:
    """The weak candidates whose complementary parts stand in their scope, within reach."""
    if not loose:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    parts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for kind, a, b in [*base, *loose]:
        parts.setdefault((ROLE[kind], bisect_right(breaks, a)), []).append((a, b))
    reached: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for key, spans in parts.items():
        spans.sort()
        latest, ends = 0, []
        for _, b in spans:
            latest = max(latest, b)
            ends.append(latest)
        reached[key] = [a for a, _ in spans], ends

    def near(role: str, scope: int, a: int, b: int) -> bool:
        starts, ends = reached.get((role, scope), ([], []))
        i = bisect_right(starts, b + reach)  # those that begin before the reach ends; the furthest end among them counts
        return i > 0 and ends[i - 1] >= a - reach

    return [(k, a, b) for k, a, b in loose if all(near(r, bisect_right(breaks, a), a, b) for r in NEEDS[k])]


def scanner(reach: int) -> Callable[[str], tuple[list[Span], list[Span]]]:
    def scan(text: str) -> tuple[list[Span], list[Span]]:
        base = strong(text)
        return base, linked(text, base, weak(text, base), reach)

    return scan


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """docs without its text, with base and linked: arrays of (kind, start, end), in order."""
    common.small_batches(docs.sparkSession)

    def make() -> Callable[[str], tuple]:
        scan = scanner(reach)
        named = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in ordered(spans)]
        return lambda t: tuple(map(named, scan(t)))

    keep = [c for c in docs.columns if c not in (text, "base", "linked")]
    return common.with_arrow(docs, make, keep, text, "base array<struct<kind:string,start:long,end:long>>, linked array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text: str = "text", reach: int = REACH, mask: str = "<secret>") -> DataFrame:
    """docs with every found span, strong or linked, replaced by the mask; null texts stay null. Other columns stay, whatever their names."""
    common.small_batches(docs.sparkSession)

    def make() -> Callable[[str], tuple]:
        scan = scanner(reach)

        def of(t: str) -> tuple:
            spans = ordered([s for found in scan(t) for s in found])
            out, at = [], 0
            for _, a, b in spans:
                if a >= at:
                    out += [t[at:a], mask]
                at = max(at, b)
            return ("".join([*out, t[at:]]) if spans else t, len(spans))

        return of

    rows = common.packed(docs, without=(text,), text=common.quoted(text))
    clean = common.with_arrow(rows.withColumn("bare", F.col("text").isNull()), make, ["doc", "bare"], "text", "clean string, found int")
    return clean.select(*common.unpacked(docs.columns, **{text: F.when(~F.col("bare"), F.col("clean"))}))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"])
    everything = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"))
