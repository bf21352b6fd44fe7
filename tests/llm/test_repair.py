"""Repairs against a search over all edits, with pieces of any size."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest

from triagewright.llm import repair as R


def initial(role):
    return role[:1]


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The cheapest edits by a search in order of (cost, audit): every node is left first by its best way."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    fault = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    answers = []
    while heap:
        cost, audit, i, out, lines = heapq.heappop(heap)
        if answers and cost > answers[0][0]:
            break
        if (i, out, audit) in done or len(out) > len(rows) + 4:
            continue
        done.add((i, out, audit))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            answers.append((cost, audit, lines))
        step = lambda c, letter, n, role, line: heapq.heappush(heap, (cost + c, audit + letter, n, out + role, (*lines, line) if line is not None else lines))
        for role in ("user", "assistant"):
            if re.fullmatch("(s?(ua)*u?)?", out + role[0]):
                step(2, "I", i, role[0], f"{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            step(3, "D", i + 1, "", None)
            if fault[i] not in ("blank", "duplicate"):
                extra = fault[i] == "truncated"
                if role and re.fullmatch("s?|s?(ua)*u?", out + initial(role)):
                    step(extra, "K", i + 1, initial(role), f"{role}:{text}")
                for to in ("user", "assistant"):
                    if re.fullmatch("s?(ua)*u?", out + to[0]):
                        step(2 + extra, "R", i + 1, to[0], f"{to}:{text}")
    cost, audit, lines = min(answers)
    turns = [t for t, _, _ in rows if t is not None]
    first = [initial(r) for _, r, _ in rows]
    text = "\n".join(lines)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(), text,
    )


def conversation(rng, most):
    roles = ["user", "assistant", "system", "tool", "", None, "sage", "User"]
    texts = ["Hi.", "Go on", "  ", "", None, "Yes!", "No?\n", "Wh. at", "Hi."]
    return [(rng.choice([None, *range(6)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize("piece", [1, 2, 1024])
def test_repairs_equal_a_search_over_all_edits(spark, piece):
    rng = random.Random(8)
    all_ = {c: conversation(rng, 7) for c in [None, *range(40)]}
    rows = [(c, t, r, x, "extra") for c, own in all_.items() for t, r, x in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(3)
    lost = spark.createDataFrame([(99,), (3,)], "conv_id long").unionByName(df.select("conv_id"))
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(df, lost, texts=True, piece=piece).collect()}
    assert len(got) == len(all_) + 1
    for c, own in all_.items():
        assert got[c] == plain_repair(own), own
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")


def test_ranks_order_all_audits():
    """Ranks and pointers over pieces whose ends have any costs ahead: the least of all cheapest ways, by a plain recursion."""
    rng = random.Random(3)
    pieces = R.Pieces([np.array([rng.randrange(4) for _ in range(n)], np.int8) for n in (1, 5, 9, 30)], [np.array([rng.choice([0, 0, 1, 3]) for _ in range(n)], np.int8) for n in (1, 5, 9, 30)])
    end = np.array([[rng.randrange(9) for _ in range(4)] for _ in range(4)])
    for piece, q, to, letters, nodes in pieces.least(end):
        n, at = int(pieces.size[piece]), int(pieces.row0[piece])
        best = [(int(end[piece][s]), "", s) for s in range(4)]
        for i in reversed(range(n)):
            new = []
            for s in range(4):
                ways = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
                if not pieces.gone[at + i]:
                    cut, keep, on = int(pieces.cut[at + i]), int(R.KEPT[s][pieces.initial[at + i]]), int(R.NEXT[s])
                    ways.append((best[on][0] + 2 + cut, "R" + best[on][1], best[on][2]))
                    ways += [(best[keep][0] + cut, "K" + best[keep][1], best[keep][2])] if keep >= 0 else []
                new.append(min(ways))
            for s in (2, 3, 0, 1, 2, 3):
                b = new[R.NEXT[s]]
                new[s] = min(new[s], (b[0] + 2, "I" + b[1], b[2]))
            best = new
        assert (bytes(R.LETTERS[x] for x in letters).decode(), to) == best[q][1:]


def test_a_very_long_conversation(spark):
    """20,000 rows of one conversation beside short ones: many pieces, spread by Spark; the cost is what the rows' faults make it."""
    n = 20_000
    from pyspark.sql import functions as F

    rows = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Say "), "id", F.lit(".")).alias("text"))
    short = spark.createDataFrame([(2, 0, "user", "Hi."), (3, 0, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in R.repair(rows.where("turn % 1000 <> 999").unionByName(short)).collect()}
    assert (got[1].gaps, got[1].illegal, got[1].cost) == (19, 19, 40)
    assert len(got[1].audit) >= n - 20 and (got[2].cost, got[2].audit) == (2, "KI") and got[3].audit == "IK"


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert R.repair(empty).count() == 0
    one = spark.createDataFrame([("a",)], "conv_id string")
    assert R.repair(empty, one).select("audit", "cost").collect()[0] == ("", 0)


def test_damage_follows_the_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b!") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(str, R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        row = (c, t, "user" if k == 4 else r, "" if k == 1 else x.replace(".", "").replace("!", "") if k == 2 else x)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(f"Row(conv_id={c!r}, turn={t!r}, role={r!r}, text={x!r})" for c, t, r, x in want)
