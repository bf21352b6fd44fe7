"""Repair of conversations' structure: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, of equally cheap ones the least audit.

Each row's first fault counts: blank (no character but ASCII white space), duplicate (role and text as in an earlier row), truncated (no full stop, `!`
or `?` at its end). Edits, by their initials: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant text) 2;
blank and duplicate rows have to go, truncated ones that stay cost 1. Rows are taken by turn (null first), role and text.

The places between a conversation's rows and the four states of its roles are nodes; costs to go come from the end backwards. Of the arcs that lie on
cheapest ways, prefix doubling ranks the nodes by the least audit of 1, 2, 4, ... letters from there on, and doubles the pointers to where
those letters lead; ranks choose each node's arc, doubled pointers spell the path. A node's arcs have different initials, so its least letters lead to one node.

A conversation may be of any length: sorted rows are cut into pieces of PIECE rows at most, wherever Spark's range partitions put them. A piece tells
for each state at its start and end what it costs; those 4 x 4 tables pass in order over each conversation, and give every piece the costs to go at its end.
Then pieces are solved apart, for each state they may start in, and a last pass in order picks, joins and hashes. A task holds a few pieces at a
time; only the audit (a letter an edit) is kept whole, and the repaired text where asked for.

Null roles, texts count as one space; null conversations are one. All conversations of `conversations` come back, without rows or not. Equal rows of
one turn stay apart: all but the first are duplicates. No rows give no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright.llm import common

PIECE = 1024
#: Pieces worked on at once.
TOGETHER = 64
FAR = 1 << 40
LETTERS = b"DIKR"  # in ASCII order
START, SYSTEM, USER, ASSISTANT = range(4)
#: What costs to go, and which edits, once no rows are left: s alone wants both, u wants its answer.
AT_END = np.array([0, 4, 2, 0])
TAIL = ("", "II", "I", "")
#: The state that a user or assistant text leads to from each state, and whose text it is.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Of [state, initial (s, u, a, other)]: the state after a kept row, or -1.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
LEGAL = np.zeros((4, 4), bool)
LEGAL[0, 1] = LEGAL[1, 2] = LEGAL[2, 1] = True
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def has_text(c: Column) -> Column:
    return c.rlike(r"[^\x20\x09-\x0D]")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, first, rest, times): equal rows of a turn as one; the fault of the first and of the others."""
    texts = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    runs = texts.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    # a struct compares nulls as equal, and puts a null turn first
    keyed = runs.select(F.struct("conv_id", "role", "text").alias("said"), F.struct("turn").alias("turn"), "times")
    earliest = keyed.groupBy("said").agg(F.min("turn").alias("earliest"))
    both = keyed.join(earliest, "said").select("said.*", "turn.turn", "times", (F.col("turn") == F.col("earliest")).alias("new"))
    blank = ~has_text(F.col("text"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.when(blank, BLANK).when(~F.col("new"), DUPLICATE).when(cut, TRUNCATED).otherwise(0)
    return both.select("conv_id", "turn", "role", "text", first.alias("first"), F.when(blank, BLANK).otherwise(DUPLICATE).alias("rest"), "times")


def initials(roles: Iterable[str]) -> np.ndarray:
    return np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r in roles], np.int8)


class Pieces:
    """Several pieces' rows, one after the other: initials, whether each must go, whether it is cut short."""

    def __init__(self, initial: list[np.ndarray], fault: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in initial])
        self.order = np.argsort(-self.size, kind="stable")
        self.initial = np.concatenate(initial).astype(np.int64)
        fault = np.concatenate(fault)
        self.gone, self.cut = (fault == BLANK) | (fault == DUPLICATE), (fault == TRUNCATED).astype(np.int64)
        self.row0 = np.cumsum(self.size) - self.size
        self.place0 = self.row0 + np.arange(len(self.size))  # a piece of n rows has n + 1 places
        self.places = int(self.size.sum()) + len(self.size)

    def before(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs to go before rows, from those after them: [row, state, ...]."""
        wide = lambda x: x.reshape(-1, *[1] * (after.ndim - 2))
        gone, cut, initial = wide(self.gone[row]), wide(self.cut[row]), self.initial[row]
        cost = after + 3
        for q in range(4):
            stay = np.where(gone, FAR, after[:, NEXT[q]] + 2 + cut)
            to = KEPT[q][initial]
            kept = np.where(gone | wide(to < 0), FAR, after[np.arange(len(row)), to] + cut)
            cost[:, q] = np.minimum(cost[:, q], np.minimum(stay, kept))
        user = np.minimum(cost[:, USER], cost[:, ASSISTANT] + 2)
        cost[:, ASSISTANT] = np.minimum(cost[:, ASSISTANT], cost[:, USER] + 2)
        cost[:, USER] = user
        for q in (START, SYSTEM):
            cost[:, q] = np.minimum(cost[:, q], user + 2)
        return np.minimum(cost, FAR)

    def backwards(self, end: np.ndarray, keep: bool) -> np.ndarray:
        """From costs at the pieces' ends [piece, state, ...] to those at their starts, or (keep) at all places [place, state]."""
        now = end.copy()
        every = np.zeros((self.places, *end.shape[1:]), np.int64) if keep else None
        if keep:
            every[self.place0 + self.size] = end
        for back in range(1, int(self.size.max(initial=0)) + 1):
            active = self.order[: np.count_nonzero(self.size >= back)]
            at = self.size[active] - back
            now[active] = self.before(self.row0[active] + at, now[active])
            if keep:
                every[self.place0[active] + at] = now[active]
        return every if keep else now

    def tables(self) -> np.ndarray:
        """[piece, state at the start, state at the end]"""
        each = np.where(np.eye(4, dtype=bool), 0, FAR)
        return self.backwards(np.repeat(each[None], len(self.size), 0), False)

    def least(self, end: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """For each piece and state at its start, given costs to go at its end: (piece, state, state at the end, letters of the least cheapest audit, their nodes)."""
        togo = self.backwards(end, True)
        place = np.arange(self.places)
        row = np.full(self.places, -1)
        inner = np.ones(self.places, bool)
        inner[self.place0 + self.size] = False
        row[inner] = np.arange(len(self.initial))
        letters = np.full((4, self.places, 4), -1)  # where each optimal arc leads, by letter
        own, after = togo[inner], togo[place[inner] + 1]
        gone, cut, initial = self.gone[row[inner]], self.cut[row[inner]], self.initial[row[inner]]
        base, here = (place[inner] + 1) * 4, place[inner] * 4
        for q in range(4):
            on = NEXT[q]
            to = KEPT[q][initial]
            for letter, good, node in (
                (0, own[:, q] == after[:, q] + 3, base + q),
                (1, own[:, q] == own[:, on] + 2, here + on),
                (2, ~gone & (to >= 0) & (own[:, q] == after[np.arange(len(to)), to] + cut), base + to),
                (3, ~gone & (own[:, q] == after[:, on] + 2 + cut), base + on),
            ):
                letters[letter, inner, q] = np.where(good & (own[:, q] < FAR), node, -1)
        arcs = letters.reshape(4, -1)
        chosen, pointers, steps = ranked(arcs)
        for piece in range(len(self.size)):
            for q in range(4):
                start = self.place0[piece] * 4 + q
                nodes = walked(start, pointers, int(steps[start]))
                yield piece, q, int(nodes[-1]) % 4, chosen[nodes[:-1]], nodes[:-1]


def ranked(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """arcs[letter, node]: where the letter's arc leads, or -1. (letter of each node's arc on its least way, pointers over 1, 2, 4, ... letters, letters to its end)."""
    nodes = np.arange(arcs.shape[1])
    there = arcs >= 0
    open_ = there.any(axis=0)
    letter = np.argmax(there, axis=0)  # the least of one letter
    rank = np.where(open_, letter + 1, 0)
    jump = np.where(open_, arcs[letter, nodes], nodes)
    while True:  # ranks of twice as many letters: those of the first half, then of the half that begins where the first one ends
        _, doubled = np.unique(rank * (len(nodes) + 1) + rank[jump], return_inverse=True)
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        rank, jump = doubled, further
    # of a node's arcs the least letter, of equal ones the least rank behind it
    key = np.where(there, np.arange(len(arcs))[:, None] * (len(nodes) + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    letter = np.argmin(key, axis=0)
    pointers = [np.where(open_, arcs[letter, nodes], nodes)]
    steps = open_.astype(np.int64)
    while not np.array_equal(further := pointers[-1][pointers[-1]], pointers[-1]):
        steps = steps + steps[pointers[-1]]
        pointers.append(further)
    return letter, pointers, steps


def walked(start: int, pointers: list[np.ndarray], steps: int) -> np.ndarray:
    """The nodes after 0, 1, 2, ... letters, each by the doubled pointers of its binary digits."""
    t = np.arange(steps + 1)
    node = np.full(steps + 1, start)
    for k, jump in enumerate(pointers):
        on = (t >> k) & 1 > 0
        node[on] = jump[node[on]]
    return node


CUT = "conv_id {0}, piece long, initial binary, fault binary, roles array<string>, texts array<string>, costs array<long>"


def cut_pieces(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of faults() to pieces of conversations."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    waiting: list[tuple] = []

    def send() -> pa.RecordBatch:
        initial, fault = [initials(w[1]) for w in waiting], [np.array(w[3], np.int8) for w in waiting]
        tables = Pieces(initial, fault).tables().reshape(len(waiting), 16)
        columns = [[w[0] for w in waiting], [w[4] for w in waiting], [x.tobytes() for x in initial], [x.tobytes() for x in fault], [w[1] for w in waiting], [w[2] for w in waiting], tables.tolist()]
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    now = None  # (conversation, roles, texts, faults, number)
    for batch in batches:
        for conv, role, text, first, rest, times in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "first", "rest", "times")]):
            for i in range(times):
                if now is None or now[0] != conv or len(now[1]) >= most:
                    if now is not None:
                        waiting.append(now)
                        if len(waiting) >= TOGETHER:
                            yield send()
                    now, number = (conv, [], [], [], number), number + 1
                now[1].append(role)
                now[2].append(text)
                now[3].append(rest if i else first)
    if now is not None:
        waiting.append(now)
        yield send()


def pass_costs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, costs), the last piece of each conversation first, to (piece, ahead): costs to go at the end of each piece."""
    conv, ahead = object(), None
    for batch in batches:
        out = []
        for own, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own != conv:
                conv, ahead = own, AT_END
            out.append(ahead.tolist())
            ahead = np.minimum((np.array(costs).reshape(4, 4) + ahead).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["piece", "ahead"])


SOLVED = "conv_id {0}, piece long, cost long, counts array<long>, initials array<int>, ends array<int>, audits array<string>, said array<string>"


def solve(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces with the costs ahead to what they become from each state at their start."""
    for whole in batches:
        for lo in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(lo, TOGETHER)
            initial, fault = ([np.frombuffer(x, np.int8) for x in batch.column(c).to_pylist()] for c in ("initial", "fault"))
            pieces, ahead = Pieces(initial, fault), np.array(batch.column("ahead").to_pylist(), np.int64).reshape(-1, 4)
            roles, texts = batch.column("roles").to_pylist(), batch.column("texts").to_pylist()
            ends, audits, said = ([[None] * 4 for _ in initial] for _ in range(3))
            for piece, q, end, letters, nodes in pieces.least(ahead):
                ends[piece][q] = end
                audits[piece][q] = bytes(LETTERS[x] for x in letters).decode()
                lines, names = [], ("user", "assistant")
                for letter, node in zip(letters, nodes):
                    row, to = int(node) // 4 - int(pieces.place0[piece]), names[int(NEXT[node % 4] == ASSISTANT)]
                    if letter == 1:
                        lines.append(f"{to}:")
                    elif letter:
                        lines.append(f"{roles[piece][row] if letter == 2 else to}:{texts[piece][row]}")
                said[piece][q] = "\n".join(lines) if lines else None
            cost = pieces.backwards(ahead, False)[:, START]
            counts = [[int((f == kind).sum()) for kind in (BLANK, DUPLICATE, TRUNCATED)] + [int((~LEGAL[x[:-1], x[1:]]).sum())] for x, f in zip(initial, fault)]
            columns = [batch.column("conv_id"), batch.column("piece"), cost, counts, [[int(x[0]), int(x[-1])] for x in initial], ends, audits, said]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def join_pieces(batches: Iterable[pa.RecordBatch], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    """Solved pieces in order to one row a conversation."""

    class Whole:
        def __init__(self, conv, cost: int) -> None:
            self.conv, self.cost, self.counts, self.state, self.last, self.audit = conv, cost, np.zeros(4, np.int64), START, None, []
            self.hash, self.empty, self.said = hashlib.sha256(), True, []

        def say(self, text: str | None) -> None:
            if text is not None:
                self.hash.update((text if self.empty else "\n" + text).encode())
                self.empty = False
                if texts:
                    self.said.append(text)

        def add(self, counts: list, ends: list, initial: list, audits: list, said: list) -> None:
            self.counts += counts
            self.counts[3] += self.last is not None and not LEGAL[self.last, initial[0]]
            self.audit.append(audits[self.state])
            self.say(said[self.state])
            self.state, self.last = ends[self.state], initial[1]

        def row(self) -> tuple:
            self.audit.append(TAIL[self.state])
            self.say({SYSTEM: "user:\nassistant:", USER: "assistant:"}.get(self.state))
            return self.conv, *self.counts.tolist(), self.cost, "".join(self.audit), self.hash.hexdigest(), "\n".join(self.said) if texts else None

    now, done = None, []
    for batch in batches:
        for conv, cost, counts, initial, ends, audits, said in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "cost", "counts", "initials", "ends", "audits", "said")]):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = Whole(conv, cost)
            now.add(counts, ends, initial, audits, said)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[now.row()]), schema)], schema=schema)


def repair(rows: DataFrame, conversations: DataFrame | None = None, texts: bool = False, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), with `texts` also repaired: `role:text` lines.

    rows: conv_id, turn, role, text. conversations: their conv_id, if not those of rows.
    """
    common.small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = common.StructType.fromDDL
    arrow = lambda text: common.to_arrow_schema(ddl(text.format(kind)))
    order = ["conv_id", "turn", "role", "text"]
    judged = common.written(faults(rows), "judged")
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = arrow(CUT)
    pieces = common.written(ranged.mapInArrow(lambda b: cut_pieces(b, cut, piece), CUT.format(kind)), "pieces")
    back = pieces.select("conv_id", "piece", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    ahead = back.mapInArrow(pass_costs, "piece long, ahead array<long>")
    solved = arrow(SOLVED)
    each = pieces.drop("costs").join(ahead, "piece").mapInArrow(lambda b: solve(b, solved), SOLVED.format(kind))
    whole = "conv_id {0}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
    final = arrow(whole)
    found = each.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(lambda b: join_pieces(b, final, texts), whole.format(kind))
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    known = (conversations if conversations is not None else rows).select("conv_id").distinct()
    key = lambda df: df.withColumn("_key", F.struct("conv_id"))
    out = key(known).join(key(turns).drop("conv_id"), "_key", "left").join(key(found).drop("conv_id"), "_key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"), *([F.coalesce("repaired", F.lit("")).alias("repaired")] if texts else []))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without full stops, repeated or given to the user, by a hash of conversation and turn. Nulls are one space there, and in the texts."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    full = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return full.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("i")).drop("i")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)


#: The same by a recursion over rows, from the last to the first: for each state the cheapest, then least, way to the end.
OP11_SQL = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM h),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS previous FROM o),
w AS (
  SELECT conv_id, n AS i, {'c': CAST(0 AS BIGINT), 'a': '', 's': CAST([] AS VARCHAR[])} AS p0, {'c': CAST(4 AS BIGINT), 'a': 'II', 's': ['user:', 'assistant:']} AS p1,
    {'c': CAST(2 AS BIGINT), 'a': 'I', 's': ['assistant:']} AS p2, {'c': CAST(0 AS BIGINT), 'a': '', 's': CAST([] AS VARCHAR[])} AS p3 FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'c': n2.c + 2, 'a': 'I' || n2.a, 's': ['user:'] || n2.s}]), list_min([b1, {'c': n2.c + 2, 'a': 'I' || n2.a, 's': ['user:'] || n2.s}]), n2, n3 FROM (
    SELECT conv_id, i, b0, b1, list_min([b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 's': ['assistant:'] || b3.s}]) AS n2, list_min([b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 's': ['user:'] || b2.s}]) AS n3 FROM (
      SELECT conv_id, i, list_min([d0, ks, ku, ru]) AS b0, list_min([d1, ku, ru]) AS b1, list_min([d2, ka, ra]) AS b2, list_min([d3, ku, ru]) AS b3 FROM (
        SELECT w.conv_id, w.i - 1 AS i, {'c': p0.c + 3, 'a': 'D' || p0.a, 's': p0.s} AS d0, {'c': p1.c + 3, 'a': 'D' || p1.a, 's': p1.s} AS d1, {'c': p2.c + 3, 'a': 'D' || p2.a, 's': p2.s} AS d2, {'c': p3.c + 3, 'a': 'D' || p3.a, 's': p3.s} AS d3,
          CASE WHEN fault IN (0, 3) AND initial = 's' THEN {'c': p1.c + fault // 3, 'a': 'K' || p1.a, 's': [role || ':' || text] || p1.s} END AS ks,
          CASE WHEN fault IN (0, 3) AND initial = 'u' THEN {'c': p2.c + fault // 3, 'a': 'K' || p2.a, 's': [role || ':' || text] || p2.s} END AS ku,
          CASE WHEN fault IN (0, 3) AND initial = 'a' THEN {'c': p3.c + fault // 3, 'a': 'K' || p3.a, 's': [role || ':' || text] || p3.s} END AS ka,
          CASE WHEN fault IN (0, 3) THEN {'c': p2.c + 2 + fault // 3, 'a': 'R' || p2.a, 's': ['user:' || text] || p2.s} END AS ru,
          CASE WHEN fault IN (0, 3) THEN {'c': p3.c + 2 + fault // 3, 'a': 'R' || p3.a, 's': ['assistant:' || text] || p3.s} END AS ra
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i)))),
s AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.p0.c, 0) AS cost, coalesce(w.p0.a, '') AS audit, sha256(coalesce(array_to_string(w.p0.s, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0
"""
