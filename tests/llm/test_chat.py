import hashlib
import random

from pyspark.sql import functions as F

from triagewright.llm import chat as C

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def messages(spark, events):
    got = C.fold(spark.createDataFrame(events, EVENTS)).collect()
    return sorted((r.conv_id or 0, r.turn, r.role, r.text) for r in got)


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", "user", "lo"), (1, 3, 1, "delta", "assistant", "wrong"), (1, 4, 2, "delta", "user", "no"),
        (1, 5, 1, "regenerate", "assistant", "ri"), (1, 6, 1, "delta", "assistant", "ght"), (1, 7, 0, "edit", "user", "Hi"), (1, 8, 0, "delta", "user", "!"),
        (1, 9, 2, "delta", "user", None), (2, 1, 0, "edit", "user", ""), (None, 1, 0, "delta", None, "x"),
    ]
    random.Random(1).shuffle(events)
    assert messages(spark, events) == [(0, 0, "", "x"), (1, 0, "user", "Hi!"), (1, 1, "assistant", "right"), (1, 2, "user", ""), (2, 0, "user", "")]
    assert messages(spark, []) == []


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    parts = ["<|end|>\n", "<|", "|>\n", "\\", "<\\", "[INST]", "</s>", "|", "a", "\n", "é", "<", "[", "\\\\<"]
    rows = [(c, t, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) if c % 3 == 0 else rng.choice(["user", "assistant"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for c in range(150) for t in range(rng.randint(1, 5))]
    out = C.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("conv_id", C.unrender(F.col("formatted")).alias("m"), C.masked(F.col("formatted"), F.col("loss")).alias("l"), "formatted").collect()}
    for c in range(150):
        own = [(r, t) for i, _, r, t in rows if i == c]
        assert [(m.role, m.text) for m in got[c].m] == own
        assert got[c].l == [t for r, t in own if r == "assistant"]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    say = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", say), (-7, 1, "assistant", say)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in C.op2_chat_format(spark, d).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x[1:] for x in rows if x[0] == c)
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
