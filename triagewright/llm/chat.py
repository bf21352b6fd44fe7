"""Chat formatting from an event log.

Events (conv_id, seq, turn, kind, role, text) are folded into messages: `delta` appends its text to the message of its
turn, `edit` replaces what that turn says so far, and `regenerate` throws away that turn's text and every later turn
that began before it, then starts anew with its own text. Messages are rendered one after the other:

    <|role|>\\ntext<|end|>\\n

A control string inside a text or a role is escaped by a backslash after each `<`, `[` and `|`, and backslashes are doubled, so unrender() gives back exactly what went in. The loss mask covers the texts of assistant messages, nothing between.

Null texts and roles count as empty. Events with the same (conv_id, turn, seq) are taken in the order of kind, role and text; the
role of a message is that of its first event that stays. Events without conv_id form one conversation with a null id. A
message edited to nothing stays, as an empty one. No events give no rows.

The window that finds what was superseded keeps only running minima, so a long log streams (and spills) through it; the
deltas of a message are put together before the messages of a conversation, so that a long conversation arrives as few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagewright.llm import common

START, MID, END = "<|", "|>\n", "<|end|>\n"


def escape(c: Column) -> Column:
    r"""Backslashes doubled; then a backslash after each <, [ or |, one of which is in every control string of the known templates."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in "<[|":
        c = F.replace(c, F.lit(mark), F.lit(mark + "\\"))
    return c


def unescape(c: Column) -> Column:
    r"""escape() undone, left to right: \\ is a backslash, and a backslash right after <, [ or | goes."""
    return F.regexp_replace(c, r"([<\[|])\\|\\(\\)", "$1$2")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that remain, in no order."""
    e = events.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "turn").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    kept = (
        e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(after))
        .withColumn("gone", F.max(F.col("kind") == "edit").over(same))
        .where((F.col("cut").isNull() | (F.col("turn") < F.col("cut"))) & ~F.coalesce("gone", F.lit(False)))
    )
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    return (
        kept.groupBy("conv_id", "turn").agg(parts.alias("parts"))
        .select("conv_id", "turn", F.col("parts")[0]["role"].alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one text a conversation, and its loss mask as spans of code points."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(MID))
    piece = F.struct("turn", "role", F.length(head).alias("head"), F.length(text).alias("body"), F.concat(head, text, F.lit(END)).alias("piece"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["piece"])).alias("at"),
        F.when(p["role"] == "assistant", F.concat(a["loss"], F.array(F.struct((a["at"] + p["head"]).alias("start"), (a["at"] + p["head"] + p["body"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return turns.select("conv_id", F.array_join("p.piece", "").alias("formatted"), F.aggregate("p", zero, step)["loss"].alias("loss"))


def unrender(formatted: Column) -> Column:
    """The messages of a rendered conversation, as array<struct<role, text>>, read from the text alone."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(unescape(F.substring_index(p, MID, 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1, F.length(p))).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations is logged as one delta of its turn; rows of the same turn stay apart, by role and text."""
    say = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.withColumn("n", F.row_number().over(order).cast("long")).select("conv_id", F.col("n").alias("seq"), F.col("n").alias("turn"), F.lit("delta").alias("kind"), "role", "text")
    out = render(fold(events)).withColumn("m", unrender(F.col("formatted"))).withColumn("under", F.array_join(masked(F.col("formatted"), F.col("loss")), ""))
    said = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("m").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) + length(text) - length(replace(text, '|', '')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + length(role) + 13) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
