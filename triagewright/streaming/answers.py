"""Answers as they come in: a state for each id that is still open, with a timer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagewright.operators import answers as A
from triagewright.streaming.jobs import start

PART = "attempts int, best_attempt int, best_text string, best_parsed string, last_attempt int, last_text string"
STATE = PART + ", first_seen boolean, second_seen boolean"
EMPTY = (0, None, None, None, None, None, False, False)
#: Whether an id was settled by an answer, by two failed attempts, or by its timer.
SETTLED = "failure_id string, settled_by string, " + PART


def order(attempt: int, text: str | None) -> tuple:
    return attempt, text is not None, text or ""


def fold(state: tuple, rows: pd.DataFrame) -> tuple:
    """A state with further attempts: their number, the least that parses, the last, and which were seen."""
    attempts, best, text, parsed, last, last_text, first, second = state
    for n, said, read in zip(rows.attempt.tolist(), rows.raw_text.tolist(), rows.parsed.tolist()):
        attempts, first, second = attempts + 1, first or n <= 1, second or n == 2
        if read is not None and (best is None or order(n, said) < order(best, text)):
            best, text, parsed = n, said, read
        if last is None or order(n, said) > order(last, last_text):
            last, last_text = n, said
    return attempts, best, text, parsed, last, last_text, first, second


def settled_by(state: tuple) -> str | None:
    """An answer that no earlier attempt can beat, or two failures; null while something may still change."""
    *_, first, second = state
    if state[1] is not None:
        return "answer" if first else None
    return "failures" if first and second else None


def settle_answers(answers: DataFrame, delay_ms: int) -> DataFrame:
    """A stream of (failure_id, attempt, raw_text) as a stream of SETTLED rows: one as soon as an id's first answer that parses is certain or both attempts
    have failed, else what there is when the delay is over. Ids that are settled leave no state; what comes for them later makes a further row.

    The rows of an id are parts of one aggregate (see settled_answers()), so restarts, repeats of the order and late attempts change nothing in the end.
    No row is dropped as late. An id's attempts are folded as they are read, in memory of two texts. Null ids count as empty ones.
    """
    read = A.judged(answers)
    rows = read.select(F.coalesce("failure_id", F.lit("")).alias("failure_id"), F.col("attempt").cast("int").alias("attempt"), "raw_text", F.when(F.col("r.ok"), F.to_json("r")).alias("parsed"))

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else EMPTY
        if state.hasTimedOut:
            how = "delay"
        else:
            for frame in frames:
                now = fold(now, frame.astype(object).where(frame.notna(), None))
            how = settled_by(now)
        if how is None:
            state.update(now)
            state.setTimeoutDuration(delay_ms)
            return
        if state.exists:
            state.remove()
        one = pd.DataFrame([(key[0], how, *now[:6])], columns=["failure_id", "settled_by", "attempts", "best_attempt", "best_text", "best_parsed", "last_attempt", "last_text"])
        yield one.astype({"attempts": "Int32", "best_attempt": "Int32", "last_attempt": "Int32"})

    return rows.groupBy("failure_id").applyInPandasWithState(run, SETTLED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_answers(answers: DataFrame, path: str, checkpoint: str, delay_ms: int = 600_000, once: bool = True) -> StreamingQuery:
    """Settled answers, written under each batch's number, so that a batch that runs again replaces what it wrote.

    Timers fire as batches run: all the time in a stream that goes on, and with once at the next start that finds a new file. (Batches without data are
    left out then, as timers by the clock would ask for one after another without end.)
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = answers.sparkSession.conf
    before = conf.get(NO_DATA)
    try:  # a stream takes the settings over as it starts
        conf.set(NO_DATA, "false" if once else before)
        return start(settle_answers(answers, delay_ms), batch, checkpoint, once)
    finally:
        conf.set(NO_DATA, before)


def settled_answers(spark: SparkSession, path: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, failures), as A.clean_answers() has them, of what stream_answers() has settled so far."""
    best = F.struct(F.col("best_attempt").alias("attempt"), F.col("best_text").alias("raw_text"), F.from_json("best_parsed", A.READ).alias("r"))
    each = spark.read.schema(SETTLED).parquet(path).groupBy("failure_id").agg(
        F.min(F.when(F.col("best_attempt").isNotNull(), best)).alias("best"),
        F.max(F.struct(F.col("last_attempt").alias("attempt"), F.col("last_text").alias("raw_text"))).alias("last"), F.sum("attempts").alias("attempts"),
    )
    return A.finished(each, requests)
