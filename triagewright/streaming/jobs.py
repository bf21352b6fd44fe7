"""Structured Streaming over the same functions. The feedback log holds all truth; stream state only saves work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagewright.operators import history as H
from triagewright.operators import prompts as P
from triagewright.operators import repeats as E
from triagewright.operators import store


def start(stream: DataFrame, batch, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_triage(requests: DataFrame, store_path: str, matched_path: str, prompts_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Requests as they come: each batch is matched against the store (operators/store.py) as it is then; matches and open prompts are written under the
    batch's number, so that a batch that runs again replaces what it wrote. Of an id and picture one request is asked, whichever batches hold more.

    Of the store and of earlier prompts only the buckets are read that the batch's ids fall into.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        asked = H.with_ids(rows)
        ids = asked.select("failure_id").union(asked.select(F.col("legacy_id").alias("failure_id"))).distinct()
        H.match_history(asked, store.current(spark, store_path, ids)).write.mode("overwrite").parquet(f"{matched_path}/batch={number}")
        again = spark.read.parquet(f"{matched_path}/batch={number}")
        open_ = first_asked(H.pending(again)).withColumn("bucket", store.bucket_of(F.col("failure_id")))
        if store.exists(spark, prompts_path):
            wanted = [r.bucket for r in open_.select("bucket").distinct().collect()]  # store.BUCKETS at most
            known = spark.read.schema("failure_id string, screenshot_hash string, batch long, bucket int").parquet(prompts_path).where((F.col("batch") < number) & F.col("bucket").isin(wanted))
            open_ = open_.withColumn("_key", F.struct("failure_id", "picture")).join(known.select(F.struct("failure_id", F.lower("screenshot_hash").alias("picture")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")
        prompts = P.build_prompts(open_).withColumn("bucket", store.bucket_of(F.col("failure_id")))
        prompts.write.mode("overwrite").partitionBy("bucket").parquet(f"{prompts_path}/batch={number}")

    return start(requests, batch, checkpoint, once)


def first_asked(open_requests: DataFrame) -> DataFrame:
    """The first request of each id and picture: by event_time, seq and failure_idx, as far as they are there."""
    rest = [c for c in open_requests.columns if c != "failure_id"]
    order = [c for c in ("event_time", "seq", "failure_idx", "test_name", "error") if c in rest]
    keyed = open_requests.withColumn("picture", E.picture(F.col("failure_image")))
    return keyed.groupBy("failure_id", "picture").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("failure_id", "picture", "r.*")


def stream_dedupe(pending: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of each id within the delay; needs failure_id and event_time."""
    return pending.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["failure_id"])


def stream_corrections(corrections: DataFrame, store_path: str, rejects_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Corrections as they come, appended to the store's log. Order is by event time in feedback_current(), so late ones converge, and an event
    appended twice changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        events, rejects = H.split_corrections(rows)
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        store.append(events, store_path)

    return start(corrections, batch, checkpoint, once)
