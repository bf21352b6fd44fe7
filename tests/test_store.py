"""The feedback store: closed days aren't read, late events count, a crash between two writes loses nothing."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_history import FULL, request
from triagewright import schemas as S
from triagewright.operators import history as H
from triagewright.operators import store
from triagewright.streaming import jobs as ST

DAY = datetime(2024, 5, 1, 12)


def some_events(spark, seed, n, ids=12):
    """Events of five days, in any order: results, corrections and copies."""
    rng = random.Random(seed)
    schema, rows = spark.createDataFrame([], S.FEEDBACK_LOG).schema, []
    for i in range(n):
        kind = rng.choice(["AI", "AI", "HUMAN", "ALIAS"])
        when = DAY + timedelta(days=rng.randrange(5), seconds=rng.randrange(1000))
        more = {} if kind == "HUMAN" else {**FULL, "root_cause": f"cause {i}"}
        row = {"failure_id": f"id{rng.randrange(ids)}", "kind": kind, "event_time": when, "seq": seed * 10_000 + i, "created_at": when - timedelta(days=9) if kind == "ALIAS" else when, **more}
        row["human_classification"] = None if kind == "AI" else rng.choice(["DATA_ISSUE", "API_ISSUE"])
        rows.append([row.get(f.name) for f in schema])
    return spark.createDataFrame(rows, schema)


def state(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_state_is_that_of_all_events_however_they_are_compacted(spark, tmp_path, seed):
    rng, at, all_ = random.Random(seed), str(tmp_path / "s"), None
    for step in range(4):
        more = some_events(spark, seed * 10 + step, 40)
        all_ = more if all_ is None else all_.unionByName(more)
        store.append(more, at)
        if rng.random() < 0.8:
            store.compact(spark, at, date(2024, 5, 1) + timedelta(days=rng.randrange(7)))
        assert state(store.current(spark, at)) == state(H.feedback_current(all_))
    some = spark.createDataFrame([("id1",), ("id3",), ("none",)], "failure_id string")
    assert state(store.current(spark, at, some)) == state(H.feedback_current(all_.where("failure_id IN ('id1', 'id3')")))


def test_closed_days_are_not_read_and_ids_meet_their_bucket_alone(spark, tmp_path):
    at = str(tmp_path / "s")
    store.append(some_events(spark, 1, 300, ids=200), at)
    store.compact(spark, at, date(2024, 5, 4))
    read = store.events(spark, at).inputFiles()
    days = {f.split("day=")[1][:10] for f in read if "/log/" in f}
    assert days == {"2024-05-04", "2024-05-05"} and any("version=1" in f for f in read)
    one = spark.createDataFrame([("id7",)], "failure_id string")
    want = one.select(store.bucket_of(F.col("failure_id"))).first()[0]
    plan = store.events(spark, at, one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan and {f for f in store.events(spark, at, one).where(f"failure_id = 'id7'").inputFiles()} and want < store.BUCKETS


def test_a_table_without_commit_does_not_count(spark, tmp_path, monkeypatch):
    at, rows = str(tmp_path / "s"), some_events(spark, 2, 60)
    store.append(rows, at)
    want = state(H.feedback_current(rows))
    store.compact(spark, at, date(2024, 5, 3))
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")) if a[1:] == ("file string, day date",) else type(spark).createDataFrame(spark, *a, **b))
    with pytest.raises(RuntimeError):
        store.compact(spark, at, date(2024, 5, 5))
    monkeypatch.undo()
    assert store.version(spark, at) == 1 and store.exists(spark, f"{at}/table/version=2")
    assert state(store.current(spark, at)) == want
    assert store.compact(spark, at, date(2024, 5, 5)) == 2 and state(store.current(spark, at)) == want
    names = set(store.log_files(spark, at))
    assert not any(n.startswith(("day=2024-05-01", "day=2024-05-02")) for n in names)  # named by the commit before the last
    store.append(rows, at)  # the same events again
    assert state(store.current(spark, at)) == want


def test_empty_store(spark, tmp_path):
    at = str(tmp_path / "s")
    assert store.current(spark, at).count() == 0 and store.version(spark, at) == 0
    assert store.compact(spark, at, date(2024, 5, 5)) == 1 and store.current(spark, at).count() == 0


def test_two_batches_with_an_id_ask_once(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    image = "data:image/png;base64,A"
    for n, picture in enumerate(("", "", image, "")):
        request(spark, image=picture).drop("failure_id", "legacy_id").coalesce(1).write.mode("append").parquet(p("in"))
    store.append(some_events(spark, 3, 5), p("store"))
    r = request(spark).drop("failure_id", "legacy_id")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(p("in"))
    ST.stream_triage(stream, p("store"), p("matched"), p("prompts"), p("state")).awaitTermination()
    assert spark.read.parquet(p("matched")).count() == 4
    assert sorted(r.screenshot_hash is None for r in spark.read.parquet(p("prompts")).collect()) == [False, True]
