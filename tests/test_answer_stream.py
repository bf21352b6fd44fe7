import json

import pytest

from triagewright import schemas as S
from triagewright.operators import answers as A
from triagewright.streaming import answers as SA

GOOD = json.dumps({"classification": "API_ISSUE", "severity": "HIGH", "evidence": ["a"]})
LATE = json.dumps({"classification": "DATA_ISSUE", "severity": "LOW"})
#: Waves of (id, attempt, text); the stream is started anew for each.
WAVES = [
    [("a", 1, GOOD), ("b", 1, "no"), ("c", 1, "no"), ("d", 2, LATE), ("e", 2, LATE), ("f", 1, None), ("g", 1, ""), ("h", 3, GOOD), (None, 1, GOOD), ("i", 2, "bad"), ("k", 1, GOOD[:47])],
    [("b", 2, LATE), ("c", 2, "{no"), ("d", 1, GOOD), ("e", 1, "no"), ("i", 1, GOOD), ("a", 2, LATE)],
    [("f", 2, LATE), ("a", 1, GOOD), ("j", 1, "x" * 10_000)],
    [],
]


def run(spark, at, delay):
    rows = []
    for n, wave in enumerate(WAVES):
        spark.createDataFrame(wave, "failure_id string, attempt int, raw_text string").repartition(2).write.parquet(f"{at}/in/wave{n}")
        stream = spark.readStream.schema("failure_id string, attempt int, raw_text string").option("recursiveFileLookup", "true").parquet(f"{at}/in")
        SA.stream_answers(stream, f"{at}/out", f"{at}/state", delay).awaitTermination()
        rows.append({(r.failure_id, r.settled_by) for r in spark.read.schema(SA.SETTLED).parquet(f"{at}/out").collect()})
    return rows


def asked(spark):
    return spark.createDataFrame([(i, "e", "tap", "") for i in "abcdefghijk"], "failure_id string, error string, failed_step string, failure_image string")


def as_rows(pair):
    return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in pair]


@pytest.mark.parametrize("delay", [1, 50])
def test_settled_answers_are_the_batch_ones(spark, tmp_path, delay):
    """Whenever the timers fire: late second attempts, first attempts after the second, repeats."""
    run(spark, tmp_path, delay)
    every = [(i or "", n, raw, "m", False, 10, 5, 5) for wave in WAVES for i, n, raw in wave]
    want = A.clean_answers(spark.createDataFrame(every, S.ANSWERS), asked(spark))
    assert as_rows(SA.settled_answers(spark, f"{tmp_path}/out", asked(spark))) == as_rows(want)


def test_open_ids_wait(spark, tmp_path):
    """With a long delay, an id is settled when nothing can change it, and not before."""
    one, two, three, _ = run(spark, tmp_path, 3_600_000)
    assert one == {("a", "answer"), ("", "answer"), ("k", "answer")}
    assert two - one == {("b", "answer"), ("c", "failures"), ("d", "answer"), ("e", "answer"), ("i", "answer")}
    assert three - two == {("f", "answer")}


def test_order_within_an_id_counts_for_nothing():
    import itertools

    import pandas as pd

    rows = [(1, "b", None), (2, "x", "{}"), (2, "a", "{}"), (1, None, None), (2, "z", None)]
    ends = {SA.fold(SA.EMPTY, pd.DataFrame(list(p), columns=["attempt", "raw_text", "parsed"]).astype(object)) for p in itertools.permutations(rows)}
    assert ends == {(5, 2, "a", "{}", 2, "z", True, True)} and SA.settled_by(next(iter(ends))) == "answer"


def test_no_answers(spark, tmp_path):
    spark.createDataFrame([], "failure_id string, attempt int, raw_text string").write.parquet(f"{tmp_path}/in")
    SA.stream_answers(spark.readStream.schema("failure_id string, attempt int, raw_text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([], SA.SETTLED).write.mode("append").parquet(f"{tmp_path}/out/batch=-1")
    assert [df.count() for df in SA.settled_answers(spark, f"{tmp_path}/out", asked(spark))] == [0, 0]
