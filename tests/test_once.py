"""What is costly is worked out once: plans hold it as often as it is needed, files are as few as they may be."""

from datetime import date

from test_store import some_events, state
from triagewright import fixtures as X
from triagewright import registry as Q
from triagewright.functions import text as T
from triagewright.operators import grouping as G
from triagewright.operators import history as H
from triagewright.operators import prompts as P
from triagewright.operators import store
from triagewright.sources import reports as R

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_are_worked_out_once_whatever_filters_look_at_them(spark):
    rows = H.usable(H.with_ids(R.to_requests(X.failures(spark, D)))).where("failure_id <> 'x' AND legacy_id <> failure_id")
    assert plan(rows).count("sha2(") == 2


def test_an_append_writes_few_files_a_day(spark, tmp_path):
    at = str(tmp_path / "s")
    store.append(some_events(spark, 1, 400, ids=300), at)
    names = store.log_files(spark, at)
    assert set(names.values()) == {date(2024, 5, n) for n in range(1, 6)} and len(names) <= 5 * store.PARTS
    assert state(store.current(spark, at)) == state(H.feedback_current(some_events(spark, 1, 400, ids=300)))


def test_prompts_strip_each_text_once_a_slot(spark):
    m = H.match_history(Q.requests(spark, D), Q.current(spark, D))
    assert plan(P.build_prompts(H.pending(m))).count("Capabilities") <= 3


def test_answers_are_made_for_the_first_failure_of_an_id_alone(spark):
    assert "Aggregate [failure_id" in plan(Q.answer_rows(spark, D)).split("Join Inner", 1)[1]  # before: under no join


def test_repeats_and_groups_read_their_ids_and_keys_back(spark):
    assert "sha2(" not in plan(Q.resolve_repeats(spark, D))
    assert "regexp_" not in plan(G.group_failures(Q.parts(spark, D)))


def test_white_space_and_exceptions_as_before(spark):
    texts = [None, "", " ", "a  b", "\ta\n b\x0b ", "a b", "x  y", "\x00\x1fa\x01 ", "a.b.CException: x", "Exception", "xExceptions Error2 e.Error", "ERROR Exceptional", "$.Error a.Exception"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    t = F.col("t")
    old_trim = lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    found = F.regexp_extract(t, T.EXCEPTION, 1)
    old = (old_trim(F.regexp_replace(t, r"\s+", " ")), old_trim(t), F.when(found != "", F.regexp_extract(found, r"([^.]*)$", 1)))
    for a, b in zip(old, (T.collapse(t), T.trim(t), T.simple_exception(t))):
        assert [r[0] for r in df.select(a).collect()] == [r[0] for r in df.select(b).collect()]
