import pytest
from pyspark.sql import functions as F

from triagewright import registry
from triagewright import schemas as S
from triagewright.operators import clusters as C
from triagewright.operators import history as H
from triagewright.plans import jobs as J
from triagewright.sources import reports as R


def long_reports(spark, n):
    """A report of n failures, each a cluster of its own, and one of two failures alike."""
    text = lambda c: F.lit(c).alias(c)
    rows = spark.range(n).select(F.lit("long").alias("report_id"), F.col("id").alias("failure_idx")).unionByName(spark.range(2).select(F.lit("r").alias("report_id"), F.col("id").alias("failure_idx")))
    error = F.when(F.col("report_id") == "long", F.concat(F.lit("E"), F.col("failure_idx").cast("string"))).otherwise("E")
    return rows.select("*", text("test_case_id"), text("scenario_name"), text("feature_name"), text("failed_step_line"), error.alias("error_message"), text("classification"), text("root_cause"), F.lit("HIGH").alias("severity"), F.lit(1).alias("confidence"), F.lit(True).alias("investigated"))


def test_long_envelopes_come_in_pieces(spark, tmp_path):
    """No row holds a long report; clusters stand in order of their numbers, whatever these have in digits."""
    df, reports = long_reports(spark, 1_203), spark.createDataFrame([("long",), ("r",), ("empty",)], "report_id string")
    C.write_envelopes(C.envelope_pieces(reports, df, C.cluster_failures(df), 500), str(tmp_path / "out"))
    pieces = spark.read.json(str(tmp_path / "out")).orderBy("report_id", "piece").collect()
    assert [(r.report_id, r.piece, len(r.clusters), r.total_failures, r.total_clusters) for r in pieces] == [("empty", 0, 0, 0, 0), ("long", 0, 500, 1_203, 1_203), ("long", 1, 500, 1_203, 1_203), ("long", 2, 203, 1_203, 1_203), ("r", 0, 1, 2, 1)]
    assert [c.cluster_id for r in pieces[1:4] for c in r.clusters] == [f"CLUSTER-{i:03d}" for i in range(1, 1_204)]
    assert all(r.summary.high_severity == r.total_failures for r in pieces)


def test_clusters_of_an_envelope_stand_in_order_of_their_numbers(spark):
    df, reports = long_reports(spark, 1_203), spark.createDataFrame([("long",)], "report_id string")
    assert [c.cluster_id for c in C.report_envelopes(reports, df, C.cluster_failures(df)).first().clusters] == [f"CLUSTER-{i:03d}" for i in range(1, 1_204)]


def test_clusters_are_listed_in_order_of_their_ids_as_texts(spark):
    df, reports = long_reports(spark, 1_203), spark.createDataFrame([("long",), ("r",), ("empty",)], "report_id string")
    got = {r.report_id: r for r in C.listed_clusters(C.envelope_pieces(reports, df, C.cluster_failures(df), 500)).collect()}
    assert got["long"].listed == ",".join(f"{c}=1" for c in sorted(f"CLUSTER-{i:03d}" for i in range(1, 1_204)))
    assert {k: (r.listed, r.total_clusters) for k, r in got.items() if k != "long"} == {"r": ("CLUSTER-001=2", 1), "empty": ("", 0)}


@pytest.mark.parametrize("name", ["report_envelopes", "written_envelopes"])
def test_queries_of_envelopes_make_no_row_of_a_whole_report(spark, name, monkeypatch):
    sizes, pieces = [], C.envelope_pieces
    monkeypatch.setattr(C, "envelope_pieces", lambda *a: sizes.append(a[3] if len(a) > 3 else C.PIECE) or pieces(*a))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sizes == [C.PIECE]


def test_reports_in_pieces_are_triaged_as_whole_ones(spark):
    n = F.col("failure_idx").cast("string")
    texts = {c: F.concat(F.lit(f"{c} "), n) for c in ("test_case_id", "scenario_name", "failed_step_line", "failure_image", "video_url")}
    rows = spark.range(24).select((F.col("id") % 3).cast("string").alias("report_id"), F.col("id").alias("failure_idx")).withColumns(texts).withColumn("error_message", F.concat(F.lit("E & <b> "), F.col("failure_idx") % 5))
    kinds = spark.createDataFrame([("0", "EXTENT"), ("1", "extent"), ("2", "OTHER"), ("empty", "EXTENT")], "report_id string, report_type string")
    empty = H.feedback_current(spark.createDataFrame([], S.FEEDBACK_LOG))
    whole = J.triage_reports(kinds.join(R.render_reports(rows).select("report_id", "html"), "report_id", "left"), empty)
    pieces = J.triage_reports(kinds, empty, pieces=R.render_pieces(rows))
    want = sorted(map(repr, whole["envelopes"].collect()))
    assert sorted(map(repr, pieces["envelopes"].collect())) == sorted(map(repr, pieces["envelope_pieces"].drop("piece").collect())) == want
    assert {r.report_id: r.total_failures for r in whole["envelopes"].collect()} == {"0": 8, "1": 8, "2": 0, "empty": 0}


def test_triage_reports_renders_no_report_whole(spark, monkeypatch):
    """Nor are tables of a row a failure broadcast, which their files' sizes would allow."""
    monkeypatch.setattr(R, "render_reports", None)
    monkeypatch.setattr(R, "explode_reports", None)
    written, members = J.written, []
    monkeypatch.setattr(J, "written", lambda df, name: (members.append(df) if name == "investigated" else None) or written(df, name))
    assert registry.QUERIES["triage_reports"](spark, "/root/testdata/sf0.001").count() > 0
    assert "Broadcast" not in members[0]._jdf.queryExecution().sparkPlan().toString()


def test_a_report_in_pieces_is_read_by_one_task(spark, monkeypatch):
    """Also where a join turns out small only at run time, and its sides are then read as they were split."""
    monkeypatch.setattr(J, "triage_failures", lambda failures, *more: (_ for _ in ()).throw(StopIteration(failures)))
    rows = spark.range(0, 800, 1, 8).select((F.col("id") % 50).cast("string").alias("report_id"), F.col("id").alias("failure_idx"), *[F.lit("x").alias(c) for c in ("test_case_id", "scenario_name", "failed_step_line", "error_message", "failure_image", "video_url")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        with pytest.raises(StopIteration) as found:
            J.triage_reports(rows.select("report_id", F.lit("EXTENT").alias("report_type")).distinct(), None, pieces=R.render_pieces(rows))
        keys = found.value.value.select("report_id", "failure_idx").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(keys) == len(set(keys)) == 800
