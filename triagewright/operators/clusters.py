"""Clusters of investigated failures, and what a report adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagewright.functions import text as T

#: Clusters in a piece of an envelope.
PIECE = 1_000


def cluster_name(classification: Column, feature: Column, step: Column) -> Column:
    own = lambda c: F.coalesce(T.trim(c), F.lit(""))
    kind = F.concat(F.lit(" ("), own(classification), F.lit(")"))
    has = lambda c: ~T.blank(c)
    return (
        F.when(has(feature) & has(step), F.concat(own(feature), F.lit(" - "), own(step), kind))
        .when(has(feature), F.concat(own(feature), kind))
        .when(has(step), F.concat(own(step), kind))
        .when(has(classification), own(classification))
        .otherwise("Unknown Failure")
    )


def ordered(value: Column) -> Column:
    """Distinct values that aren't blank, in order of the failures."""
    return F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("failure_idx", value.alias("v")))), lambda x: x["v"]), lambda v: ~T.blank(v)))


def cluster_failures(investigated: DataFrame) -> DataFrame:
    """Clusters of each report, numbered by first appearance. investigated: failures with the response's columns and `investigated`."""
    has = F.col("investigated")
    severity = F.upper("severity")
    rank = F.when(severity == "CRITICAL", 3).when(severity == "HIGH", 2).when(severity == "MEDIUM", 1).otherwise(0)
    signature = T.cluster_signature(F.col("classification"), F.col("feature_name"), F.col("failed_step_line"), F.col("error_message"), has)
    first = F.struct("investigated", "classification", "root_cause", cluster_name(F.col("classification"), F.col("feature_name"), F.col("failed_step_line")).alias("name"))
    found = investigated.withColumn("signature", signature).groupBy("report_id", "signature").agg(
        F.min("failure_idx").alias("first_idx"), F.min_by(first, "failure_idx").alias("first"), F.count("*").alias("failures"),
        F.array_sort(F.collect_list("failure_idx")).alias("failure_indexes"), ordered(F.col("test_case_id")).alias("test_case_ids"), ordered(F.col("scenario_name")).alias("scenarios"),
        F.avg(F.when(has, F.coalesce("confidence", F.lit(0)))).alias("confidence"), F.max(F.when(has, rank).otherwise(0)).alias("rank"),
    )
    number = F.row_number().over(Window.partitionBy("report_id").orderBy("first_idx"))
    given = lambda c: F.when(F.col("first.investigated"), c)
    return found.select(
        "report_id", F.format_string("CLUSTER-%03d", number).alias("cluster_id"), "signature", given(F.col("first.name")).alias("cluster_name"),
        given(F.col("first.classification")).alias("classification"), given(F.col("first.root_cause")).alias("common_root_cause"),
        given(F.coalesce(F.col("confidence"), F.lit(0.0)).cast("int")).alias("confidence"),
        given(F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("rank") + 1)).alias("severity"),
        "failures", "failure_indexes", "test_case_ids", "scenarios",
        F.concat(F.col("failures").cast("string"), F.lit(" failure(s) were grouped based on similar failure characteristics.")).alias("explanation"),
    )


def summarize(investigated: DataFrame) -> DataFrame:
    """Counts of labels and severities a report. Unknown labels count as unknown, unknown severities not at all."""
    label, severity = F.upper("classification"), F.upper("severity")
    known = ("automation", "application", "api", "data", "environment", "network")
    has = F.col("investigated")
    each = [F.count_if(has & (label == f"{k.upper()}_ISSUE")).alias(f"{k}_issues") for k in known]
    other = F.coalesce(~label.isin(*[f"{k.upper()}_ISSUE" for k in known]), F.lit(True))
    return investigated.groupBy("report_id").agg(
        *each, F.count_if(has & other).alias("unknown_issues"),
        *[F.count_if(has & (severity == s.upper())).alias(f"{s}_severity") for s in ("critical", "high", "medium", "low")],
    )


def report_totals(reports: DataFrame, investigated: DataFrame, clusters: DataFrame) -> DataFrame:
    """(report_id, total_failures, total_clusters) for every report, empty ones too."""
    failures = investigated.groupBy("report_id").agg(F.count("*").alias("total_failures"))
    found = clusters.groupBy("report_id").agg(F.count("*").alias("total_clusters"))
    return reports.select("report_id").distinct().join(failures, "report_id", "left").join(found, "report_id", "left").na.fill(0)


def envelope_pieces(reports: DataFrame, investigated: DataFrame, clusters: DataFrame, size: int | None = PIECE) -> DataFrame:
    """Envelopes dealt over rows: (report_id, piece, totals, summary, clusters), each with the next `size` clusters, in order of their numbers; pieces count from 0.
    Totals and summary are the report's in each. No row or task holds a report whole. A report without clusters has one piece; without a size all have."""
    summary = summarize(investigated)
    counts = [c for c in summary.columns if c != "report_id"]
    number = F.substring("cluster_id", len("CLUSTER-") + 1, 20).cast("long")
    at = lambda n: F.lit(0).cast("long") if size is None else F.floor((n - 1) / size)
    item = F.struct(number.alias("number"), F.struct("cluster_id", *[c for c in clusters.columns if c not in ("report_id", "cluster_id")]).alias("cluster"))
    nested = clusters.groupBy("report_id", at(number).alias("piece")).agg(F.array_sort(F.collect_list(item))["cluster"].alias("clusters"))
    heads = report_totals(reports, investigated, clusters).join(summary.select("report_id", F.struct(*counts).alias("summary")), "report_id", "left")
    heads = heads.select("report_id", F.explode(F.sequence(F.lit(0).cast("long"), at(F.greatest("total_clusters", F.lit(1))))).alias("piece"), "total_failures", "total_clusters", "summary")
    empty = F.struct(*[F.lit(0).cast("long").alias(c) for c in counts])
    out = heads.join(nested, ["report_id", "piece"], "left")
    return out.select("report_id", "piece", "total_failures", "total_clusters", F.coalesce("summary", empty).alias("summary"), F.coalesce("clusters", F.array().cast(nested.schema["clusters"].dataType)).alias("clusters"))


def report_envelopes(reports: DataFrame, investigated: DataFrame, clusters: DataFrame) -> DataFrame:
    """One nested row a report, ready to be written as JSON or Parquet. A row holds a report whole; long ones come in envelope_pieces()."""
    return envelope_pieces(reports, investigated, clusters, None).drop("piece")


def listed_clusters(pieces: DataFrame) -> DataFrame:
    """(report_id, totals, summary, listed) of envelope_pieces(): the report's clusters as `id=failures`, in order of their ids as texts.
    They are joined by the first three digits of their number, then those texts: what a task holds of a report are texts alone."""
    head = ["report_id", "total_failures", "total_clusters", "summary"]
    each = pieces.select(*head, F.explode_outer("clusters").alias("c")).select(*head, "c.cluster_id", F.concat_ws("=", "c.cluster_id", F.col("c.failures").cast("string")).alias("entry"))
    text = lambda key, value: F.array_join(F.array_sort(F.collect_list(F.struct(key, value)))[value], ",")
    parts = each.groupBy(*head, F.substring("cluster_id", 1, len("CLUSTER-") + 3).alias("under")).agg(text("cluster_id", "entry").alias("part"))
    return parts.groupBy(*head).agg(text("under", "part").alias("listed"))


def write_envelopes(envelopes: DataFrame, path: str, form: str = "json") -> None:
    """The sink of report_envelopes() and envelope_pieces(): a nested row a report or piece, as JSON lines or another format of Spark's."""
    envelopes.write.mode("append").format(form).save(path)
