"""The feedback log as a store: open days of events beside a compacted table, so that reading doesn't grow with the days gone by.

    log/day=YYYY-MM-DD/            events, by the day they are about; a day's are dealt over PARTS files an append, by ranges of bucket (a hash of their id)
    table/version=N/bucket=B/      the events that still matter of all days that were closed by then
    commits/version=N/             (file, day): what version N was made of; a version counts once this is whole

Of an id's events the state needs its first, its last AI result and its last correction alone (history.feedback_current()): these are events
themselves, so the table has the log's columns, and folding it again with later or late events gives the same. A closed day isn't read again: its
files are named in the commit; files that came after them (late events, writers that hadn't seen the commit) aren't, and so are read.
A crash between the two writes leaves a table that no commit names. Files that the last commit but one named are deleted by the next compaction.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagewright import schemas as S
from triagewright.operators import history as H

BUCKETS, PARTS = 64, 4
ROWS = S.FEEDBACK_LOG + ", bucket int"


def bucket_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = files(spark, path)
    return system.exists(where)


def append(events: DataFrame, path: str) -> None:
    """Adds events to the log. The same event twice changes nothing."""
    rows = H.evolve_feedback(H.usable(events)).withColumns({"day": F.to_date("event_time"), "bucket": bucket_of(F.col("failure_id"))})
    part = F.floor(F.col("bucket") * PARTS / BUCKETS)
    rows.repartition("day", part).sortWithinPartitions("day", "bucket").write.mode("append").partitionBy("day").parquet(f"{path}/log")


def version(spark: SparkSession, path: str) -> int:
    """The last version whose commit is whole, 0 if there is none."""
    system, where = files(spark, f"{path}/commits")
    if not system.exists(where):
        return 0
    known = [s.getPath().toString() for s in system.listStatus(where)]
    return max((int(p.rsplit("=", 1)[1]) for p in known if exists(spark, f"{p}/_SUCCESS")), default=0)


def consumed(spark: SparkSession, path: str, number: int) -> set[str]:
    """Names of the log's files that a version holds and that may still be there: those of its own commit and the one before."""
    named = [f"{path}/commits/version={n}" for n in (number - 1, number) if n > 0 and exists(spark, f"{path}/commits/version={n}/_SUCCESS")]
    return {r.file for p in named for r in spark.read.schema("file string, day date").parquet(p).collect()}


def log_files(spark: SparkSession, path: str) -> dict[str, date]:
    """The log's files by their name below log/, with their days; only names are listed."""
    system, where = files(spark, f"{path}/log")
    if not system.exists(where):
        return {}
    found, listed = {}, system.listFiles(where, True)
    while listed.hasNext():
        name = listed.next().getPath().toString().rsplit("/log/", 1)[1]
        if name.endswith(".parquet") and not name.rsplit("/", 1)[1].startswith(("_", ".")):
            found[name] = date.fromisoformat(name.split("/", 1)[0].removeprefix("day="))
    return found


def read_log(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files of the log; columns that older ones lack are null."""
    if not names:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS + ", day date").option("basePath", f"{path}/log").parquet(*[f"{path}/log/{n}" for n in names]).drop("day")


def read_table(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/table/version={number}")


def survivors(events: DataFrame) -> DataFrame:
    """The events that an id's state depends on: its first, its last AI result, its last correction. A partial aggregate, whatever an id's events are."""
    columns = [c for c in events.columns if c != "failure_id"]
    order, row = F.struct("event_time", "seq"), F.struct(*columns)
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, row), F.when(F.col("kind") == kind, order))
    kept = events.groupBy("failure_id").agg(F.array(F.min_by(row, order), last("AI"), last("HUMAN")).alias("kept"))
    return kept.select("failure_id", F.inline(F.array_distinct(F.array_compact("kept")))).select(events.columns)


def events(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """The events that make the current state. ids (failure_id): of these alone; only the buckets that they are in are read."""
    number = version(spark, path)
    done = consumed(spark, path, number)
    rows = read_log(spark, path, [n for n in log_files(spark, path) if n not in done])
    if number:
        rows = rows.unionByName(read_table(spark, path, number))
    if ids is not None:
        wanted = [r.b for r in ids.select(bucket_of(F.col("failure_id")).alias("b")).distinct().collect()]  # BUCKETS at most
        rows = rows.where(F.col("bucket").isin(wanted)).join(ids.select("failure_id").distinct(), "failure_id", "left_semi")
    return rows.drop("bucket")


def current(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    return H.feedback_current(events(spark, path, ids))


def compact(spark: SparkSession, path: str, before: date) -> int:
    """Folds the log's days before that one, and late files of days closed earlier, into a new version of the table; gives its number."""
    number = version(spark, path)
    done, there = consumed(spark, path, number), log_files(spark, path)
    names = sorted(n for n, day in there.items() if n not in done and day < before)
    rows = read_log(spark, path, names)
    if number:
        rows = rows.unionByName(read_table(spark, path, number))
    new = number + 1
    folded = survivors(rows.drop("bucket")).withColumn("bucket", bucket_of(F.col("failure_id")))
    folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/table/version={new}")
    listed = spark.createDataFrame([(n, there[n]) for n in names], "file string, day date")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={new}")
    clean(spark, path, new)
    return new


def clean(spark: SparkSession, path: str, number: int) -> None:
    """Deletes what no reader of this version or the last needs: files of the log named by the last commit, older tables."""
    old = f"{path}/commits/version={number - 1}"
    if number > 1 and exists(spark, f"{old}/_SUCCESS"):
        for r in spark.read.schema("file string, day date").parquet(old).collect():
            system, where = files(spark, f"{path}/log/{r.file}")
            system.delete(where, False)
    for n in range(max(1, number - 3), number - 1):
        system, where = files(spark, f"{path}/table/version={n}")
        system.delete(where, True)
