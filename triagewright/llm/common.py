"""What the corpus operators share: reading, cutting lineage, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in an Arrow batch: texts may be long, and a batch is held whole by JVM and Python worker.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as named in spark.checkpoint.dir. Where that is unset, one process alone (as in tests) gets a temporary
    folder; a cluster gets an error, as its executors share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="triagewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: computed once, and later stages don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, without: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """docs as one struct column, doc (less the columns `without`), beside the named ones: whatever docs' columns are called, no name clashes."""
    kept = [quoted(c) for c in docs.columns if c not in without]
    return docs.select(F.struct(*kept).alias("doc") if kept else F.lit(True).alias("doc"), *[c.alias(n) for n, c in named.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unpacked(columns: list[str], **instead: Column) -> list[Column]:
    """packed()'s columns again, in order; those named in `instead` from there."""
    return [(instead[c] if c in instead else F.col("doc").getField(c)).alias(c) for c in columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_text(
    make: Callable[[], Callable[[str], tuple]], schema: pa.Schema, keep: list[str], text: str
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: make() once a task, then its result for each text (null: empty) beside the kept columns."""
    names = [f.name for f in schema][len(keep) :]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            rows = [of(t or "") for t in batch.column(text).to_pylist()]
            columns = [batch.column(k) for k in keep]
            for i, name in enumerate(names):
                columns.append(pa.array([r[i] for r in rows], schema.field(name).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def with_arrow(df: DataFrame, make: Callable, keep: list[str], text: str, added: str) -> DataFrame:
    """df's kept columns and what make()'s function gives for each text, as named and typed in `added`."""
    out = StructType([df.schema[k] for k in keep] + StructType.fromDDL(added).fields)
    return df.select(*keep, text).mapInArrow(per_text(make, to_arrow_schema(out), keep, text), out)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out_of(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def bounded_sample(df: DataFrame, key: str, rows: int, order: tuple[str, ...] = ()) -> DataFrame:
    """About `rows` rows of df, 1.5 times that at most: those whose hashed key is low, the first by hash, key and `order`, the same on every run."""
    n = df.count()
    if n <= rows:
        return df
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 40))
    return df.where(hashed < int(rows / n * (1 << 40))).orderBy(hashed, key, *order).limit(rows + rows // 2)
