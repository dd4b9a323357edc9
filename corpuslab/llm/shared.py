"""What the operators of this subpackage share: tables in the shared folder, sizes, parquet input."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Of an Arrow batch sent to Python.
BATCH_BYTES = "8m"

_made: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a local one only where that is unset and driver and
    executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_corpuslab_root", None) or f"file://{tempfile.mkdtemp(prefix='corpuslab-')}"
        spark._corpuslab_root = root
    return root.rstrip("/")


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a table to the shared folder and read it again.

    It cuts the lineage: a lost executor costs no more than the tasks that
    were running, since every executor can read the files.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/corpuslab/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside are deleted at the end, but for the last, which must hold all that is read later."""
    start = len(_made)
    yield
    _delete(_made[start:-1])
    del _made[start:-1]


def _clean() -> None:
    _delete(_made)


def _delete(tables: list[tuple[object, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has gone; the folder's owner cleans it
            continue


def unused(name: str, columns: list[str]) -> str:
    """The name, or the first like it that no column has (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """A 64-bit hash of the text, A-Z lower-cased; null is the empty text."""
    return F.xxhash64(ascii_lower(F.coalesce(text, F.lit(""))))


def keep_one(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(node, root): components of text keys. Of the rows of a component one stays, with all its columns: that of the
    smallest doc_id, then of the smallest text key. Rows without an id stay; rows that share an id but not a
    component each stay."""
    key, ident, copies = (unused(x, docs.columns) for x in ("cl_key", "cl_id", "cl_copies"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("node"))
    counted = materialise(rows.groupBy("doc_id", "node").agg(F.count("*").alias(copies)), "rows")
    rooted = counted.join(maybe_broadcast(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("x"), F.count("*").alias("n")).filter("n > 1").select("root", "x")
    least = materialise(least, "least")
    several = rooted.join(maybe_broadcast(least, least.count()), "root")
    gone = materialise(several.filter(F.struct("doc_id", "node") != F.col("x")).select(F.col("doc_id").alias(ident), F.col("node").alias(key + "_")), "gone")
    repeated = counted.filter(F.col(copies) > 1).limit(1).count()
    out = docs.withColumn(key, text_key(F.col("text")))
    out = out.join(maybe_broadcast(gone, gone.count()), (F.col("doc_id") == F.col(ident)) & (F.col(key) == F.col(key + "_")), "left_anti")
    if repeated:  # rows equal in id and text
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id", key]).unionByName(out.filter("doc_id is null"))
    return out.select(*[f"`{c}`" for c in docs.columns])


def arrow_stage(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded by bytes, as rows may be long texts. The setting holds for the session. A worker gives
    its free memory back when a task ends, as it waits idle beside those of later stages."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
                trim(0)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(trimmed, schema)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the quick way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
