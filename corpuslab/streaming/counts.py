"""Structured Streaming: token types and windowed event counts kept up incrementally.

State is one row a key. Late rows are dropped by the watermark; without one (complete mode) counts are exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T
from corpuslab.sources.shared import shared_root


def type_counts(docs: DataFrame, pattern: str = X.WORD) -> DataFrame:
    """Running (lang, word, n) of a stream of documents."""
    return docs.select("lang", F.explode(T.words(F.col("text"), pattern)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _timed(events: DataFrame) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user without a gap."""
    g = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that there is and return the result as a table in the shared folder: executors write it, and state and progress
    are kept there too, so a lost executor or a new driver goes on from the last batch."""
    spark, schema = result.sparkSession, result.schema
    root = f"{shared_root(spark)}/corpuslab/stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        """In complete mode each batch is the whole result; a batch that runs again writes its own folder anew."""
        path = f"{root}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            written.clear()
        written.append(path)

    q = result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream. A folder may be named like a file; its name is no pattern for the files inside."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)
