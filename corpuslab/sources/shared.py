"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_corpuslab_shared", None) or f"file://{tempfile.mkdtemp(prefix='corpuslab-')}"
        spark._corpuslab_shared = root
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_root(df.sparkSession)}/corpuslab/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
