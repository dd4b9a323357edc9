"""Exact dedup [DataFrame functions only]: group by a 128-bit content hash, compare bytes inside
groups, keep one stable id of each group.

Defined results
  null text            the empty text
  null doc_id          sorts below every id; it stays only if its group has no other id
  repeated rows        rows equal in doc_id and text: exactly one of them can stay
  ties                 there are none but repeated rows
  empty table          empty result
  extra columns        ignored; `decide` reads doc_id and text only
  very long texts      hashed and compared whole
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shared import ascii_lower, materialise, maybe_broadcast, unused


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _collisions(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes whose group holds two different texts.

    Only rows of groups of two or more are compared. The least and the
    greatest text of a group are equal only if all are, byte for byte; both
    are combined before the shuffle, so a group of any size costs one row a
    task. The salt splits the groups' shuffled rows once more.
    """
    several = materialise(groups.filter("n > 1").select("h"), "several")
    rows = texts.join(maybe_broadcast(several, several.count()), "h")
    salted = rows.withColumn("salt", F.spark_partition_id() % 16)
    parts = salted.groupBy(F.struct("h", "salt").alias("k")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("h", F.col("k.h"))
    return parts.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("h")


def decide(docs: DataFrame, keep: str = "max", normalise: Callable[[Column], Column] = ascii_lower, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, h.

    keep: "min" (the smallest id stays) or "max". Texts are equal if
    `normalise` makes them equal byte for byte.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    spark = docs.sparkSession
    texts = docs.select("doc_id", normalise(F.coalesce("text", F.lit(""))).alias("t"))
    texts = texts.select("doc_id", "t", hashed(F.col("t")).alias("h"))
    # rows equal in id and hash are carried as a number of copies
    rows = materialise(texts.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha")), "rows")
    groups = materialise(rows.groupBy("h").agg(F.count("*").alias("n"), pick("doc_id").alias("keep_id")), "groups")
    bad = materialise(_collisions(texts, groups), "collisions")
    n_bad = bad.count()
    if n_bad:  # the text itself becomes the key of these rows
        bad_rows = texts.join(bad, "h", "left_semi").select("doc_id", "t", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
        by_text = bad_rows.groupBy("t").agg(F.count("*").alias("n"), pick("doc_id").alias("keep_id"))
        extra = bad_rows.join(by_text, "t").select("doc_id", "h", "sha", "n", "keep_id")
        rows, groups = rows.join(bad, "h", "left_anti"), groups.join(bad, "h", "left_anti")
    else:
        extra = spark.createDataFrame([], "doc_id bigint, h binary, sha binary, n bigint, keep_id bigint")
    joined = rows.join(groups, "h").select("doc_id", "h", "sha", "n", "keep_id").unionByName(extra)
    # only rows that can stay may repeat, so only those are counted
    stays = joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    goes = joined.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    one = stays.groupBy("doc_id", "h", "sha", "n", "keep_id").agg(F.count("*").alias("copies"))
    one = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("kept", F.col("i") == 1)
    out = goes.unionByName(one.select(*goes.columns))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"), "h")


def dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns."""
    decisions = materialise(decide(docs, keep), "decisions")
    ident, mark, twin, own = (unused(x, docs.columns) for x in ("cl_id", "cl_h", "cl_twin", "cl_hash"))
    is_twin = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = decisions.filter(~F.col("kept")).select(F.col("doc_id").alias(ident), F.col("h").alias(mark), is_twin.alias(twin))
    n, twins = gone.agg(F.count("*"), F.coalesce(F.sum(F.col(twin).cast("int")), F.lit(0))).first()
    cols = [f"`{c}`" for c in docs.columns]
    out = docs.withColumn(own, content_hash(ascii_lower(F.coalesce("text", F.lit("")))))
    other = gone.filter(~F.col(twin))
    out = out.join(maybe_broadcast(other, n), (F.col(own) == F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(ident)), "left_anti")
    if twins:
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*cols)
