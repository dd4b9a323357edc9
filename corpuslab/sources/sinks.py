"""Writers: metrics, reports as CSV, corpora and vectors as text. All write distributed folders but where a single file is said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, in one file, as they are few."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def with_missing(metrics: DataFrame, values: list[str], digits: int = 4) -> DataFrame:
    """Values as text of fixed digits; MISSING where there was no gold."""
    text = lambda c: F.when(F.col(c).isNull(), "MISSING").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double")))
    return metrics.select(*[text(c).alias(c) if c in values else F.col(c) for c in metrics.columns])


def write_csv(metrics: DataFrame, path: str, values: list[str]) -> None:
    with_missing(metrics, values).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """corpus(para_id, text, lang): folders `text` and `langs` of as many lines in the same order, part by part; line ends in a text become spaces."""
    rows = corpus.select("para_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = rows.repartitionByRange("para_id").sortWithinPartitions("para_id").cache()  # both folders from the same ranges
    rows.select("text").write.mode("overwrite").text(f"{path}/text")
    rows.select("lang").write.mode("overwrite").text(f"{path}/langs")
    rows.unpersist()


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors(line, word, vector): one word a line, components with six digits, below a line that gives the size, in one file in line order."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).select(F.lit(-1).cast("long").alias("line"), F.concat_ws(" ", "n", "d").alias("value"))
    body = vectors.select("line", F.concat_ws(" ", "word", F.transform("vector", lambda x: F.format_string("%.6f", x.cast("double")))).alias("value"))
    size.unionByName(body).orderBy("line").coalesce(1).select("value").write.mode("overwrite").text(path)
