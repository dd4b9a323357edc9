"""Corpora as tables: paragraphs, words, tokens.

A corpus is (para_id, text, lang) and its order is a column, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T


TEXT_TABLES = frozenset(("documents", "pages", "conversations"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Text that comes in fewer splits than there are cores is dealt out, as what
    is done to it costs far more than reading; larger tables are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, line_no, text): the non-blank lines of documents."""
    split = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return split.filter(F.col("text").rlike(r"\S"))


def document_words(docs: DataFrame, pattern: str = X.WORD) -> DataFrame:
    """(doc_id, lang, source, word), one row per occurrence."""
    return docs.select("doc_id", "lang", "source", F.explode(T.words(F.col("text"), pattern)).alias("word"))


def word_counts(docs: DataFrame, by: tuple[str, ...] = ("lang",), pattern: str = X.WORD) -> DataFrame:
    """(by..., word, n). Whole-corpus statistics run on this table, a fraction of the text."""
    return document_words(docs, pattern).groupBy(*by, "word").agg(F.count("*").alias("n"))


def first_per_language(corpus: DataFrame, n: int, order: Column | str) -> DataFrame:
    """The first n rows of each language in a stated order. The window keeps n rows a task before the shuffle."""
    w = W.partitionBy("lang").orderBy(order)
    return corpus.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def joined_tokens(sentences: DataFrame, per_lang: int, id_col: str = "id") -> DataFrame:
    """Sentences given as token arrays: join by spaces, drop blanks and redirects, then the first n a language."""
    text = F.array_join("tokens", " ")
    kept = sentences.withColumn("text", text).filter((T.strip(text) != "") & ~T.is_redirect(text))
    return first_per_language(kept, per_lang, id_col)


def take_then_filter(sentences: DataFrame, per_lang: int, id_col: str = "id") -> DataFrame:
    """The other order: the first n a language, then blanks go."""
    return first_per_language(sentences.withColumn("text", F.array_join("tokens", " ")), per_lang, id_col).filter(T.strip(F.col("text")) != "")


def extracted_paragraphs(pages: DataFrame, text_col: str = "text", id_col: str = "page_id", per_lang: int | None = None) -> DataFrame:
    """One page an id; its text by lines, trimmed, without blanks and redirects."""
    once = pages.dropDuplicates([id_col])
    out = once.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "text")).withColumn("text", T.strip(F.col("text")))
    out = out.filter((F.col("text") != "") & ~T.is_redirect(F.col("text")))
    return out if per_lang is None else out.orderBy(id_col, "line_no").limit(per_lang)


def text_corpus(spark: SparkSession, path: str, langs_path: str | None = None) -> DataFrame:
    """A text file, one paragraph a line, with an optional file of languages, line by line. The files must have
    as many lines; blank paragraphs go."""

    def numbered(p: str, name: str) -> DataFrame:
        # wholetext keeps line order without numbering partitions; such files are of hand-made size
        return spark.read.text(p, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("para_id", name))

    out = numbered(path, "text")
    if langs_path:
        langs = numbered(langs_path, "lang").withColumn("lang", F.trim("lang"))
        a, b = out.count(), langs.count()
        if a != b:
            raise ValueError(f"{path} has {a} lines, {langs_path} has {b}")
        out = out.join(langs, "para_id")
    else:
        out = out.withColumn("lang", T.script_guess(F.col("text")))
    return out.filter(T.strip(F.col("text")) != "").select(F.col("para_id").cast("long").alias("para_id"), "text", "lang")


def paragraphs(corpus: DataFrame) -> DataFrame:
    """Paragraphs with protected spans and blocked cuts; a missing language is guessed by script."""
    t = F.col("text")
    return corpus.select("para_id", "text", F.coalesce("lang", T.script_guess(t)).alias("lang"), T.protected_spans(t).alias("protected"), T.blocked_cuts(t).alias("blocked"))
