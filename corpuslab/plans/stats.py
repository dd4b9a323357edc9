"""Queries over corpus statistics. The corpus is every non-blank line of every document; spans go up to MAX_LEN characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T
from corpuslab.operators import affixes as A
from corpuslab.operators import stats as ST
from corpuslab.operators import substrings as SS
from corpuslab.plans import base as S
from corpuslab.sources import corpus as C

QUERIES, SQL = {}, {}
MAX_LEN, MIN_FREQ = X.DEFAULTS["max_token_len"], 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lines(C.table(spark, sf_dir, "documents"))


CHARS = """chars AS (
    SELECT ch, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY ch
      UNION ALL SELECT chr(10), count(*) - 1 FROM lines) GROUP BY ch),
  dist AS (SELECT ch, n, n / CAST((SELECT sum(n) FROM chars) AS DOUBLE) AS p FROM chars)"""
COUNTS = f"""{S.legal_spans(MAX_LEN)}, counts AS (SELECT tok, CAST(sum(mult) AS BIGINT) AS n FROM legal GROUP BY tok)"""
KEPT = f"""{COUNTS}, kept AS (SELECT tok, n FROM counts WHERE n >= {MIN_FREQ} AND ({S.reason('tok', 'n', MIN_FREQ)}) IS NULL)"""
COSTS = f"""{KEPT}, {CHARS}, mass AS (SELECT length(tok) AS len, sum(n) AS mass FROM kept GROUP BY ALL),
  logs AS (SELECT tok, sum(ln(coalesce(p, 0) + 0.001)) AS logs FROM (SELECT tok, unnest(string_split(tok, '')) AS ch FROM kept) e LEFT JOIN dist USING (ch) WHERE ch <> '' GROUP BY tok),
  ps AS (SELECT tok, n, logs, (n + 1) / CAST(mass + (SELECT count(*) FROM mass) AS DOUBLE) AS p FROM kept JOIN mass ON len = length(tok) JOIN logs USING (tok)),
  costs AS (SELECT tok, n, -ln(p) AS nll, -greatest(least(ln(greatest(p / greatest(exp(logs), 1e-12), 1e-12)), 20.0), -20.0) AS pmi_pen FROM ps)"""


@query(f"WITH {S.LINES}, {CHARS} SELECT ch, n, round(p, 6) AS p FROM dist")
def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1."""
    return ST.char_distribution(_lines(spark, sf_dir)).select("ch", "n", F.round("p", 6).alias("p"))


@query(f"WITH {COUNTS} SELECT tok, n FROM counts WHERE n >= {MIN_FREQ}")
def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2 FLT10 JN2: legal substrings and how often they occur."""
    return ST.substring_counts(_lines(spark, sf_dir), MAX_LEN, MIN_FREQ)


@query(f"""WITH {COUNTS}, r AS (SELECT tok, n, {S.reason('tok', 'n', MIN_FREQ)} AS reason FROM counts)
  SELECT coalesce(reason, 'kept') AS reason, count(*) AS types, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def candidate_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6 FLT7: what becomes of every substring."""
    counts = SS.counted(ST.distinct_lines(_lines(spark, sf_dir)), MAX_LEN, MIN_FREQ)  # rarer types are one row a task
    reason = F.when(F.col("tok").isNull(), "low_freq").otherwise(F.coalesce(ST.filter_reason(F.col("tok"), F.col("n"), MIN_FREQ), F.lit("kept")))
    return counts.groupBy(reason.alias("reason")).agg(F.sum("types").alias("types"), F.sum("n").alias("n"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    kept = ST.candidates(ST.substring_counts(lines, MAX_LEN, MIN_FREQ), MIN_FREQ)
    return ST.costs(kept, ST.char_distribution(lines))


@query(f"WITH {COSTS} SELECT tok, n, round(nll, 6) AS nll, round(pmi_pen, 6) AS pmi_pen FROM costs")
def candidate_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3 AGG4 JN4: length-conditioned likelihood and cohesion."""
    return _costs(spark, sf_dir).select("tok", "n", F.round("nll", 6).alias("nll"), F.round("pmi_pen", 6).alias("pmi_pen"))


@query(f"""WITH {COSTS} SELECT tok, round(nll + 0.5 * pmi_pen + 0.01 * length(tok) + CASE WHEN length_grapheme(tok) > 1 THEN -0.05 * (length_grapheme(tok) - 1) ELSE 0.2 END
    + CASE WHEN length(tok) > 1 THEN 0.25 ELSE 0 END, 6) AS cost FROM costs""")
def base_token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN9 FN10, lambda 0.25."""
    c = _costs(spark, sf_dir)
    return c.select("tok", F.round(ST.base_cost(F.col("tok"), F.col("nll"), F.col("pmi_pen"), lam=0.25), 6).alias("cost"))


@query(f"""WITH {KEPT} SELECT k.tok AS tok, CAST(sum(l.mult) AS BIGINT) AS n, count(DISTINCT l.text) AS lines, CAST(min(l.i) AS INTEGER) AS first_start FROM legal l JOIN kept k USING (tok) GROUP BY k.tok""")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5 JN3: kept tokens with their occurrences; a row stands for all copies of a line."""
    counts = SS.counted(ST.distinct_lines(_lines(spark, sf_dir)), MAX_LEN, MIN_FREQ, places=True).filter("tok is not null")
    return ST.candidates(counts, MIN_FREQ).select("tok", "n", F.col("texts").alias("lines"), F.col("first_start").cast("int").alias("first_start"))


AFFIXES = "affixes AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(a)}, {S.q(b)}, {S.q(c)})" for a, b, c in X.affix_rows()) + ") t(lang, kind, affix))"
CLASSES = "classes AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(a)}, {S.q(b)}, {S.q(c)})" for a, b, c in X.class_rows()) + ") t(cls, lang, suffix))"
FLAGS = f"""{S.WORDS}, {AFFIXES}, toks AS (SELECT lang, word AS tok, count(*) AS n FROM words GROUP BY ALL),
  flags AS (SELECT t.lang, t.tok, t.n,
    EXISTS (SELECT 1 FROM affixes a WHERE a.lang = t.lang AND a.kind = 'pre' AND starts_with(lower(t.tok), a.affix) AND length(lower(t.tok)) > length(a.affix)) AS has_pre,
    EXISTS (SELECT 1 FROM affixes a WHERE a.lang = t.lang AND a.kind = 'suf' AND ends_with(lower(t.tok), a.affix) AND length(lower(t.tok)) > length(a.affix)) AS has_suf FROM toks t)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(C.table(spark, sf_dir, "documents")).withColumnRenamed("word", "tok")


@query(f"WITH {FLAGS} SELECT lang, has_pre, has_suf, count(*) AS types, CAST(sum(n) AS BIGINT) AS n FROM flags GROUP BY ALL")
def affix_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9 FN14: words with a known prefix or suffix, by equi-join on their own ends."""
    toks = _tokens(spark, sf_dir)
    flags = A.affix_flags(toks.select("lang", "tok"), A.affix_table(spark)).join(toks, ["lang", "tok"])
    return flags.groupBy("lang", "has_pre", "has_suf").agg(F.count("*").alias("types"), F.sum("n").alias("n"))


CLASSED = f"""{S.WORDS}, {CLASSES}, toks AS (SELECT lang, word AS tok, count(*) AS n FROM words GROUP BY ALL),
  classed AS (SELECT DISTINCT t.lang, t.tok, c.cls FROM toks t JOIN classes c ON c.lang = t.lang AND ends_with(lower(t.tok), c.suffix) AND length(lower(t.tok)) > length(c.suffix))"""


@query(f"WITH {CLASSED} SELECT cls, lang, count(*) AS types FROM classed GROUP BY ALL")
def class_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10 AGG10 FLT11: words of each cross-lingual class by language."""
    classed = A.token_classes(_tokens(spark, sf_dir).select("lang", "tok"), A.class_table(spark))
    return classed.groupBy("cls", "lang").agg(F.count("*").alias("types"))


@query(f"""WITH {CLASSED}, s AS (SELECT cls, lang, tok, row_number() OVER (PARTITION BY cls, lang ORDER BY n DESC, tok) AS rn FROM classed JOIN toks USING (lang, tok)),
  top AS (SELECT * FROM s WHERE rn <= 20)
  SELECT a.cls, a.lang AS lang_a, b.lang AS lang_b, count(*) AS pairs FROM top a JOIN top b ON a.cls = b.cls AND (a.lang <> b.lang OR a.tok <> b.tok) GROUP BY ALL""")
def class_mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11 JN12 M25 WIN1: pairs of class mates among the 20 most frequent words of each class and language."""
    toks = _tokens(spark, sf_dir)
    classed = A.token_classes(toks.select("lang", "tok"), A.class_table(spark)).join(toks, ["lang", "tok"])
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("cls", "lang").orderBy(F.desc("n"), "tok"))
    top = classed.withColumn("rn", rn).filter("rn <= 20").select("cls", "lang", "tok")
    return A.class_mates(top).groupBy("cls", "lang_a", "lang_b").agg(F.count("*").alias("pairs"))


@query(f"""WITH {FLAGS} SELECT lang, count(*) AS types, round(sum(n * (0.25 * {S.internal_spaces('tok')} - 0.1 * CAST(has_suf AS INTEGER) - 0.1 * CAST(has_pre AS INTEGER)
    + CASE WHEN ({S.script_guess('tok')}) NOT IN ('other', lang) THEN 0.05 ELSE 0 END)) / sum(n), 6) AS mean_cost FROM flags GROUP BY lang""")
def mean_linguistic_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11 AGG6 JN8: occurrence-weighted mean of the intrinsic cost; the cost is made once a (language, word)."""
    toks = _tokens(spark, sf_dir)
    cost = A.intrinsic_cost(toks.select("lang", "tok"), A.affix_table(spark)).join(toks, ["lang", "tok"])
    return cost.groupBy("lang").agg(F.count("*").alias("types"), F.round(F.sum(F.col("n") * F.col("cost")) / F.sum("n"), 6).alias("mean_cost"))


@query(f"""WITH {S.WORDS}, c AS (SELECT word, lang, count(*) AS n, min(doc_id) AS first FROM words GROUP BY ALL)
  SELECT word, arg_max(lang, {{'n': n, 'f': -first, 'l': lang}}) AS lang, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY word""")
def majority_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: the language in which a word is most frequent; ties go to the first document."""
    c = C.document_words(C.table(spark, sf_dir, "documents")).groupBy("word", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return c.groupBy("word").agg(F.max_by("lang", F.struct("n", -F.col("first"), "lang")).alias("lang"), F.sum("n").alias("n"))
