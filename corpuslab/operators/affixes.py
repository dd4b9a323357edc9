"""Affix and class features by equi-joins: a token's own prefixes and suffixes, bounded by the longest affix, meet the
affix table. No nested loop over affixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T


def affix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.affix_rows(), "lang string, kind string, affix string")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.class_rows(), "cls string, lang string, suffix string")


def read_overrides(spark: SparkSession, base: DataFrame, path: str) -> DataFrame:
    """A JSON file {lang: {pre: [...], suf: [...]}} replaces the languages it names."""
    kinds = "struct<pre:array<string>,suf:array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{kinds}>")).alias("lang", "k"))
    rows = [raw.select("lang", F.lit(kind).alias("kind"), F.explode(F.col("k")[kind]).alias("affix")) for kind in ("pre", "suf")]
    new = rows[0].unionByName(rows[1])
    return base.join(F.broadcast(raw.select("lang")), "lang", "left_anti").unionByName(new).dropDuplicates()


def merge_classes(spark: SparkSession, base: DataFrame, path: str) -> DataFrame:
    """A JSON file {class: {lang: [...]}} replaces the (class, language) pairs it names and adds the rest."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("cls", "langs"))
    raw = raw.select("cls", F.explode("langs").alias("lang", "items"))
    new = raw.select("cls", "lang", F.explode("items").alias("suffix"))
    return base.join(F.broadcast(raw.select("cls", "lang")), ["cls", "lang"], "left_anti").unionByName(new).dropDuplicates()


def ends(token: Column, longest: int, kind: str) -> Column:
    """The proper suffixes (or prefixes) of up to `longest` characters."""
    low, n = F.lower(token), F.length(F.lower(token))
    upto = F.least(n - 1, F.lit(longest))
    cut = (lambda k: F.substring(low, n - k + 1, k)) if kind == "suf" else (lambda k: F.substring(low, F.lit(1), k))
    return F.when(upto >= 1, F.transform(F.sequence(F.lit(1), upto), cut)).otherwise(F.array().cast("array<string>"))


def affix_flags(tokens: DataFrame, affixes: DataFrame, longest: int = 12) -> DataFrame:
    """tokens(lang, tok) distinct -> (lang, tok, has_pre, has_suf); a token must be longer than its affix. longest bounds
    the affixes that can be found and must be at least the longest of the table."""
    a = F.broadcast(affixes)  # a fixed resource
    sides = []
    for kind in ("pre", "suf"):
        cut = tokens.select("lang", "tok", F.explode(ends(F.col("tok"), longest, kind)).alias("affix"))
        sides.append(cut.join(a.filter(F.col("kind") == kind), ["lang", "affix"], "left_semi").select("lang", "tok", F.lit(kind).alias("kind")))
    hits = sides[0].unionByName(sides[1]).groupBy("lang", "tok").agg(F.max(F.col("kind") == "pre").alias("p"), F.max(F.col("kind") == "suf").alias("s"))
    no = F.lit(False)
    return tokens.join(hits, ["lang", "tok"], "left").select("lang", "tok", F.coalesce("p", no).alias("has_pre"), F.coalesce("s", no).alias("has_suf"))


def token_classes(tokens: DataFrame, classes: DataFrame, longest: int = 12) -> DataFrame:
    """(lang, tok, cls): cross-lingual classes by suffix, each once a token."""
    cut = tokens.select("lang", "tok", F.explode(ends(F.col("tok"), longest, "suf")).alias("suffix"))
    return cut.join(F.broadcast(classes), ["lang", "suffix"]).select("lang", "tok", "cls").distinct()


def class_mates(classed: DataFrame) -> DataFrame:
    """Ordered pairs of different tokens of one class (the equivalence graph). Quadratic by definition of the graph; `class_star`
    carries the same Laplacian smoothing at linear size."""
    a, b = classed.alias("a"), classed.alias("b")
    return a.join(b, F.col("a.cls") == F.col("b.cls")).filter("a.lang <> b.lang or a.tok <> b.tok").select("a.cls", F.col("a.lang").alias("lang_a"), F.col("a.tok").alias("tok_a"), F.col("b.lang").alias("lang_b"), F.col("b.tok").alias("tok_b"))


def intrinsic_cost(tokens: DataFrame, affixes: DataFrame, lexicon: DataFrame | None = None, mwe: DataFrame | None = None, gazetteer: DataFrame | None = None, space_penalty: float = X.DEFAULTS["space_penalty"],
                   email_reward: float = 0.0, url_reward: float = 0.0, hashtag_reward: float = 0.0, prefix_reward: float = 0.1, suffix_reward: float = 0.1) -> DataFrame:
    """tokens(lang, tok), lang may be null -> (lang, tok, cost): the context-free part of the linguistic cost. Terms that need a
    language vanish where it is null. lexicon(tok, score), mwe(tok), gazetteer(tag, tok, score) are small resources."""
    t = F.col("tok")
    rows = affix_flags(tokens.filter("lang is not null").distinct(), affixes).unionByName(
        tokens.filter("lang is null").distinct().select("lang", "tok", F.lit(False).alias("has_pre"), F.lit(False).alias("has_suf"))
    )
    cost = space_penalty * (F.length(T.strip(t)) - F.length(F.translate(T.strip(t), " ", "")))
    if email_reward:
        cost = cost + F.when(T.matches(t, T.full(X.EMAIL)), email_reward).otherwise(0.0)
    if url_reward:
        cost = cost + F.when(T.matches(t, X.URL), url_reward).otherwise(0.0)
    if hashtag_reward:
        cost = cost + F.when(t.startswith("#") & (F.length(t) > 1), hashtag_reward).otherwise(0.0)
    if lexicon is not None:
        rows = rows.join(F.broadcast(lexicon.groupBy("tok").agg(F.sum("score").alias("__lex"))), "tok", "left")
        cost = cost - F.coalesce("__lex", F.lit(0.0))
    if mwe is not None:
        rows = rows.join(F.broadcast(mwe.select("tok").distinct().withColumn("__mwe", F.lit(1.0))), "tok", "left")
        cost = cost - F.coalesce("__mwe", F.lit(0.0))
    if gazetteer is not None:
        rows = rows.join(F.broadcast(gazetteer.groupBy("tok").agg(F.sum("score").alias("__gaz"))), "tok", "left")
        cost = cost - F.coalesce("__gaz", F.lit(0.0))
    script = T.script_guess(t)
    known = F.col("lang").isNotNull()
    cost = cost - F.when(F.col("has_suf"), suffix_reward).otherwise(0.0) - F.when(F.col("has_pre"), prefix_reward).otherwise(0.0)
    cost = cost + F.when(known & (script != "other") & (script != F.col("lang")), X.SCRIPT_MISMATCH).otherwise(0.0)
    return rows.select("lang", "tok", cost.cast("double").alias("cost"))
