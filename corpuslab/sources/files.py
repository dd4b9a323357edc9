"""Files of evaluation data as tables: translation pairs, probes, dictionaries, word similarities, vectors, recorded metrics.

Line order is kept as a column, `line`, where a limit or "the first wins" needs it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.fixed import PAIR_SEPARATORS

# Names of fields that mean the same, best first.
SOURCE_TEXT = "source src text_source sentence1 source_sentence sourceText original".split()
TARGET_TEXT = "target tgt text_target sentence2 target_sentence translation translated".split()
SOURCE_LANG = "source_lang src_lang src_language source_language language_source lang_source lang1 language1".split()
TARGET_LANG = "target_lang tgt_lang tgt_language target_language language_target lang_target lang2 language2".split()
LANG_PAIR = "lang_pair language_pair langs".split()


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file in order. Numbers rise but have gaps between splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def first_lines(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in line order (all for None)."""
    return rows if n is None else rows.orderBy("line").limit(n)


def _given(fields: Column, names: list[str]) -> Column:
    """The first of the named fields that isn't blank, trimmed."""
    return F.coalesce(*[F.when(T.strip(fields[n]) != "", T.strip(fields[n])) for n in names])


def split_pair(value: Column) -> Column:
    """(left, right) of a language pair, at the first separator of the list that leaves two parts."""

    def at(sep: str) -> Column:
        k = F.instr(value, sep)
        left, right = T.strip(F.substring(value, F.lit(1), k - 1)), T.strip(F.substring(value, k + len(sep), F.length(value)))
        return F.when((k > 0) & (left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right")))

    return F.coalesce(*[at(s) for s in PAIR_SEPARATORS])


def parallel_pairs(spark: SparkSession, path: str, limit: int | None = None, source_lang: str | None = None, target_lang: str | None = None) -> DataFrame:
    """(line, source, target, source_lang, target_lang, metadata) of JSON lines. Lines that are no object, or lack a text or a language
    (given defaults aside), go; limit counts pairs."""
    f = F.col("fields")
    rows = numbered(spark, path).select("line", F.from_json(T.strip(F.col("value")), "map<string,string>").alias("fields")).filter("fields is not null")
    a, b = _given(f, SOURCE_LANG), _given(f, TARGET_LANG)
    named = _given(f, LANG_PAIR)
    listed = F.from_json(f["langs"], "array<string>")
    pair = F.when(~F.startswith(named, F.lit("[")), split_pair(named))
    pair = F.coalesce(pair, F.when(F.size(listed) >= 2, F.struct(T.strip(listed[0]).alias("left"), T.strip(listed[1]).alias("right"))))
    both = a.isNotNull() & b.isNotNull()
    known = [*SOURCE_TEXT, *TARGET_TEXT, *SOURCE_LANG, *TARGET_LANG, *LANG_PAIR]
    rows = rows.select(
        "line", _given(f, SOURCE_TEXT).alias("source"), _given(f, TARGET_TEXT).alias("target"),
        F.coalesce(F.when(~both, pair["left"]), a, F.lit(source_lang)).alias("source_lang"), F.coalesce(F.when(~both, pair["right"]), b, F.lit(target_lang)).alias("target_lang"),
        F.map_filter(f, lambda k, _: ~k.isin(known)).alias("metadata"),
    )
    return first_lines(rows.dropna(subset=["source", "target", "source_lang", "target_lang"]), limit)


def feature_probes(spark: SparkSession, path: str, limit: int | None = None, language: str | None = None) -> DataFrame:
    """(line, text, language, span, feature, expectation, case_sensitive, metadata) of JSON lines that have a text and a span."""
    f = F.col("fields")
    rows = numbered(spark, path).select("line", F.from_json(T.strip(F.col("value")), "map<string,string>").alias("fields")).filter("fields is not null")
    full = lambda name: F.when(f[name] != "", f[name])
    rows = rows.select(
        "line", full("text").alias("text"), F.coalesce(full("language"), F.lit(language)).alias("language"), F.coalesce(full("span"), full("substring")).alias("span"),
        F.coalesce(f["feature"], F.lit("lexicon")).alias("feature"), F.coalesce(f["expectation"], F.lit("single_token")).alias("expectation"),
        F.coalesce(F.lower(T.strip(f["case_sensitive"])).isin("true", "1", "yes"), F.lit(False)).alias("case_sensitive"), f["metadata"].alias("metadata"),
    )
    return first_lines(rows.dropna(subset=["text", "span", "language"]), limit)


def dictionary(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line, src, tgt): the first two fields of each line that has them; lines that start with # go."""
    rows = numbered(spark, path).withColumn("f", F.split(T.strip(F.col("value")), r"\s+"))
    rows = rows.filter((F.size("f") >= 2) & ~F.startswith(F.get("f", 0), F.lit("#")))
    return first_lines(rows.select("line", F.get("f", 0).alias("src"), F.get("f", 1).alias("tgt")), limit)


def similarities(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """(line, w1, w2, score): the first two fields and the last. JSON by its field names. With `header` the first line goes if its first
    field isn't a number, as in the reference data some files have none: pass False for those."""
    if path.lower().endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
        return rows.select(F.monotonically_increasing_id().alias("line"), F.col("word1").alias("w1"), F.col("word2").alias("w2"), F.col("score").cast("double").alias("score"))
    pattern = r"\s+" if delimiter is None else rf"\Q{delimiter}\E"
    line = T.strip(F.col("value")) if delimiter is None else F.col("value")
    rows = numbered(spark, path).withColumn("f", F.transform(F.split(line, pattern), lambda x: F.regexp_replace(x, '^"|"$', "")))
    if header:  # the first line of the file has number 0
        rows = rows.filter((F.col("line") != 0) | F.regexp_replace(F.get("f", 0), r"\.", "").rlike(r"^\d+$"))
    rows = rows.filter((F.size("f") >= 3) & ~F.startswith(F.get("f", 0), F.lit("#")))
    out = rows.select("line", F.get("f", 0).alias("w1"), F.get("f", 1).alias("w2"), F.element_at("f", -1).try_cast("double").alias("score"))
    return out.filter(F.col("score").isNotNull())


def word_pairs(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """(line, w1, w2, score) of lines of exactly three fields; longer ones hold phrases."""
    value = F.lower("value") if lower else F.col("value")
    rows = numbered(spark, path).withColumn("f", F.split(T.strip(value), r"\s+")).filter(F.size("f") == 3)
    return rows.select("line", F.get("f", 0).alias("w1"), F.get("f", 1).alias("w2"), F.get("f", 2).cast("double").alias("score"))


def text_vectors(spark: SparkSession, path: str, dims: int, most: int | None = None, lower: bool = True) -> DataFrame:
    """(line, word, vector) of a text file whose first line gives its size. The first line of a word wins; null vectors are moved by
    0.01 in their first component; lines of another dimension go; `most` words by line."""
    rows = numbered(spark, path).filter("line > 0").withColumn("f", F.split(F.rtrim("value"), " "))
    word = F.lower(F.get("f", 0)) if lower else F.get("f", 0)
    x = F.transform(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(1))), lambda e: e.try_cast("double"))
    rows = rows.select("line", word.alias("word"), x.alias("x")).filter((F.size("x") == dims) & ~F.exists("x", lambda e: e.isNull()))
    moved = F.concat(F.array(F.lit(0.01)), F.slice("x", 2, dims))
    rows = rows.withColumn("x", F.when(F.exists("x", lambda e: e != 0), F.col("x")).otherwise(moved))
    once = rows.groupBy("word").agg(F.min(F.struct("line", "x")).alias("r")).select("r.line", "word", F.col("r.x").alias("vector"))
    return first_lines(once, most)


def lower_case_subset(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """vectors(line, word, vector) by falling frequency: of the spellings of a word the most frequent, lower-cased; the first `most`."""
    once = vectors.groupBy(F.lower("word").alias("word")).agg(F.min_by("vector", "line").alias("vector"), F.min("line").alias("line"))
    return first_lines(once.select("line", "word", "vector"), most)


def known_pairs(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The pairs (src, tgt) whose words both have vectors."""
    return pairs.join(source.select(F.col("word").alias("src")), "src", "left_semi").join(target.select(F.col("word").alias("tgt")), "tgt", "left_semi")


def identical_strings(source: DataFrame, target: DataFrame) -> DataFrame:
    """(src, tgt): words that both sides have."""
    return source.select(F.col("word").alias("src")).join(target.select(F.col("word").alias("src")), "src", "left_semi").withColumn("tgt", F.col("src"))


def aligned_sentences(spark: SparkSession, source: str, target: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """(line, source, target) of two files line by line; of sentences that a side repeats the first stays; in an order that the seed gives."""
    sides = [numbered(spark, p).select("line", F.col("value").alias(n)) for p, n in ((source, "source"), (target, "target"))]
    rows = reduce(lambda a, b: a.join(b, "line"), sides)
    for side in ("source", "target"):
        rows = rows.groupBy(side).agg(F.min(F.struct("line", "source", "target")).alias("r")).select("r.*")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "line"))
    return (rows.orderBy("order", "line") if most is None else rows.orderBy("order", "line").limit(most)).select("line", "source", "target")


def morphemes(spark: SparkSession, path: str) -> DataFrame:
    """(word, boundaries) of JSON lines."""
    return spark.read.schema("word string, boundaries array<int>").json(path).filter(F.col("word").isNotNull())


def token_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(word, model, pieces) of a CSV file in code page 1252; token_pieces is a JSON array. Spark reads Latin-1, of which the code page
    changes 0x80 to 0x9F."""
    changed = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    known = {a: b for a, b in changed.items() if b}
    rows = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    rows = rows.select(*[F.translate(c, "".join(known), "".join(known.values())).alias(c) for c in ("word", "model", "token_pieces")])
    return rows.select("word", "model", F.from_json("token_pieces", "array<string>").alias("pieces"))


def recorded_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of metrics: text columns, and numbers where all values are numbers."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def preferred_gold(spark: SparkSession, folder: str, preferred: str = "MorphoLex.jsonl") -> DataFrame:
    """JSON-lines gold of a language's folder: the preferred file if it is there, else the first other by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path").collect()
    paths = sorted((not r["path"].endswith(f"/{preferred}"), r["path"]) for r in files)  # a folder's few files
    schema = "word string, boundaries array<int>, segments array<struct<start:int,end:int,type:string>>"
    return spark.read.schema(schema).json(paths[0][1]) if paths else spark.createDataFrame([], schema)


def wiki_paragraphs(pages: DataFrame, per_lang: int, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, line_no, lang, text): paragraphs of articles(id, lang, text), trimmed, without blanks and redirects, the first per_lang of
    each language."""
    rows = pages.groupBy("lang", id_col).agg(F.min(text).alias(text)).select(id_col, "lang", F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    rows = rows.withColumn("text", T.strip(F.col("text"))).filter((F.col("text") != "") & ~T.is_redirect(F.col("text")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(id_col, "line_no"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= per_lang).drop("rank")
