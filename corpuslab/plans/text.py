"""Queries over text functions: classes, scripts, filters, spans, n-grams, run clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T
from corpuslab.operators import decode as D
from corpuslab.operators import evaluate as E
from corpuslab.plans import base as S
from corpuslab.sources import corpus as C

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count("*").alias(name)


PIECES = rf"{X.URL}|{X.EMAIL}|{X.WORD}|[^\p{{L}}\p{{N}}_\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]"


@query(f"""WITH p AS (SELECT lang, unnest(regexp_extract_all(text, {S.q(PIECES)})) AS tok FROM documents),
  c AS (SELECT lang, tok, count(*) AS n FROM p GROUP BY lang, tok)
  SELECT lang, {S.token_class('tok')} AS cls, CAST(sum(n) AS BIGINT) AS n, count(*) AS types FROM c GROUP BY ALL""")
def token_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1 FN1 FN8: tokens by class and language. Distinct tokens are classified once."""
    toks = C.table(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.col("text"), PIECES)).alias("tok"))
    counts = toks.groupBy("lang", "tok").agg(n())
    return counts.groupBy("lang", T.token_class(F.col("tok")).alias("cls")).agg(F.sum("n").alias("n"), n("types"))


@query(f"""WITH p AS (SELECT role, unnest(regexp_extract_all(text, {S.q(PIECES)})) AS tok FROM conversations)
  SELECT role, {S.token_class('tok')} AS cls, count(*) AS n FROM p GROUP BY ALL""")
def chat_token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1 over conversations."""
    toks = C.table(spark, sf_dir, "conversations").select("role", F.explode(T.words(F.col("text"), PIECES)).alias("tok"))
    return toks.groupBy("role", T.token_class(F.col("tok")).alias("cls")).agg(n())


@query(f"""WITH {S.LINES} SELECT lang, {S.redirect('text')} AS is_redirect, {S.punct_only('text')} AS punct_only, {S.has('text', X.WIKI_NOISE)} AS wiki_noise,
    {S.has('text', X.QUOTE_RUN_EDGE)} AS quote_run, {S.mixed_script('text')} AS mixed_script, {S.internal_spaces('text')} > 2 AS many_spaces, count(*) AS n
  FROM lines GROUP BY ALL""")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1-FLT5: how many lines each combination of filters hits."""
    t = F.col("text")
    flags = {
        "is_redirect": T.is_redirect(t), "punct_only": T.is_punct_only(t), "wiki_noise": T.matches(t, X.WIKI_NOISE), "quote_run": T.matches(t, X.QUOTE_RUN_EDGE),
        "mixed_script": T.is_mixed_script(t), "many_spaces": T.too_many_spaces(t),
    }
    rows = C.lines(C.table(spark, sf_dir, "documents")).select("lang", *[c.alias(k) for k, c in flags.items()])
    return rows.groupBy("lang", *flags).agg(n())


@query(f"SELECT doc_id, {S.redirect('text')} AS is_redirect FROM documents")
def redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 a document."""
    return C.table(spark, sf_dir, "documents").select("doc_id", T.is_redirect(F.col("text")).alias("is_redirect"))


@query(f"""WITH {S.WORDS}, w AS (SELECT DISTINCT word FROM words)
  SELECT {S.mixed_script('word')} AS mixed, {S.script_guess('word')} AS script, count(*) AS n FROM w GROUP BY ALL""")
def word_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3 PRJ3 over distinct words."""
    w = C.document_words(C.table(spark, sf_dir, "documents")).select("word").distinct()
    return w.groupBy(T.is_mixed_script(F.col("word")).alias("mixed"), T.script_guess(F.col("word")).alias("script")).agg(n())


@query(f"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), d AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
  SELECT CASE WHEN {S.has('ch', chr(92)+'p{Cyrillic}')} THEN 'Cyrillic' WHEN {S.has('ch', chr(92)+'p{Arabic}')} THEN 'Arabic' WHEN {S.has('ch', chr(92)+'p{Greek}')} THEN 'Greek'
    WHEN {S.has('ch', chr(92)+'p{Hiragana}')} THEN 'Hiragana' WHEN {S.has('ch', chr(92)+'p{Katakana}')} THEN 'Katakana' WHEN {S.has('ch', chr(92)+'p{Han}')} THEN 'CJK'
    WHEN ord(ch) < 128 THEN 'Latin' ELSE 'other' END AS script, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL""")
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2: characters by script label; each distinct character is labelled once."""
    chars = C.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(n())
    return chars.groupBy(T.script_label(F.col("ch")).alias("script")).agg(F.sum("n").alias("n"))


@query(f"""WITH {S.LINES}, {S.PROTECTED} SELECT doc_id, line_no, s, e FROM protected""")
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1 FN2 WIN4: merged protected spans of every line, with code-point offsets. No shuffle."""
    rows = C.lines(C.table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.explode(T.protected_spans(F.col("text"))).alias("x"))
    return rows.select("doc_id", "line_no", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


@query(f"""WITH u AS (SELECT page_id, unnest({S.spans('url', X.URL)}) AS x, url FROM pages)
  SELECT page_id, x.s AS s, x.e AS e, substring(url, x.s + 1, x.e - x.s) AS token FROM u""")
def url_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1 FN2 on page addresses."""
    rows = C.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(T.match_spans(F.col("url"), X.URL)).alias("x"))
    return rows.select("page_id", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.substring("url", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("token"))


@query(f"""WITH {S.WORDS}, w AS (SELECT DISTINCT word FROM words), s AS (SELECT word, {S.spans('word', X.BLOCKED_CUT)} AS m FROM w)
  SELECT length(word) AS chars, len(m) AS marks, count(*) AS n FROM s GROUP BY ALL""")
def blocked_cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3: words by length and number of marks and joiners."""
    w = C.document_words(C.table(spark, sf_dir, "documents")).select("word").distinct()
    return w.groupBy(F.length("word").cast("long").alias("chars"), F.size(T.match_spans(F.col("word"), X.BLOCKED_CUT)).cast("long").alias("marks")).agg(n())


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length_grapheme(text) AS BIGINT) AS graphemes, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def grapheme_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5: code points, grapheme clusters and bytes."""
    t = F.col("text")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.size(T.graphemes(t)).cast("long").alias("graphemes"), F.octet_length(t).cast("long").alias("bytes"))


@query(f"""WITH {S.WORDS}, w AS (SELECT word, count(*) AS n FROM words GROUP BY word),
  g AS (SELECT k, substring(word, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS gram, n FROM w, (SELECT unnest([2, 3, 4]) AS k) o, LATERAL (SELECT unnest(range(1, length(word) - k + 2)) AS i) p)
  SELECT CAST(k AS INTEGER) AS k, gram, CAST(sum(n) AS BIGINT) AS n, count(*) AS types FROM g GROUP BY k, gram""")
def char_ngrams_234(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: character n-grams of words, weighted by how often the word occurs."""
    w = C.word_counts(C.table(spark, sf_dir, "documents"), by=())
    grams = w.select("n", F.explode(T.char_ngrams(F.col("word"))).alias("gram"))
    return grams.groupBy(F.length("gram").alias("k"), "gram").agg(F.sum("n").alias("n"), n("types"))


@query(f"""WITH p AS (SELECT unnest(regexp_extract_all(html, {S.q(X.IDENTIFIER)})) AS ident FROM pages), d AS (SELECT ident, count(*) AS n FROM p GROUP BY ident)
  SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n * len(regexp_extract_all(ident, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|_'))) AS DOUBLE) / sum(n), 6) AS mean_pieces FROM d""")
def identifier_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: mean pieces of identifiers in markup, under a case-splitting tokenizer; distinct ones are split once."""
    d = C.table(spark, sf_dir, "pages").select(F.explode(T.words(F.col("html"), X.IDENTIFIER)).alias("ident")).groupBy("ident").agg(n())
    pieces = F.size(T.words(F.col("ident"), "[A-Z]?[a-z]+|[A-Z]+|[0-9]+|_"))
    return d.agg(n("types"), F.sum("n").alias("n"), F.round(F.coalesce(F.sum(F.col("n") * pieces) / F.sum("n"), F.lit(0.0)), 6).alias("mean_pieces"))


@query(f"""WITH {S.LINES}, t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(text, {S.q(PIECES)})) AS tok, unnest(range(0, len(regexp_extract_all(text, {S.q(PIECES)})))) AS pos FROM lines),
  m AS (SELECT *, {S.punct_only('tok')} AS p FROM t),
  d AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS before FROM m)
  SELECT doc_id, count(*) AS tokens, count(*) FILTER (NOT (p AND coalesce(before, false))) AS kept FROM d GROUP BY doc_id""")
def clean_junk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: tokens before and after repeated punctuation is dropped. After punctuation that was dropped the last one kept is
    punctuation too, so a lag says the same for tokens of one mark each."""
    toks = C.lines(C.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), T.words(F.col("text"), PIECES).alias("tokens"))
    rows = D.kept_counts(toks).filter("tokens > 0")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"))


@query()
def merge_cjk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6 on token runs of every document (fold; tested against a restatement)."""
    toks = C.table(spark, sf_dir, "documents").select("doc_id", T.TOKENIZERS["words_marks"](F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("before"), F.size(T.merge_cjk(F.col("toks"))).alias("after"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, CAST(('0x' || substring(md5(conv_id || ':' || turn), 1, 8)) AS BIGINT) AS seed FROM conversations),
  p AS (SELECT conv_id, turn, text AS original, unnest(CASE WHEN length(text) > 1 THEN [
      substring(text, 1, seed % (length(text) - 1)) || substring(text, seed % (length(text) - 1) + 2, 1) || substring(text, seed % (length(text) - 1) + 1, 1) || substring(text, seed % (length(text) - 1) + 3),
      substring(text, 1, seed % length(text)) || substring(text, seed % length(text) + 2), translate(text, 'aeiouc', 'áéíóúç')] ELSE [translate(text, 'aeiouc', 'áéíóúç')] END) AS p FROM t),
  d AS (SELECT abs(len(regexp_extract_all(original, {S.q(X.WORD)})) - len(regexp_extract_all(p, {S.q(X.WORD)}))) AS diff FROM p)
  SELECT count(*) AS n, round(avg(diff), 6) AS stability FROM d""")
def perturbation_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21 AGG19: mean change of the token count under swap, deletion and confusables."""
    t = C.table(spark, sf_dir, "conversations")
    seed = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "turn")), 1, 8), 16, 10).cast("long")
    p = t.select(F.col("text").alias("original"), F.explode(T.perturbations(F.col("text"), seed)).alias("p"))
    diff = F.abs(F.size(T.words(F.col("original"))) - F.size(T.words(F.col("p"))))
    return p.agg(n(), F.round(F.avg(diff), 6).alias("stability"))


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, {S.q(X.WORD)}) AS w FROM conversations),
  s AS (SELECT conv_id, turn, w, unnest(range(0, greatest(len(w) - 32, 0), 16)) AS start FROM t)
  SELECT conv_id, turn, CAST(start AS INTEGER) AS start, array_to_string(list_slice(w, start + 1, start + 33), ' ') AS tokens FROM s""")
def lm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: windows of B + 1 tokens, B = 32, at a stride of B / 2."""
    b = 32
    t = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    starts = F.when(F.size("w") > b, F.sequence(F.lit(0), F.size("w") - b - 1, F.lit(b // 2)))
    rows = t.select("conv_id", "turn", "w", F.explode(starts).alias("start"))
    return rows.select("conv_id", "turn", "start", F.array_join(F.slice("w", F.col("start") + 1, F.lit(b + 1)), " ").alias("tokens"))


@query(f"""WITH {S.LINES}, t AS (SELECT doc_id, line_no, string_split_regex(text, {S.q(X.WORD)}) AS g, list_append(regexp_extract_all(text, {S.q(X.WORD)}), NULL) AS w FROM lines),
  u AS (SELECT doc_id, line_no, unnest(range(0, len(g))) AS i, length(unnest(g)) AS gap, length(unnest(w)) AS m FROM t),
  c AS (SELECT doc_id, m, sum(gap) OVER o + coalesce(sum(m) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM u WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, count(*) AS tokens, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(s + m) AS BIGINT) AS ends FROM c WHERE m IS NOT NULL GROUP BY doc_id""")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: tokens found again in their line from a running cursor; sums of the offsets."""
    t = C.lines(C.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", T.words(F.col("text")).alias("tokens"))
    found = E.token_offsets(t).select(F.col("id").alias("doc_id"), F.explode("spans").alias("x"))
    return found.groupBy("doc_id").agg(n("tokens"), F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


@query(rf"""SELECT doc_id, CAST(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS BIGINT) AS ascii_chars, lower(left({S.strip('text')}, 8)) AS head FROM documents""")
def ascii_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7: ASCII part of a key normalisation."""
    t = F.col("text")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.length(T.ascii_strip(t)).cast("long").alias("ascii_chars"), F.lower(F.substring(T.strip(t), 1, 8)).alias("head"))


@query()
def nfc_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7: NFC and casefold of distinct words by an Arrow function, as Spark has neither."""
    from corpuslab.functions.unicode import nfc_casefold as fold

    w = C.document_words(C.table(spark, sf_dir, "documents")).select("word").distinct()
    return w.select("word", fold(F.col("word")).alias("key")).groupBy("key").agg(n("spellings"))
