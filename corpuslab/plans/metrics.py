"""Queries over metrics. Tokenizers under test are expressions over text (functions.text.TOKENIZERS) and a vowel-group splitter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T
from corpuslab.operators import evaluate as E
from corpuslab.operators import gold as G
from corpuslab.operators import metrics as M
from corpuslab.operators.experiments import expand_grid
from corpuslab.plans import base as S
from corpuslab.plans.stats import AFFIXES
from corpuslab.sources import corpus as C
from corpuslab.sources.shared import materialise

QUERIES, SQL = {}, {}
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüAEIOUYÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ"
SYLLABLES = f"[^{VOWELS}]*[{VOWELS}]+|[^{VOWELS}]+"  # covers any text without gaps


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def sql_f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


WS = f"list_filter(string_split_regex(text, {S.q(S.SPACES)}), lambda x: x <> '')"


@query(f"""WITH s AS (SELECT lang, length(text) AS chars, len({WS}) AS toks FROM documents)
  SELECT lang, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(toks) AS BIGINT) AS toks, round(CAST(sum(chars) AS DOUBLE) / sum(toks), 6) AS cpt, round(CAST(sum(toks) AS DOUBLE) / sum(chars), 6) AS tpc
  FROM s GROUP BY GROUPING SETS ((), (lang))""")
def cpt_tpc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14 AGG15: characters a token, over all and by language, in one pass."""
    t = F.col("text")
    sized = _docs(spark, sf_dir).select("lang", F.length(t).alias("chars"), F.size(T.TOKENIZERS["whitespace"](t)).alias("toks"))
    return rounded(M.compression(sized, (), ("lang",)), "cpt", "tpc")


@query(f"""WITH s AS (SELECT source, length(text) AS chars, len(regexp_extract_all(text, {S.q(X.WORD)})) AS toks FROM documents)
  SELECT source, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(toks) AS BIGINT) AS toks, round(CAST(sum(chars) AS DOUBLE) / sum(toks), 6) AS cpt FROM s GROUP BY source""")
def domain_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15 by domain (source)."""
    t = F.col("text")
    sized = _docs(spark, sf_dir).select("source", F.length(t).alias("chars"), F.size(T.words(t)).alias("toks"))
    return rounded(M.compression(sized, ("source",)).select("source", "chars", "toks", "cpt"), "cpt")


@query(f"""WITH s AS (SELECT length(text) AS chars, len({WS}) AS w, len(regexp_extract_all(text, {S.q(SYLLABLES)})) AS t FROM documents)
  SELECT round(CAST(sum(t) AS DOUBLE) / sum(chars), 6) AS tpc, round(CAST(sum(t) AS DOUBLE) / sum(w), 6) AS tpw, round((CAST(sum(w) AS DOUBLE) / sum(chars)) / (CAST(sum(t) AS DOUBLE) / sum(chars)), 6) AS context_gain FROM s""")
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20 FN22: tokens a character and a word; context gained against whitespace tokens."""
    t = F.col("text")
    s = _docs(spark, sf_dir).select(F.length(t).alias("c"), F.size(T.TOKENIZERS["whitespace"](t)).alias("w"), F.size(T.words(t, SYLLABLES)).alias("t"))
    s = s.agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("t").alias("t"))
    tpc = F.col("t") / F.greatest("c", F.lit(1))
    return rounded(s.select(tpc.alias("tpc"), (F.col("t") / F.greatest("w", F.lit(1))).alias("tpw"), M.ratio(F.col("w") / F.col("c"), tpc).alias("context_gain")), "tpc", "tpw", "context_gain")


@query(f"""WITH {S.WORDS}, c AS (SELECT word, count(*) AS n FROM words GROUP BY word), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c),
  a AS (SELECT i, 0.5 + 1.5 * i / 29 AS alpha FROM (SELECT unnest(range(0, 30)) AS i)),
  z AS (SELECT i, alpha, sum(pow(rank, -alpha)) AS z FROM r, a GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c),
  k AS (SELECT i, alpha, sum(n / total * (ln(n / total + 1e-12) - ln(pow(rank, -alpha) / z + 1e-12))) AS d FROM r, z, t GROUP BY ALL)
  SELECT round(alpha, 6) AS alpha, round(d, 6) AS divergence FROM k ORDER BY round(d, 12), i LIMIT 1""")
def zipf_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17 WIN2."""
    return rounded(M.zipf_divergence(C.word_counts(_docs(spark, sf_dir), by=())), "alpha", "divergence")


@query(f"""WITH s AS (SELECT lang, CAST(sum(length(text)) AS DOUBLE) AS c, CAST(sum(len({WS})) AS DOUBLE) AS t FROM documents GROUP BY lang),
  p AS (SELECT c / sum(c) OVER () AS p, t / sum(t) OVER () AS q FROM s)
  SELECT round(0.5 * sum(p * (ln(p + 1e-12) - ln((p + q) / 2 + 1e-12))) + 0.5 * sum(q * (ln(q + 1e-12) - ln((p + q) / 2 + 1e-12))), 9) AS js FROM p""")
def token_allocation_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: divergence between the languages' shares of characters and of tokens."""
    t = F.col("text")
    s = _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.length(t)).alias("c"), F.sum(F.size(T.TOKENIZERS["whitespace"](t))).alias("t"))
    totals = s.agg(F.sum("c").alias("tc"), F.sum("t").alias("tt"))
    shares = s.crossJoin(F.broadcast(totals)).select((F.col("c") / F.col("tc")).alias("p"), (F.col("t") / F.col("tt")).alias("q"))
    return M.jensen_shannon(shares).select(F.round("js", 9).alias("js"))


@query(f"""WITH {S.WORDS}, c AS (SELECT word, count(*) AS n FROM words GROUP BY word),
  r AS (SELECT len(regexp_extract_all(word, {S.q(SYLLABLES)})) AS pieces, row_number() OVER (ORDER BY n DESC, word) AS rank, count(*) OVER () AS types FROM c),
  b AS (SELECT pieces, CAST((rank - 1) // greatest(types // 10, 1) + 1 AS INTEGER) AS bucket FROM r)
  SELECT bucket, round(avg(pieces), 6) AS fragmentation FROM b WHERE bucket <= 10 GROUP BY bucket""")
def fragmentation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33."""
    w = C.word_counts(_docs(spark, sf_dir), by=()).withColumn("pieces", F.size(T.words(F.col("word"), SYLLABLES)))
    return rounded(M.fragmentation_curve(w), "fragmentation")


@query(f"""WITH {S.WORDS}, c AS (SELECT word, count(*) AS n FROM words GROUP BY word), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(*) AS v FROM c),
  r AS (SELECT n, total, v, n / total AS f, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c, t)
  SELECT any_value(v) AS types, round(-sum(f * ln(f + 1e-12)), 6) AS entropy, round(1 - sum(2.0 / v * (CAST(rank AS DOUBLE) / v) * f), 6) AS gini, round(avg(CASE WHEN n <= 100 THEN 1.0 ELSE 0.0 END), 6) AS rare_type_fraction FROM r""")
def entropy_gini_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21 WIN2."""
    return rounded(M.distribution(C.word_counts(_docs(spark, sf_dir), by=())), "entropy", "gini", "rare_type_fraction")


# ---- rule-made gold --------------------------------------------------------------------------------

GOLD = f"""{S.WORDS}, {AFFIXES}, w AS (SELECT DISTINCT lang, word FROM words),
  p AS (SELECT w.lang, word, max(length(affix)) AS p FROM w JOIN affixes a ON a.lang = w.lang AND kind = 'pre' AND starts_with(lower(word), affix) AND length(lower(word)) > length(affix) GROUP BY ALL),
  x AS (SELECT w.lang, word, max(length(affix)) AS s FROM w JOIN affixes a ON a.lang = w.lang AND kind = 'suf' AND ends_with(lower(word), affix) AND length(lower(word)) > length(affix) GROUP BY ALL),
  g1 AS (SELECT w.lang, w.word, length(w.word) AS n, CASE WHEN length(w.word) - coalesce(p, 0) >= 3 THEN coalesce(p, 0) ELSE 0 END AS pre, coalesce(s, 0) AS s
    FROM w LEFT JOIN p ON p.lang = w.lang AND p.word = w.word LEFT JOIN x ON x.lang = w.lang AND x.word = w.word),
  g2 AS (SELECT *, CASE WHEN n - pre - s >= 3 THEN s ELSE 0 END AS suf FROM g1),
  gold AS (SELECT lang, word, n, pre, suf, list_distinct(list_filter([pre, n - suf], lambda k: k > 0 AND k < n)) AS b FROM g2)"""
PIECES = f"list_transform(regexp_extract_all(word, {S.q(SYLLABLES)}), lambda t: length(t))"
PRED = f"""{GOLD}, pl AS (SELECT *, {PIECES} AS lens FROM gold),
  pred AS (SELECT *, list_transform(range(1, len(lens)), lambda i: list_sum(list_slice(lens, 1, i))) AS q FROM pl),
  counts AS (SELECT lang, len(list_intersect(b, q)) AS tp, len(q) - len(list_intersect(b, q)) AS fp, len(b) - len(list_intersect(b, q)) AS fn, len(q) AS n_pred, len(b) AS n_gold FROM pred)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted boundaries of distinct words."""
    w = C.document_words(_docs(spark, sf_dir)).select("lang", "word").distinct()
    g = G.rule_gold(spark, w).withColumn("spans", T.token_spans(T.words(F.col("word"), SYLLABLES)))
    return g.withColumn("pred", F.transform(F.slice("spans", F.lit(1), F.size("spans") - 1), lambda s: s["e"]))


@query(f"""WITH {PRED}, s AS (SELECT lang, count(*) AS words, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY lang),
  m AS (SELECT lang, words, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM s)
  SELECT lang, words, round(p, 6) AS precision, round(r, 6) AS recall, round({sql_f1('p', 'r')}, 6) AS f1 FROM m""")
def boundary_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23 SET2 EVL1: rule-made gold against vowel groups."""
    g = _predicted(spark, sf_dir)
    return rounded(M.micro_f1(g.select("lang", *[c.alias(k) for k, c in M.boundary_counts(F.col("boundaries"), F.col("pred")).items()]), "lang"), "precision", "recall", "f1")


@query(f"""WITH {PRED}, m AS (SELECT lang, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 1 END AS r FROM counts)
  SELECT lang, count(*) AS words, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg({sql_f1('p', 'r')}), 6) AS f1 FROM m GROUP BY lang""")
def boundary_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24."""
    g = _predicted(spark, sf_dir)
    return rounded(M.macro_f1(g.select("lang", *[c.alias(k) for k, c in M.boundary_counts(F.col("boundaries"), F.col("pred")).items()]), "lang"), "precision", "recall", "f1")


SEGS = f"""{GOLD}, segs AS (SELECT lang, word, unnest(list_filter([{{'s': 0, 'e': pre, 't': 'prefix'}}, {{'s': pre, 'e': n - suf, 't': 'stem'}}, {{'s': n - suf, 'e': n, 't': 'suffix'}}], lambda x: x.e > x.s)) AS x FROM gold),
  lens AS (SELECT lang, word, {PIECES} AS l FROM gold),
  toks AS (SELECT lang, word, list_transform(range(1, len(l) + 1), lambda i: {{'s': list_sum(list_slice(l, 1, i)) - l[i], 'e': list_sum(list_slice(l, 1, i))}}) AS t FROM lens),
  met AS (SELECT x.t AS type, x.s AS s, x.e AS e, list_filter(t, lambda k: NOT (k.e <= x.s OR k.s >= x.e)) AS c FROM segs JOIN toks USING (lang, word)),
  hit AS (SELECT type, len(c) AS k, coalesce(c[1].s = s AND c[-1].e = e, false) AS x FROM met)"""


@query(f"""WITH {SEGS} SELECT coalesce(type, '_aggregate') AS type, count(*) AS total_segments, round(avg(CAST(x AS INTEGER)), 6) AS coverage_rate, round(avg(CASE WHEN x AND k = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_token_rate,
  round(avg(k), 6) AS avg_tokens_per_segment FROM hit GROUP BY ROLLUP (type)""")
def morpheme_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25 JN18: rollup over the segment type."""
    g = _predicted(spark, sf_dir)
    segs = G.rule_segments(g).join(g.select("lang", "word", "spans"), ["lang", "word"])
    return rounded(M.coverage(segs), "coverage_rate", "single_token_rate", "avg_tokens_per_segment")


@query(f"""WITH {PRED}, {SEGS.split('segs AS', 1)[0] and ''} seg2 AS (SELECT lang, word, unnest(list_filter([{{'s': 0, 'e': pre}}, {{'s': pre, 'e': n - suf}}, {{'s': n - suf, 'e': n}}], lambda x: x.e > x.s)) AS x FROM gold),
  t2 AS (SELECT lang, word, list_transform(range(1, len(lens) + 1), lambda i: {{'s': list_sum(list_slice(lens, 1, i)) - lens[i], 'e': list_sum(list_slice(lens, 1, i))}}) AS t FROM pl),
  o AS (SELECT lang, word, avg(len(list_filter(t, lambda k: greatest(k.s, x.s) < least(k.e, x.e)))) AS spm FROM seg2 JOIN t2 USING (lang, word) GROUP BY lang, word),
  f AS (SELECT lang, CAST(sum(tp) AS DOUBLE) / sum(greatest(n_pred, 1)) AS p, CAST(sum(tp) AS DOUBLE) / sum(greatest(n_gold, 1)) AS r FROM counts GROUP BY lang)
  SELECT f.lang AS lang, round(avg(spm), 6) AS spm, round(any_value(p), 6) AS precision, round(any_value(r), 6) AS recall, round(any_value(2 * p * r / greatest(p + r, 1e-8)), 6) AS f1 FROM o JOIN f USING (lang) GROUP BY f.lang""")
def spm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: tokens a morpheme, and boundary scores with floored denominators."""
    g = _predicted(spark, sf_dir)
    segs = F.transform(G.morphemes(F.col("word"), F.col("boundaries")), F.length)
    ends = T.let(segs, lambda n: F.transform(n, lambda k, i: F.struct((F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, b: a + b)).alias("s"), k.alias("k"))))
    per = F.transform(ends, lambda m: F.size(F.filter(F.col("spans"), lambda t: F.greatest(t["s"], m["s"]) < F.least(t["e"], m["s"] + m["k"]))))
    rows = g.select("lang", (F.aggregate(per, F.lit(0), lambda a, b: a + b) / F.size(per)).alias("spm"), F.size(F.array_intersect("boundaries", "pred")).alias("tp"), F.size("pred").alias("n_pred"), F.size("boundaries").alias("n_gold"))
    scores = M.floored_f1(rows, "lang")
    return rounded(rows.groupBy("lang").agg(F.avg("spm").alias("spm")).join(scores, "lang"), "spm", "precision", "recall", "f1")


@query(f"""WITH {GOLD} SELECT lang, count(*) AS words, round(100.0 * avg(CASE WHEN len(b) > 0 THEN 1 ELSE 0 END), 6) AS gold_coverage FROM gold GROUP BY lang""")
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31 JN13: percentage of distinct words with gold boundaries."""
    w = C.document_words(_docs(spark, sf_dir)).select("lang", "word").distinct()
    g = G.rule_gold(spark, w)
    return rounded(g.groupBy("lang").agg(F.count("*").alias("words"), (100 * F.avg((F.size("boundaries") > 0).cast("double"))).alias("gold_coverage")), "gold_coverage")


@query(f"""WITH {GOLD}, s AS (SELECT lang, 'prefix' AS kind, lower(left(word, pre)) AS affix FROM gold WHERE pre > 0 UNION ALL SELECT lang, 'suffix', lower(right(word, suf)) FROM gold WHERE suf > 0)
  SELECT lang, kind, affix, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2""")
def affix_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG32 SNK2: affixes of the gold segments."""
    w = C.document_words(_docs(spark, sf_dir)).select("lang", "word").distinct()
    return G.affix_inventory(G.rule_segments(G.rule_gold(spark, w)))


@query(f"""WITH {GOLD} SELECT lang, CASE WHEN pre > 0 AND suf > 0 THEN 'both' WHEN pre > 0 THEN 'prefixed' WHEN suf > 0 THEN 'suffixed' ELSE 'plain' END AS dataset, count(*) AS n FROM gold GROUP BY ALL""")
def gold_tree_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: the index of a gold tree, by language and dataset."""
    w = C.document_words(_docs(spark, sf_dir)).select("lang", "word").distinct()
    name = F.when((F.col("pre") > 0) & (F.col("suf") > 0), "both").when(F.col("pre") > 0, "prefixed").when(F.col("suf") > 0, "suffixed").otherwise("plain")
    return G.rule_gold(spark, w).groupBy("lang", name.alias("dataset")).agg(F.count("*").alias("n"))


# ---- pairs, probes, correlations -------------------------------------------------------------------

@query(f"""WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, {S.q(X.WORD)})) AS n FROM conversations),
  p AS (SELECT u.n AS a, v.n AS b, abs(u.n - v.n) AS d FROM t u JOIN t v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 AND u.role = 'user' AND v.role = 'assistant')
  SELECT count(*) AS pairs, round(avg(a), 6) AS avg_source_tokens, round(avg(b), 6) AS avg_target_tokens, round(avg(d), 6) AS avg_abs_token_diff, median(d) AS median_abs_token_diff, CAST(max(d) AS BIGINT) AS max_abs_token_diff,
    round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) AS near_match_rate, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS perfect_match_rate,
    round(coalesce(avg(CASE WHEN b > 0 THEN CAST(a AS DOUBLE) / b END), 0), 6) AS length_ratio_mean, round(coalesce(stddev_pop(CASE WHEN b > 0 THEN CAST(a AS DOUBLE) / b END), 0), 6) AS length_ratio_stdev FROM p""")
def parallel_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26 EVL2: token counts of a user's turn against those of the answer."""
    t = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    u = t.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("a"))
    pairs = u.join(t.filter("role = 'assistant'").select("conv_id", "turn", F.col("n").alias("b")), ["conv_id", "turn"])
    out = M.pair_consistency(pairs)
    return rounded(out, *[c for c in out.columns if c not in ("pairs", "max_abs_token_diff", "median_abs_token_diff")])


@query(f"""WITH p AS (SELECT item_id, text, regexp_extract(text, {S.q(X.WORD)}, 0) AS w FROM benchmark),
  m AS (SELECT item_id, text, CASE WHEN item_id % 5 = 0 THEN w || '#' ELSE w END AS span, CASE WHEN length(w) <= 3 THEN 'short' ELSE 'long' END AS feature FROM p),
  s AS (SELECT *, strpos(text, span) - 1 AS st, {S.spans('text', SYLLABLES)} AS t FROM m),
  c AS (SELECT feature, st >= 0 AS matched, len(list_filter(t, lambda k: st >= 0 AND NOT (k.e <= st OR k.s >= st + length(span)))) AS k FROM s)
  SELECT coalesce(feature, '_aggregate') AS feature, count(*) AS probes, round(avg(CAST(matched AS INTEGER)), 6) AS match_rate, round(coalesce(CAST(sum(k) FILTER (matched) AS DOUBLE) / nullif(count(*) FILTER (matched), 0), 0), 6) AS avg_tokens_per_span,
    round(avg(CASE WHEN matched AND k = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_token_rate FROM c GROUP BY ROLLUP (feature)""")
def probe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27 EVL5: spans of benchmark items under the vowel-group tokenizer; every fifth span is not to be found."""
    b = C.table(spark, sf_dir, "benchmark").withColumn("w", F.regexp_extract("text", X.WORD, 0))
    p = b.select("text", F.when(F.col("item_id") % 5 == 0, F.concat("w", F.lit("#"))).otherwise(F.col("w")).alias("span"), F.when(F.length("w") <= 3, "short").otherwise("long").alias("feature"))
    p = p.withColumn("at", F.call_function("locate", F.col("span"), F.col("text")) - 1)
    k = F.size(M.covering(T.match_spans(F.col("text"), SYLLABLES), F.col("at"), F.col("at") + F.length("span")))
    c = p.select("feature", (F.col("at") >= 0).alias("matched"), F.when(F.col("at") >= 0, k).otherwise(0).alias("k"))
    one = (F.col("matched") & (F.col("k") == 1)).cast("double")
    out = c.rollup("feature").agg(F.count("*").alias("probes"), F.avg(F.col("matched").cast("double")).alias("match_rate"), M.ratio(F.sum("k"), F.sum(F.col("matched").cast("int"))).alias("avg_tokens_per_span"), F.avg(one).alias("single_token_rate"))
    return rounded(out.withColumn("feature", F.coalesce("feature", F.lit("_aggregate"))), "match_rate", "avg_tokens_per_span", "single_token_rate")


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b FROM lineitem),
  k AS (SELECT *, (min(ra) OVER (PARTITION BY l_returnflag, a) + max(ra) OVER (PARTITION BY l_returnflag, a)) / 2.0 AS xa, (min(rb) OVER (PARTITION BY l_returnflag, b) + max(rb) OVER (PARTITION BY l_returnflag, b)) / 2.0 AS xb
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY a) AS ra, row_number() OVER (PARTITION BY l_returnflag ORDER BY b) AS rb FROM r))
  SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(xa, xb), 6) AS spearman FROM k GROUP BY l_returnflag""")
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30 WIN3: correlations with average ranks."""
    rows = C.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return rounded(M.correlations(rows, "a", "b", "l_returnflag"), "pearson", "spearman")


@query(f"""WITH {S.WORDS}, s AS (SELECT DISTINCT doc_id, word FROM words), n AS (SELECT count(DISTINCT doc_id) AS n FROM s)
  SELECT word, count(*) AS df, round(greatest(1.0, log10(CAST(any_value(n) AS DOUBLE) / count(*))), 6) AS idf FROM s, n GROUP BY word""")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG34."""
    return rounded(M.idf(C.document_words(_docs(spark, sf_dir))), "idf")


@query(f"""WITH t AS (SELECT lang, len({WS}) AS whitespace, len(regexp_extract_all(text, {S.q(X.WORD)})) AS words, len(regexp_extract_all(text, {S.q(SYLLABLES)})) AS syllables, length(text) AS chars FROM documents)
  SELECT lang, round(CAST(sum(whitespace) AS DOUBLE) / sum(chars), 6) AS whitespace, round(CAST(sum(words) AS DOUBLE) / sum(chars), 6) AS words, round(CAST(sum(syllables) AS DOUBLE) / sum(chars), 6) AS syllables FROM t GROUP BY lang""")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 EVL11 EVL12: the language by tokenizer table of tokens a character, pivoted from long metrics."""
    t = F.col("text")
    variants = {"whitespace": F.size(T.TOKENIZERS["whitespace"](t)), "words": F.size(T.words(t)), "syllables": F.size(T.words(t, SYLLABLES))}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.alias("n")) for k, c in variants.items()])).alias("x")
    long = _docs(spark, sf_dir).select("lang", F.length(t).alias("chars"), pairs).groupBy("lang", "x.label").agg((F.sum("x.n") / F.sum("chars")).alias("value"))
    return rounded(long.groupBy("lang").pivot("label", list(variants)).agg(F.first("value")), *variants)


@query(f"""WITH t AS (SELECT source AS label, lang, count(*) AS docs_evaluated, avg(len(regexp_extract_all(text, {S.q(X.WORD)}))) AS mean_tokens FROM documents GROUP BY ALL)
  SELECT label, 'docs_evaluated' AS metric, round(CAST(sum(docs_evaluated) AS DOUBLE), 6) AS value FROM t GROUP BY label UNION ALL SELECT label, 'mean_tokens', round(avg(mean_tokens), 6) FROM t GROUP BY label""")
def metric_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG28: across languages, counts are summed and other metrics averaged."""
    t = _docs(spark, sf_dir).groupBy(F.col("source").alias("label"), "lang").agg(F.count("*").cast("double").alias("docs_evaluated"), F.avg(F.size(T.words(F.col("text")))).alias("mean_tokens"))
    long = t.unpivot(["label", "lang"], ["docs_evaluated", "mean_tokens"], "metric", "value")
    return rounded(M.combined(long), "value")


@query(f"""WITH g AS (SELECT lang, 'gold' AS kind, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING count(*) >= 60),
  p AS (SELECT lang, 'parallel' AS kind, count(*) AS n FROM documents GROUP BY ALL), u AS (SELECT 0 AS priority, * FROM g UNION ALL SELECT 1, * FROM p)
  SELECT lang, kind, n FROM u WHERE priority = (SELECT min(priority) FROM u v WHERE v.lang = u.lang)""")
def evaluation_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL3 SRC11: gold where a language has enough, else the next source."""
    docs, labels = _docs(spark, sf_dir).select("doc_id", "lang"), C.table(spark, sf_dir, "labels").select("doc_id")
    g = docs.join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n")).filter("n >= 60").withColumn("kind", F.lit("gold"))
    p = docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("kind", F.lit("parallel"))
    return G.best_source([g, p], ("lang",)).select("lang", "kind", "n")


@query("""WITH a AS (SELECT unnest([0.5, 1.0, 2.0]) AS alpha), t AS (SELECT unnest([8, 14]) AS max_token_len), b AS (SELECT unnest([0, 1]) AS beta), r AS (SELECT unnest([1, 2]) AS run)
  SELECT 'base_combo' || row_number() OVER (PARTITION BY run ORDER BY alpha, max_token_len, beta) || '_run' || run AS name, CAST(alpha AS DOUBLE) AS alpha, CAST(max_token_len AS INTEGER) AS max_token_len, CAST(beta AS INTEGER) AS beta, CAST(run AS INTEGER) AS run FROM a, t, b, r""")
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP1: every combination of a parameter grid, repeated."""
    rows = expand_grid("base", {"alpha": [0.5, 1.0, 2.0], "max_token_len": [8, 14], "beta": [0, 1]}, repeat=2)
    return spark.createDataFrame([(r["name"], r["alpha"], r["max_token_len"], r["beta"], r["run"]) for r in rows], "name string, alpha double, max_token_len int, beta int, run int")


@query("""WITH d AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
  SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars FROM d WHERE rn <= 40""")
def first_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1 SRC1: the first 40 of each language (the loader's sampling operator)."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.length("text").cast("long").alias("chars"))
    return C.first_per_language(d, 40, "doc_id")


@query(f"""WITH {S.WORDS}, c AS (SELECT word, count(*) AS n FROM words GROUP BY word) SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) AS BIGINT) AS rank FROM c""")
def word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2 SRT7: a total order of types without gathering them in one task."""
    from corpuslab.operators.stats import ranked

    return ranked(C.word_counts(_docs(spark, sf_dir), by=()), "word")


@query(f"""WITH {S.WORDS}, a AS (SELECT DISTINCT word FROM words WHERE lang = 'en'), b AS (SELECT DISTINCT word FROM words WHERE lang <> 'en')
  SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'en only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
  UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def vocabulary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1 SET3 SET4 SET5: union, intersection and difference of vocabularies from one aggregate."""
    w = C.document_words(_docs(spark, sf_dir)).groupBy("word").agg(F.max(F.col("lang") == "en").alias("a"), F.max(F.col("lang") != "en").alias("b"))
    k = w.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("en only"), F.count("*").alias("either"))
    return k.unpivot([], ["both", "en only", "either"], "side", "n")


@query()
def sentence_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL4 WIN8 AGG23 AGG25: every line against rule-made gold of its words, cut into vowel groups; checked against plain Python in tests."""
    docs = _docs(spark, sf_dir)
    rows = C.lines(docs).select((F.col("doc_id") * (1 << 20) + F.col("line_no")).alias("id"), "lang", "text", F.regexp_extract_all("text", F.lit(SYLLABLES), F.lit(0)).alias("tokens"))
    gold = G.rule_gold(spark, C.document_words(docs).select("lang", "word").distinct())
    kinds = G.rule_segments(gold).groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("segments"))
    return rounded(E.sentence_scores(E.sentences(rows, gold.join(kinds, ["lang", "word"]).withColumn("line", F.xxhash64("word")))), "sentence_similarity", "boundary_f1", "boundary_precision", "boundary_recall", "morphological_score")


@query()
def word_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL1 UDF1 UDF4: the registered tokenizers and a Python one on all distinct words with rule-made gold."""
    gold = G.rule_gold(spark, C.document_words(_docs(spark, sf_dir)).select("lang", "word").distinct())
    kinds = G.rule_segments(gold).groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("segments"))
    rows = materialise(gold.join(kinds, ["lang", "word"]).select("lang", "word", "boundaries", "segments"), "gold")
    halves = E.batch_tokenizer(lambda text, lang: [text[: len(text) // 2], text[len(text) // 2 :]])
    found = [E.words(rows, t)[0].select(F.lit(name).alias("tokenizer"), "*") for name, t in (("characters", "characters"), ("whitespace", "whitespace"), ("halves", halves))]
    return rounded(reduce(DataFrame.unionByName, found), "precision", "recall", "f1")
