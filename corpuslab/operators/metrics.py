"""Metrics of segmentations, distributions and agreements, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.stats import placed, ranked

EPS = 1e-12


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(empty)


def compression(sized: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """sized(..., chars, toks) -> characters a token and back for each grouping set, in one pass."""
    cols = sorted({c for s in sets for c in s})
    g = sized.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    out = g.agg(F.sum("chars").alias("chars"), F.sum("toks").alias("toks"))
    cpt = ratio(F.col("chars"), F.col("toks"))
    return out.select(*cols, "chars", "toks", cpt.alias("cpt"), F.when(cpt > 0, 1 / cpt).otherwise(0.0).alias("tpc"))


def zipf_grid(low: float = 0.5, high: float = 2.0, steps: int = 30) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def zipf_divergence(counts: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """counts(word, n) -> (alpha, divergence) of the best exponent; the first of equals. Each type meets the 30 exponents
    in an array, so no row is multiplied by a join."""
    alphas = alphas or zipf_grid()
    grid = F.array(*[F.lit(a) for a in alphas])
    r = ranked(counts, "word").select("n", "rank")
    # KL = sum p ln(p + e) - sum p ln(r^-a / Z + e): Z first, then the sum
    z = r.select(F.posexplode(F.transform(grid, lambda a: F.pow(F.col("rank").cast("double"), -a))).alias("i", "w")).groupBy("i").agg(F.sum("w").alias("z"))
    total = r.agg(F.sum("n").alias("total"))
    norms = z.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda x: x["z"]).alias("zs")).crossJoin(total)  # one row
    p = F.col("n") / F.col("total")
    terms = r.crossJoin(F.broadcast(norms)).select(F.posexplode(F.transform(grid, lambda a, i: p * (F.log(p + EPS) - F.log(F.pow(F.col("rank").cast("double"), -a) / F.get("zs", i) + EPS)))).alias("i", "t"))
    by_alpha = terms.groupBy("i").agg(F.sum("t").alias("divergence"))
    best = by_alpha.orderBy(F.round("divergence", 12), "i").limit(1)
    return best.select(F.get(grid, F.col("i")).alias("alpha"), "divergence")


def jensen_shannon(shares: DataFrame) -> DataFrame:
    """shares(p, q): one row a group."""
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: x * (F.log(x + EPS) - F.log(m + EPS))
    return shares.agg((0.5 * F.sum(term(F.col("p"))) + 0.5 * F.sum(term(F.col("q")))).alias("js"))


def distribution(counts: DataFrame, rare: int = 100) -> DataFrame:
    """counts(word, n) -> entropy (nats), gini as coded in the metric's definition, share of rare types. The ascending rank
    V + 1 - i is the descending one."""
    r = ranked(counts, "word")
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    f = F.col("n") / F.col("total")
    rows = r.crossJoin(F.broadcast(totals))
    weight = F.col("rank") / F.greatest(F.col("types"), F.lit(1))
    return rows.agg(
        F.first("types").alias("types"),
        (-F.sum(f * F.log(f + EPS))).alias("entropy"),
        (1 - F.sum(2 / F.greatest(F.col("types"), F.lit(1)) * weight * f)).alias("gini"),
        F.avg((F.col("n") <= rare).cast("double")).alias("rare_type_fraction"),
    )


def fragmentation_curve(words: DataFrame, buckets: int = 10) -> DataFrame:
    """words(word, n, pieces) -> (bucket, mean pieces) by falling frequency. Buckets hold types // buckets words; the rest is left out."""
    size = F.greatest(F.floor(F.col("types") / buckets), F.lit(1))
    r = ranked(words, "word").crossJoin(F.broadcast(words.agg(F.count("*").alias("types"))))
    r = r.withColumn("bucket", (F.floor((F.col("rank") - 1) / size) + 1).cast("int")).filter(F.col("bucket") <= buckets)
    return r.groupBy("bucket").agg(F.avg("pieces").alias("fragmentation"))


def boundary_counts(gold: Column, pred: Column) -> dict[str, Column]:
    """tp, fp, fn of two boundary sets; a null prediction misses all."""
    none = F.array().cast("array<int>")
    p = F.coalesce(pred, none)
    return {"tp": F.size(F.array_intersect(gold, p)), "fp": F.size(F.array_except(p, gold)), "fn": F.size(F.array_except(gold, p))}


def micro_f1(rows: DataFrame, *by: str) -> DataFrame:
    """rows(by..., tp, fp, fn): sums first."""
    s = rows.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("words"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(*by, "words", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro_f1(rows: DataFrame, *by: str) -> DataFrame:
    """Means of each word's values; an empty prediction has precision 1, an empty gold recall 1."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return rows.select(*by, p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f")).groupBy(*by).agg(F.count("*").alias("words"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def floored_f1(rows: DataFrame, *by: str) -> DataFrame:
    """rows(by..., tp, n_pred, n_gold): sums in which a word counts at least one boundary on either side."""
    s = rows.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum(F.greatest("n_pred", F.lit(1))).alias("dp"), F.sum(F.greatest("n_gold", F.lit(1))).alias("dr"))
    p, r = F.col("tp") / F.greatest("dp", F.lit(1)), F.col("tp") / F.greatest("dr", F.lit(1))
    return s.select(*by, p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-8))).alias("f1"))


def covering(spans: Column, start: Column, end: Column) -> Column:
    """Spans that overlap [start, end)."""
    return F.filter(spans, lambda s: ~((s["e"] <= start) | (s["s"] >= end)))


def coverage(segments: DataFrame, by: str = "type") -> DataFrame:
    """segments(type, start, end, spans): how tokens meet segments, by type and over all (_aggregate), by rollup."""
    rows = segments.withColumn("c", covering(F.col("spans"), F.col("start"), F.col("end")))
    exact = (F.size("c") > 0) & (F.get("c", 0)["s"] == F.col("start")) & (F.element_at("c", -1)["e"] == F.col("end"))
    rows = rows.select(by, F.size("c").alias("k"), F.coalesce(exact, F.lit(False)).alias("x"))
    one = (F.col("x") & (F.col("k") == 1)).cast("double")
    out = rows.rollup(by).agg(F.count("*").alias("total_segments"), F.avg(F.col("x").cast("double")).alias("coverage_rate"), F.avg(one).alias("single_token_rate"), F.avg("k").alias("avg_tokens_per_segment"))
    return out.withColumn(by, F.coalesce(by, F.lit("_aggregate")))


def pair_consistency(pairs: DataFrame, *by: str) -> DataFrame:
    """pairs(by..., a, b): token counts of source and target."""
    d, x = F.abs(F.col("a") - F.col("b")), F.when(F.col("b") > 0, F.col("a") / F.col("b"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg("a").alias("avg_source_tokens"), F.avg("b").alias("avg_target_tokens"), F.avg(d).alias("avg_abs_token_diff"), F.percentile(d, F.lit(0.5)).alias("median_abs_token_diff"),
        F.max(d).alias("max_abs_token_diff"), F.avg((d <= 1).cast("double")).alias("near_match_rate"), F.avg((d == 0).cast("double")).alias("perfect_match_rate"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("length_ratio_mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("length_ratio_stdev"),
    )


def average_ranks(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """Average ranks with ties: the middle of the places of equal values in a global order by group and value, less the places before
    the group. No task holds a group or the rows of a value."""
    order = placed(rows.select(*by, value).filter(F.col(value).isNotNull()).withColumn("__r", F.xxhash64(F.monotonically_increasing_id())), *by, value, "__r")
    middle = order.groupBy(*by, value).agg(((F.min("rank") + F.max("rank")) / 2).alias("__m"))
    start = order.groupBy(*by).agg(F.min("rank").alias("__s"))
    keys = {b: f"__{b}" for b in (*by, value)}
    same = lambda cols: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(keys[c])) for c in cols], F.lit(True))
    out = rows.join(middle.withColumnsRenamed(keys), same((*by, value)), "left").drop(*keys.values())
    if by:
        out = out.join(start.withColumnsRenamed(keys), same(by), "left").drop(*keys.values())
    else:
        out = out.withColumn("__s", F.lit(1))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.col("__m") - F.col("__s") + 1)).drop("__m", "__s")


def correlations(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson, and Spearman by average ranks."""
    r = average_ranks(average_ranks(rows, a, "__ra", *by), b, "__rb", *by)
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("__ra", "__rb").alias("spearman"))


def combined(metrics: DataFrame) -> DataFrame:
    """metrics(label, lang, metric, value) -> (label, metric, value): keys that count are summed, the others averaged."""
    counts = F.col("metric").rlike("(_evaluated|_count|pairs)$")
    return metrics.groupBy("label", "metric").agg(F.when(F.first(counts), F.sum("value")).otherwise(F.avg("value")).alias("value"))


def weighted(metrics: DataFrame, weight: str, *values: str) -> DataFrame:
    """Means weighted by a count column."""
    total = F.sum(weight)
    return metrics.agg(total.alias(weight), *[ratio(F.sum(F.col(v) * F.col(weight)), total).alias(v) for v in values])


def idf(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs(id, word) occurrences -> (word, df, idf): max(1, log10(N / df))."""
    seen = docs.select(id_col, "word").distinct()
    total = seen.select(id_col).distinct().agg(F.count("*").alias("__n"))
    df = seen.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("word", "df", F.greatest(F.lit(1.0), F.log10(F.col("__n") / F.col("df"))).alias("idf"))
