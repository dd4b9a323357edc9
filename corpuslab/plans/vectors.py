"""Queries over vectors: centroids, cosines, neighbours, alignment, token features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import vectors as V
from corpuslab.operators import align as AL
from corpuslab.operators import embed as E
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


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.as_doubles(F.col("embedding")).alias("vec"), "label")


UNIT = """raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  unit AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM raw)"""
COS = f"""{UNIT}, src AS (SELECT * FROM unit WHERE id % 2 = 0), tgt AS (SELECT * FROM unit WHERE id % 2 = 1),
  sims AS (SELECT s.id AS id, t.id AS nid, s.label AS ls, t.label AS lt, round(list_dot_product(s.u, t.u), 9) AS sim FROM src s, tgt t)"""


@query(f"""WITH {UNIT}, e AS (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM raw) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM e GROUP BY label, i""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: mean vectors by label, one component a row."""
    m = E.mean_vectors(_vecs(spark, sf_dir), "label")
    return m.select("label", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {UNIT} SELECT a.label AS label, (SELECT count(*) FROM unit c WHERE c.label = a.label) AS n, round(avg(list_dot_product(a.u, b.u)), 6) AS mean_cosine
  FROM unit a JOIN unit b ON a.label = b.label AND a.id <> b.id GROUP BY a.label""")
def within_class_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29 EVL8: mean cosine within a class, in closed form."""
    return E.cohesion(_vecs(spark, sf_dir), "label").withColumn("mean_cosine", F.round("mean_cosine", 6))


@query(f"""WITH {UNIT}, e AS (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM raw), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
  c AS (SELECT label, list(m ORDER BY i) AS p FROM m GROUP BY label)
  SELECT a.label AS a, b.label AS b, round(list_dot_product(a.p, b.p) / sqrt(list_dot_product(a.p, a.p) * list_dot_product(b.p, b.p)), 6) AS cosine FROM c a JOIN c b ON a.label < b.label""")
def cross_class_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17 EVL9 EVL10: cosines of class prototypes."""
    return E.cross_cosine(E.prototypes(_vecs(spark, sf_dir), "label"), "label").withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {UNIT}, s AS (SELECT a.id AS id, b.id AS nid, round(list_dot_product(a.u, b.u), 9) AS sim FROM unit a JOIN unit b ON a.id <> b.id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) AS INTEGER) AS rank FROM s) SELECT id, nid, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10""")
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3 JN16: ten nearest by cosine of every vector, exact, in blocks."""
    v = _vecs(spark, sf_dir).select("id", "vec")
    return AL.neighbours(v, v, 10, same=True).withColumn("sim", F.round("sim", 6))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vecs(spark, sf_dir)
    return v.filter("id % 2 = 0"), v.filter("id % 2 = 1")


@query(f"""WITH {COS}, rs AS (SELECT id, avg(sim) AS r FROM (SELECT id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) AS k FROM sims) WHERE k <= 10 GROUP BY id),
  rt AS (SELECT nid, avg(sim) AS r FROM (SELECT nid, sim, row_number() OVER (PARTITION BY nid ORDER BY sim DESC, id) AS k FROM sims) WHERE k <= 10 GROUP BY nid),
  c AS (SELECT id, nid, 2 * sim - rs.r - rt.r AS score FROM sims JOIN rs USING (id) JOIN rt USING (nid)) SELECT id, round(max(score), 5) AS score FROM c GROUP BY id""")
def csls_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT6 ITR22 EVL6: the best cross-domain similarity of every source over all targets."""
    a, b = _halves(spark, sf_dir)
    return AL.exact_csls(a, b).select("id", F.round("score", 5).alias("score"))


@query(f"""WITH {COS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) AS k FROM sims), f AS (SELECT id, min(k) FILTER (ls = lt AND k <= 10) AS first, bool_or(ls = lt) AS has FROM r GROUP BY id)
  SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS p_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS p_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS p_at_10 FROM f WHERE has""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4 SRT5 JN15: any target of the source's label among the first k."""
    a, b = _halves(spark, sf_dir)
    found = AL.neighbours(a, b, 10)
    right = found.join(a.select("id", "label"), "id").join(b.select(F.col("id").alias("nid"), F.col("label").alias("lt")), "nid").filter("label = lt").groupBy("id").agg(F.min("rank").alias("first"))
    has = a.join(b.select("label").distinct(), "label", "left_semi").select("id")  # sources with a target at all
    out = has.join(right, "id", "left").agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"p_at_{k}") for k in (1, 5, 10)])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {COS}, a AS (SELECT id, nid FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) AS k FROM sims) WHERE k = 1),
  b AS (SELECT id, nid FROM (SELECT id, nid, row_number() OVER (PARTITION BY nid ORDER BY sim DESC, id) AS k FROM sims) WHERE k = 1) SELECT * FROM a INTERSECT SELECT * FROM b""")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20 SET4: mutual nearest neighbours."""
    a, b = _halves(spark, sf_dir)
    return AL.mutual(a, b)


@query(f"""WITH {UNIT}, e AS (SELECT id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM raw), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), c AS (SELECT id, list(x - m ORDER BY i) AS v FROM e JOIN m USING (i) GROUP BY id)
  SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS centered_norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM c""")
def renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR25 FN19: centered vectors' norms, and the first component once scaled."""
    c = AL.renormalised(_vecs(spark, sf_dir), ("center",))
    return c.select("id", F.round(V.norm(F.col("vec")), 6).alias("centered_norm"), F.round(F.get(V.normalised(F.col("vec")), 0), 6).alias("first"))


@query()
def procrustes_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR21: the orthogonal map of even vectors onto the next odd ones; each source's cosine to its target after mapping."""
    a, b = _halves(spark, sf_dir)
    pairs = a.select("id", F.col("vec").alias("x")).join(b.select((F.col("id") - 1).alias("id"), F.col("vec").alias("y")), "id")
    dims = pairs.select(F.size("x")).first()[0]
    w = AL.procrustes(pairs, dims)
    mapped = AL.apply_map(pairs.withColumnRenamed("x", "vec"), w)
    return mapped.select("id", V.cosine(F.col("vec"), F.col("y")).alias("cosine"))


GRAMS = f"""{S.WORDS}, w AS (SELECT DISTINCT lang, word FROM words),
  x AS (SELECT lang, word, feat, count(*) AS x FROM (SELECT lang, word, substring(lower(word), CAST(i AS BIGINT), CAST(k AS BIGINT)) AS feat FROM w, (SELECT unnest([2, 3, 4]) AS k) o, LATERAL (SELECT unnest(range(1, length(lower(word)) - k + 2)) AS i) p) GROUP BY ALL),
  r AS (SELECT lang, word, sum(x) AS r FROM x GROUP BY ALL), c AS (SELECT feat, sum(x) AS c FROM x GROUP BY feat), t AS (SELECT CAST(sum(x) AS DOUBLE) AS t FROM x)"""


@query(f"""WITH {GRAMS} SELECT feat, count(*) AS words, round(sum(greatest(ln(greatest(x * t / (r * c), 1e-9)), 0)), 4) AS ppmi FROM x JOIN r USING (lang, word) JOIN c USING (feat), t GROUP BY feat""")
def ppmi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11 AGG12 M23: positive pointwise mutual information of words and n-grams, summed by n-gram."""
    w = C.document_words(C.table(spark, sf_dir, "documents")).select("lang", "word").distinct()
    return E.summed_ppmi(w).select("feat", "words", F.round("ppmi", 4).alias("ppmi"))


@query()
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR13 ITR14 SRT2: vectors of the 2,000 most frequent words (the encoder's cap) by factorised PPMI."""
    counts = C.word_counts(C.table(spark, sf_dir, "documents")).filter(F.length("word") > 1).withColumnRenamed("word", "tok")
    top = counts.orderBy(F.desc("n"), "lang", "tok").limit(2000).select("lang", "tok")
    m = E.ppmi(E.token_features(top), ("lang", "tok"))
    v = E.factorise(m, rank=16, most_features=400)
    return E.cohesion(v, "lang")
