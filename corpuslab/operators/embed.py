"""Token vectors: n-gram features, PPMI, convex factorisation, prototypes, intrinsic evaluation.

The token by feature matrix stays long and sparse. Only its feature Gram matrix (features are capped) and small solves
reach numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import vectors as V
from corpuslab.operators import affixes as A
from corpuslab.sources.shared import materialise

#: A side is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def token_features(tokens: DataFrame, orders: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """tokens(lang, tok) -> (lang, tok, feat, x): n-gram counts and affix flags."""
    grams = tokens.select("lang", "tok", F.explode(T.char_ngrams(F.lower("tok"), orders)).alias("feat"))
    spark = tokens.sparkSession
    table = A.affix_table(spark)
    flags = []
    for kind, mark in (("pre", "^pre:"), ("suf", "$suf:")):
        cut = tokens.select("lang", "tok", F.explode(A.ends(F.col("tok"), 12, kind)).alias("affix"))
        flags.append(cut.join(F.broadcast(table.filter(F.col("kind") == kind)), ["lang", "affix"]).select("lang", "tok", F.concat(F.lit(mark), "affix").alias("feat")))
    rows = grams.unionByName(flags[0]).unionByName(flags[1])
    return rows.groupBy("lang", "tok", "feat").agg(F.count("*").cast("double").alias("x"))


def ppmi(matrix: DataFrame, row: tuple[str, ...], col: str = "feat", x: str = "x") -> DataFrame:
    """(row..., col, x, ppmi): max(0, ln max(p_xy / (p_x p_y), 1e-9))."""
    rows = matrix.groupBy(*row).agg(F.sum(x).alias("__r"))
    cols = matrix.groupBy(col).agg(F.sum(x).alias("__c"))
    total = matrix.agg(F.sum(x).alias("__t"))
    j = matrix.join(rows, list(row)).join(cols, col).crossJoin(F.broadcast(total))
    value = F.log(F.greatest(F.col(x) * F.col("__t") / (F.col("__r") * F.col("__c")), F.lit(1e-9)))
    return j.select(*row, col, x, F.greatest(value, F.lit(0.0)).alias("ppmi"))


def summed_ppmi(words: DataFrame) -> DataFrame:
    """words(lang, word) distinct -> (feat, words, ppmi): ppmi of words and n-grams added up by n-gram. A word's n-grams are counted inside its row, so
    only the n-grams' own sums are moved."""
    words = words.select("lang", "word")
    grams = T.char_ngrams(F.lower("word"))
    rows = words.select(F.explode(T.gram_counts(grams)).alias("g"), F.size(grams).alias("r")).select("r", "g.feat", "g.x")
    # n-grams with the same x and r have the same value: all is told by this table
    alike = materialise(rows.groupBy("feat", "x", "r").agg(F.count("*").alias("n")), "alike")
    cols = materialise(alike.groupBy("feat").agg(F.sum(F.col("n") * F.col("x")).alias("c")), "features")
    n, total = cols.agg(F.count("*"), F.sum("c").cast("double")).first()
    value = F.log(F.greatest(F.col("x") * F.lit(total) / (F.col("r") * F.col("c")), F.lit(1e-9)))
    joined = alike.join(F.broadcast(cols) if n <= BROADCAST_ROWS else cols, "feat")
    return joined.groupBy("feat").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.greatest(value, F.lit(0.0))).alias("ppmi"))


def top_features(matrix: DataFrame, most: int) -> DataFrame:
    """The features of most tokens, numbered; `most` bounds the Gram matrix."""
    top = matrix.groupBy("feat").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feat").limit(most)
    return top.withColumn("f", F.row_number().over(W.orderBy(F.desc("n"), "feat")) - 1)  # `most` rows


def factorise(matrix: DataFrame, rank: int = 64, most_features: int = 2000, ridge: float = 1e-3) -> DataFrame:
    """matrix(lang, tok, feat, x, ppmi) -> (lang, tok, vec): unit vectors. The feature basis is the top eigenvectors of the PPMI Gram matrix,
    scaled by the roots of their eigenvalues; each token solves its own weighted normal equations, weights are the counts."""
    feats = top_features(matrix, most_features)
    n = feats.count()
    k = min(rank, n)
    own = matrix.join(F.broadcast(feats.select("feat", "f")), "feat").groupBy("lang", "tok").agg(F.collect_list(F.struct("f", "x", "ppmi")).alias("e"))  # bounded by most_features

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for row in batch.column(0).to_pylist():
                f = np.array([r["f"] for r in row])
                v = np.array([r["ppmi"] for r in row])
                total[np.ix_(f, f)] += np.outer(v, v)
        i = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(total[i]), pa.list_(pa.float64()))], names=["f", "row"])

    rows = own.select("e").mapInArrow(gram, "f long, row array<double>")
    sums = rows.select("f", F.posexplode("row").alias("g", "v")).filter("v <> 0").groupBy("f", "g").agg(F.sum("v").alias("v"))
    full = np.zeros((n, n))
    for r in sums.toLocalIterator():
        full[r["f"], r["g"]] = r["v"]
    values, basis = np.linalg.eigh(full)
    basis = basis[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))[None, :] ** 0.5
    shared = matrix.sparkSession.sparkContext.broadcast(basis)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            out = []
            for row in batch.column(2).to_pylist():
                row.sort(key=lambda r: r["f"])
                b = s[[r["f"] for r in row]]
                w = np.array([r["x"] for r in row])
                y = np.array([r["ppmi"] for r in row])
                u = np.linalg.solve((b * w[:, None]).T @ b + ridge * np.eye(k), b.T @ (w * y))
                size = np.linalg.norm(u)
                out.append((u / size if size else u).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["lang", "tok", "vec"])

    return own.mapInArrow(solve, "lang string, tok string, vec array<double>")


def conjugate_gradient(apply, c: np.ndarray, tol: float = 1e-6, steps: int = 256) -> np.ndarray:
    """Solve A u = c for a positive definite A given by its product; stops at a residual of tol * (|c|^2 + 1e-12)."""
    u = np.zeros_like(c)
    r, limit = c - apply(u), tol * (float((c * c).sum()) + 1e-12)
    d, rr = r.copy(), float((r * r).sum())
    for _ in range(steps):
        if rr <= limit:
            break
        ad = apply(d)
        a = rr / float((d * ad).sum())
        u, r = u + a * d, r - a * ad
        new = float((r * r).sum())
        d, rr = r + (new / rr) * d, new
    return u


def laplacian(edges: DataFrame, vecs: DataFrame) -> DataFrame:
    """edges(a, b, w) both ways, vecs(id, vec) -> (id, vec): L u = sum w (u_a - u_b), by a join and an aggregate."""
    src, dst = vecs.select(F.col("id").alias("a"), F.col("vec").alias("va")), vecs.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    rows = edges.join(src, "a").join(dst, "b").select("a", F.posexplode(F.zip_with("va", "vb", lambda x, y: (x - y))).alias("i", "d"), "w")
    return rows.groupBy("a", "i").agg(F.sum(F.col("w") * F.col("d")).alias("v")).groupBy(F.col("a").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vec"))


def mean_vectors(rows: DataFrame, *by: str, vec: str = "vec") -> DataFrame:
    """(by..., vec, n): means a group, by sums of single components, so groups of any size combine before the shuffle."""
    parts = rows.select(*by, F.posexplode(vec).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("vec"), F.max("n").alias("n"))


def prototypes(rows: DataFrame, *by: str) -> DataFrame:
    """Normalised mean vector a group."""
    return mean_vectors(rows, *by).select(*by, V.normalised(F.col("vec")).alias("proto"), "n")


def cohesion(rows: DataFrame, *by: str) -> DataFrame:
    """Mean off-diagonal cosine of unit vectors in closed form: (|sum u|^2 - n) / (n (n - 1)); no pairs are made."""
    m = mean_vectors(rows.withColumn("vec", V.normalised(F.col("vec"))), *by)
    n = F.col("n").cast("double")
    s2 = V.dot(F.col("vec"), F.col("vec")) * n * n
    return m.select(*by, "n", F.when(n > 1, (s2 - n) / (n * (n - 1))).otherwise(0.0).alias("mean_cosine"))


def cross_cosine(protos: DataFrame, key: str, *within: str) -> DataFrame:
    """Cosines of the prototypes of pairs of groups; there are few groups."""
    a, b = protos.select(*within, F.col(key).alias("a"), F.col("proto").alias("pa")), protos.select(*within, F.col(key).alias("b"), F.col("proto").alias("pb"))
    pairs = a.join(b, list(within)) if within else a.crossJoin(F.broadcast(b))
    return pairs.filter("a < b").select(*within, "a", "b", V.cosine(F.col("pa"), F.col("pb")).alias("cosine"))


def word_vectors(words: DataFrame, vecs: DataFrame) -> DataFrame:
    """words(word, tokens), vecs(tok, vec) -> (word, vec): the normalised mean over known tokens; words without one are left out."""
    rows = words.select("word", F.explode("tokens").alias("tok")).join(vecs.select("tok", "vec"), "tok")
    return mean_vectors(rows, "word").select("word", V.normalised(F.col("vec")).alias("vec"))
