"""Alignment of embedding spaces: exact neighbours in blocks, CSLS, mutual neighbours, Procrustes, analogies.

All-pairs similarities are blocked matrix products in an Arrow stage. The targets are dealt out in blocks that meet each
block of sources once; each pair of blocks returns the best k a source, and those are ranked once more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions import vectors as V
from corpuslab.operators import metrics as M
from corpuslab.sources.shared import materialise


#: Vectors of a block; rows and columns of a tile of products; groups of a tile's columns; pairs worked out in double precision at once.
BLOCK, TILE, GROUPS, PAIRS = 65_536, (1024, 8192), 128, 100_000


def _matrix(t: pa.Table) -> np.ndarray:
    return np.array(t.column("vec").combine_chunks().flatten().to_numpy(), dtype=np.float64).reshape(t.num_rows, -1)


def _kept(x: np.ndarray, y: np.ndarray, ys: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, inner product to 9 digits) of the `keep` best of each row of x, ties by ys. Products in single precision leave out what
    is below the keep-th best of the groups' best by more than their error; the rest is worked out in double precision."""
    error = 4 * x.shape[1] * 2.0**-24 * np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max())
    bound = np.full(len(x), -np.inf)
    single, found = x.astype(np.float32), []
    for at in range(0, len(y), TILE[1]):
        part = y[at : at + TILE[1]].astype(np.float32)
        sims = single @ part.T
        size = -(-len(part) // GROUPS)
        if keep <= len(part) // size and np.isfinite(error):
            whole = len(part) // size  # groups
            best = sims[:, : whole * size].reshape(len(x), whole, size).max(axis=2)
            bound = np.maximum(bound, np.partition(best, whole - keep, axis=1)[:, whole - keep] - error)
        i, j = np.nonzero(~(sims < bound[:, None].astype(np.float32)))
        found.append((i, j + at))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    sims = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.zeros(0)]).round(9)
    order = np.lexsort((ys[j], -sims, i))
    i, j, sims = i[order], j[order], sims[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < keep], j[place < keep], sims[place < keep]


def _searched(src: DataFrame, tgt: DataFrame, keep: int, block: int) -> DataFrame:
    """src(id, vec), tgt(id, vec) -> (id, nid, sim): the `keep` best inner products of each pair of blocks. A block is held by a task, in proportion
    to `block`; products are made tile by tile. There are at least four pairs of blocks a core, each a task but for chance."""
    some = math.ceil(math.sqrt(4 * src.sparkSession.sparkContext.defaultParallelism))
    sb, tb = (max(-(-side.count() // block), some) for side in (src, tgt))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    # both sides may be one table: each gets columns of its own
    a = src.select(F.col("id").alias("id"), F.col("vec").alias("vec"), place(sb).alias("sb"), F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("tb"))
    b = tgt.select(F.col("id").alias("id"), F.col("vec").alias("vec"), place(tb).alias("tb"), F.explode(F.sequence(F.lit(0), F.lit(sb - 1))).alias("sb"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            xs, ys, xm, ym = x.column("id").to_numpy(), y.column("id").to_numpy(), _matrix(x), _matrix(y)
            for at in range(0, len(xm), TILE[0]):
                i, j, sims = _kept(xm[at : at + TILE[0]], ym, ys, keep)
                out.append((xs[i + at], ys[j], sims))
        cols = [np.concatenate([o[k] for o in out]) if out else [] for k in range(3)]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "nid": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.float64())})

    a, b = (side.repartition(4 * sb * tb, "sb", "tb") for side in (a, b))  # a given number, as small inputs would be put together in few tasks
    return a.groupBy("sb", "tb").cogroup(b.groupBy("sb", "tb")).applyInArrow(best, "id long, nid long, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "nid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(src: DataFrame, tgt: DataFrame, k: int, block: int = BLOCK, same: bool = False) -> DataFrame:
    """src(id, vec), tgt(id, vec) -> (id, nid, sim, rank): the k best cosines, ties by id. same: an id isn't its own neighbour."""
    a, b = (side.select("id", V.normalised(F.col("vec")).alias("vec")) for side in (src, tgt))
    found = _searched(a, b, k + 1 if same else k, block)
    return _ranked(found.filter("id <> nid") if same else found, k)


def mean_similarity(src: DataFrame, tgt: DataFrame, k: int = 10) -> DataFrame:
    """(id, r): mean of the k best similarities."""
    return neighbours(src, tgt, k).groupBy("id").agg(F.avg("sim").alias("r"))


def csls(src: DataFrame, tgt: DataFrame, k: int = 10, pool: int = 50) -> DataFrame:
    """(id, nid, score, rank): 2 cos - r_src - r_tgt. Candidates are the `pool` nearest by cosine and those that the targets
    with the smallest r offer; `exact_csls` checks all."""
    r_src, r_tgt = mean_similarity(src, tgt, k), mean_similarity(tgt, src, k).withColumnRenamed("id", "nid").withColumnRenamed("r", "rt")
    near = neighbours(src, tgt, pool)
    score = 2 * F.col("sim") - F.col("r") - F.col("rt")
    rows = near.join(r_src, "id").join(r_tgt, "nid").select("id", "nid", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "nid"))
    return rows.withColumn("rank", rank)


def exact_csls(src: DataFrame, tgt: DataFrame, k: int = 10, top: int = 1) -> DataFrame:
    """CSLS over all targets: r_tgt becomes one more dimension, so that 2 cos - r_tgt is an inner product, and blocks are searched as for cosines."""
    r_src = materialise(mean_similarity(src, tgt, k), "r_src")
    r_tgt = materialise(mean_similarity(tgt, src, k), "r_tgt").withColumnRenamed("id", "__id")
    a = src.select("id", F.concat(V.normalised(F.col("vec")), F.array(F.lit(-1.0))).alias("vec"))
    b = tgt.join(r_tgt, F.col("id") == F.col("__id")).select("id", F.concat(F.transform(V.normalised(F.col("vec")), lambda x: 2 * x), F.array(F.col("r"))).alias("vec"))
    found = _inner(a, materialise(b, "targets"), top)
    return found.join(r_src, "id").select("id", "nid", (F.col("sim") - F.col("r")).alias("score"), "rank")


def _inner(src: DataFrame, tgt: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As neighbours, by inner product of the vectors as they are."""
    return _ranked(_searched(src, tgt, k, block), k)


def mutual(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(id, nid): pairs that are each other's nearest."""
    there = neighbours(src, tgt, 1).select("id", "nid")
    back = neighbours(tgt, src, 1).select(F.col("nid").alias("id"), F.col("id").alias("nid"))
    return there.intersect(back)


def precision_at(found: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """found(id, nid, rank), gold(id, nid) with several targets a source: a source counts once if any target is among the first k."""
    hit = gold.join(found, ["id", "nid"], "left").groupBy("id").agg(F.min("rank").alias("first"))
    return hit.agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"p_at_{k}") for k in ks])


def procrustes(pairs: DataFrame, dims: int) -> np.ndarray:
    """pairs(x, y) vectors -> the orthogonal W that takes x to y best: U V' of the SVD of sum y x'. The d by d sum is made by aggregation."""
    cells = pairs.select(F.posexplode("y").alias("i", "b"), "x").select("i", "b", F.posexplode("x").alias("j", "a")).groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("v"))
    m = np.zeros((dims, dims))
    for r in cells.collect():  # d * d rows
        m[r["i"], r["j"]] = r["v"]
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def apply_map(vecs: DataFrame, w: np.ndarray) -> DataFrame:
    """W v of each vector, as an expression over a literal matrix."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    return vecs.withColumn("vec", F.transform(rows, lambda r: V.dot(r, F.col("vec"))))


def renormalised(vecs: DataFrame, steps: tuple[str, ...] = ("center", "renorm")) -> DataFrame:
    """Center by column means and scale to unit length, in the order given."""
    for s in steps:
        if s == "renorm":
            vecs = vecs.withColumn("vec", V.normalised(F.col("vec")))
        else:
            means = vecs.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
            one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("__m"))
            vecs = vecs.crossJoin(F.broadcast(one)).withColumn("vec", F.zip_with("vec", "__m", lambda x, m: x.cast("double") - m)).drop("__m")
    return vecs


def inverted_softmax(sims: DataFrame, beta: float = 30.0) -> DataFrame:
    """sims(id, nid, sim) -> score: exp(beta s) over the sum of a target's column."""
    total = sims.groupBy("nid").agg(F.sum(F.exp(beta * F.col("sim"))).alias("z"))
    return sims.join(total, "nid").select("id", "nid", (F.exp(beta * F.col("sim")) / F.col("z")).alias("score"))


def analogies(questions: DataFrame, vecs: DataFrame) -> DataFrame:
    """questions(qid, a, b, c, d), vecs(id, vec): b - a + c, the nearest id that is none of the three. (qid, answer, right)"""
    v = lambda n: vecs.select(F.col("id").alias(n), V.normalised(F.col("vec")).alias(f"v{n}"))
    q = questions.join(v("a"), "a").join(v("b"), "b").join(v("c"), "c")
    target = q.select(F.col("qid").alias("id"), V.add(V.minus(F.col("vb"), F.col("va")), F.col("vc")).alias("vec"))
    found = neighbours(target, vecs, 4).withColumnRenamed("id", "qid")
    free = questions.join(found, "qid").filter("nid <> a and nid <> b and nid <> c")
    best = free.groupBy("qid").agg(F.min_by("nid", "rank").alias("answer"), F.first("d").alias("d"))
    return best.select("qid", "answer", (F.col("answer") == F.col("d")).alias("right"))


def word_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, lower: bool = True) -> DataFrame:
    """pairs(w1, w2, score) against vectors(word, vector): (found, not_found, rho), Spearman's correlation of the scores and the cosines.
    Without `lower` a word that isn't known is looked up with a capital first letter."""
    right = left if right is None else right

    def side(rows: DataFrame, vectors: DataFrame, w: str, v: str) -> DataFrame:
        plain = vectors.groupBy("word").agg(F.first("vector").alias(v)).withColumnRenamed("word", w)
        out = rows.join(plain, w, "left")
        if not lower:
            capital = plain.withColumnsRenamed({w: "__c", v: "__v"})
            out = out.join(capital, F.initcap(w) == F.col("__c"), "left").withColumn(v, F.coalesce(v, "__v")).drop("__c", "__v")
        return out

    both = side(side(pairs.select("w1", "w2", "score"), left, "w1", "a"), right, "w2", "b")
    cosine = V.dot(F.col("a"), F.col("b")) / (F.sqrt(V.dot(F.col("a"), F.col("a"))) * F.sqrt(V.dot(F.col("b"), F.col("b"))))
    known = both.filter("a is not null and b is not null").select("score", cosine.alias("cosine"))
    rho = M.correlations(known, "score", "cosine").select(F.col("n").alias("found"), F.col("spearman").alias("rho"))
    return rho.crossJoin(F.broadcast(both.agg(F.count("*").alias("all")))).select("found", (F.col("all") - F.col("found")).alias("not_found"), "rho")


def sentence_vectors(words: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """words(id, word) occurrences, vectors(word, vector), weights(word, idf) -> (id, vector): the weighted sum of a sentence's known words
    of length one. Components meet in partial sums, so no task holds a sentence."""
    rows = words.join(vectors.select("word", "vector"), "word").join(weights.select("word", "idf"), "word")
    parts = rows.select("id", "idf", F.posexplode("vector").alias("i", "x")).groupBy("id", "i").agg(F.sum(F.col("x") * F.col("idf")).alias("x"))
    whole = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # as many as dimensions
    norm = lambda v: F.sqrt(V.dot(v, v))
    return whole.select("id", F.transform("v", lambda x: x / F.greatest(norm(F.col("v")), F.lit(1e-12))).alias("vector"))


def principal_axes(vectors: DataFrame, k: int = 2, col: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the k directions of most variance, by the sums of outer products that each Arrow batch adds up; the driver gets one
    matrix of dimensions a batch of partitions. Signs: the largest component of an axis is positive."""

    def sums(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                x = np.hstack((np.ones((len(x), 1)), x))
                total, n = x.T @ x + (0 if total is None else total), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    m = F.posexplode("m").alias("i", "x")
    cells = vectors.select(col).mapInArrow(sums, "m array<double>").select(m).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # dimensions squared
    size = round(len(cells) ** 0.5)
    gram = np.array([c["x"] for c in cells]).reshape(size, size)
    mean = gram[0, 1:] / gram[0, 0]
    values, axes = np.linalg.eigh(gram[1:, 1:] / gram[0, 0] - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, col: str = "vector") -> DataFrame:
    """The vectors' coordinates on the axes, as `point`."""
    centre = F.array(*[F.lit(float(x)) for x in mean])
    moved = F.zip_with(F.col(col), centre, lambda x, m: x - m)
    return vectors.withColumn("point", F.array(*[V.dot(moved, F.array(*[F.lit(float(x)) for x in a])) for a in axes]))
