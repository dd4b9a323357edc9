"""Exact top-k search by inner product over an impact-ordered index, a score at a time.

Vectors become integers, floor(scale * x). Blocks of `block` vectors are indexed by
themselves: for each dimension, postings are grouped into segments of
equal quantised impact. A query shifts each dimension's contributions so that none is negative
and takes the segments of all dimensions in descending order of
impact, adding up quantised scores. After each round a vector's score is known up to what its open
dimensions can still add. The search stops only on proof: when no more vectors than `enough` can
be among the best k (or nothing is left). All vectors that possibly are get
their exact integer score, the best k of the block go on, and the best k of all blocks are the result.

Queries and vectors meet in blocks of both; neither side is broadcast or collected.

Defined results
  null vector, null or non-finite component   takes no part, neither as query nor as candidate
  null vec_id          takes no part
  vectors of unequal length   only those of the most frequent length (ties: the greater) take part
  repeated rows        every row takes part; a row whose vec_id is the query's own is no candidate, and queries that share
                       a vec_id share one list
  large components     sums are exact up to 2**62; greater ones raise
  ties                 the smaller vec_id
  fewer than k others  all of them
  empty table          empty result
  extra columns        ignored
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.shared import materialise

LEVELS = 16
#: Digits of an impact that are added up at once: with fewer than 2**21 dimensions their sums stay below 2**53.
DIGITS = 32


class ImpactIndex:
    """vectors: int64 rows. Segments are (dimension, level); level bounds are exact."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum((self.high - self.low + levels) // levels, 1)
        level = (vectors - self.low) // width
        key = (level + np.arange(dims) * levels).T.ravel()  # dimension by dimension
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(dims * levels + 1))
        self.sizes = np.diff(cuts)
        self.ids = np.split(np.tile(np.arange(n), dims)[order], cuts[1:-1])  # of each segment
        self.floor = (self.low[:, None] + width[:, None] * np.arange(levels)).ravel()  # least value of each segment
        if int(np.abs(vectors).max(initial=0)) >> 40:
            raise OverflowError("components of over 40 bits")
        self.top = np.minimum(self.floor + np.repeat(width, levels) - 1, np.repeat(self.high, levels))
        self.dims, self.levels = dims, levels

    def search(self, query: np.ndarray, k: int, enough: int, rounds: int = 8) -> np.ndarray:
        """Rows that can be among the best k: a superset, of at most `enough` rows unless all segments were needed."""
        n = len(self.vectors)
        if n <= k:
            return np.arange(n)
        q = np.repeat(query, self.levels)
        worst = np.repeat(np.minimum(query * self.low, query * self.high), self.levels)  # the shift of each dimension
        a, b = q * self.floor - worst, q * self.top - worst
        least, most = np.minimum(a, b), np.maximum(a, b)
        sizes = self.sizes
        # what quantising can hide in a sum, at most
        hidden = int(((most - least) * (sizes > 0)).reshape(self.dims, self.levels).max(axis=1).sum())
        order = np.argsort(-most, kind="stable")
        order = order[sizes[order] > 0]
        done = np.cumsum(sizes[order])
        # sums of doubles are exact below 2**53: impacts of more digits are added up in parts
        bound = int(most.reshape(self.dims, self.levels).max(axis=1).astype(object).sum())
        if bound >= 1 << 62:
            raise OverflowError("scores of over 62 bits")
        # a posting's count goes above its lowest digits where both fit, so that one sum a round gives both
        joint = bound.bit_length() + self.dims.bit_length() <= 53
        parts = range(0, max(1, bound.bit_length()), DIGITS)
        reached, seen, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
        for r in range(1, rounds + 1):
            upto = len(order) if r == rounds else max(at + 1, int(np.searchsorted(done, done[-1] * r / rounds)) + 1)
            part = order[at:upto]
            ids = np.concatenate([self.ids[s] for s in part.tolist()])
            if joint:
                both = np.bincount(ids, weights=np.repeat((most[part] + (1 << bound.bit_length())).astype(np.float64), sizes[part]), minlength=n).astype(np.int64)
                seen += both >> bound.bit_length()
                reached += both & ((1 << bound.bit_length()) - 1)
            else:
                seen += np.bincount(ids, minlength=n)
            for low in () if joint else parts:
                digits = most[part] >> low & ((1 << DIGITS) - 1)
                reached += np.bincount(ids, weights=np.repeat(digits, sizes[part]), minlength=n).astype(np.int64) << low
            at = upto
            rest = int(most[order[at]]) if at < len(order) else 0  # no open segment adds more
            upper = reached + (self.dims - seen) * rest
            bar = np.partition(reached, n - k)[n - k] - hidden  # k rows have at least this
            possible = np.flatnonzero(upper >= bar)
            if len(possible) <= enough or at >= len(order):
                return possible
        raise AssertionError("the last round leaves no segment")


def _search(k: int, enough: int):
    def both(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not queries.num_rows or not vectors.num_rows:
            return empty
        matrix = lambda t: np.array(t.column("v").combine_chunks().flatten().to_numpy(), dtype=np.int64).reshape(t.num_rows, -1)
        ids = vectors.column("vec_id").to_numpy()
        x = matrix(vectors)
        index, exact, own = ImpactIndex(x), x.astype(np.float64), Counter(ids.tolist())
        small = int(np.abs(x).max()) ** 2 * x.shape[1] < 1 << 52  # sums are exact as doubles
        out: tuple[list, list, list] = ([], [], [])
        for qid, q in zip(queries.column("vec_id").to_numpy().tolist(), matrix(queries), strict=True):
            rows = index.search(q, k + own.get(qid, 0), enough)  # more by those that are the query's own
            rows = rows[ids[rows] != qid]
            score = (exact[rows] @ q.astype(np.float64)).astype(np.int64) if small else x[rows] @ q
            if len(rows) > k:
                good = score >= np.partition(score, len(score) - k)[len(score) - k]  # ties of the last stay
                rows, score = rows[good], score[good]
            best = np.lexsort((ids[rows], -score))[:k]
            out[0].extend([qid] * len(best))
            out[1].extend(ids[rows][best].tolist())
            out[2].extend(score[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return both


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.col("embedding")
    bad: Column = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(~bad)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 2048, query_block: int = 1024, enough: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition over vec_id."""
    rows = materialise(quantised(vectors, scale), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    rows = rows.filter((F.size("v") == dims) & (F.size("v") > 0))
    blocks = max(1, -(-n // block))
    n_queries = rows.filter(is_query).count()
    query_blocks = max(1, -(-n_queries // query_block))
    # by the vector too, as one id may be repeated many times
    place = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(m)).cast("int")
    # each block of queries meets each block of vectors once
    q = rows.filter(is_query).withColumn("qb", place("q", query_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    c = rows.withColumn("vb", place("v", blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keyed = lambda t: t.select("qb", "vb", "vec_id", "v").groupBy("qb", "vb")
    found = keyed(q).cogroup(keyed(c)).applyInArrow(_search(k, enough), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
