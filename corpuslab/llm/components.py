"""Connected components over an edge table, by alternating large and small stars.

Every step joins the edges with one minimum a node. The minima are written out and
counted: a small table of them is broadcast, a large one is shuffled, and as both sides of
that join are exchanges then, Spark may split a hub's edges over many tasks. Nothing is
collected but three sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shared import materialise, maybe_broadcast, scratch


def _minima(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "minima")
    return maybe_broadcast(least, least.count())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour is linked to the least of the neighbourhood, the node itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minima(both)
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those."""
    moved = edges.join(_minima(edges), "a")
    rows = moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
    return rows.select("x.a", "x.b").filter("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b): any direction, repeats and loops allowed. Returns (node, root), root the
    smallest node it can reach; nodes without an edge to another node don't appear."""
    with scratch():
        now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        sums = lambda e: e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        seen = sums(now)
        for _ in range(max_rounds if seen[0] else 0):
            now = materialise(_small_star(_large_star(now)), "small")
            if (new := sums(now)) == seen:
                break
            seen = new
        else:
            if seen[0]:
                raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
