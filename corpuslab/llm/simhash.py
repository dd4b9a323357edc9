"""SimHash near-dedup over a Gray-order hierarchical index.

1. Fingerprints (Arrow batches): the majority of each bit over the XXH64 of word shingles.
2. Distinct fingerprints are dealt out by bit blocks. Two that differ in at
   most r bits agree on one of r + 1 blocks, so no link is lost. A block value that
   holds more than `bucket` fingerprints is dealt out again by blocks of
   its remaining bits, as often as needed: distinct fingerprints that agree on
   all but m bits number 2**m at most, so this ends.
3. In each bucket the fingerprints are sorted by Gray rank; neighbours share long bit
   patterns. Upper nodes hold the bits shared by all below, without those an
   ancestor holds. A search adds up the differences from the root down and drops a whole
   group once they exceed r.
4. Each bucket returns a spanning forest of its links, not its pairs; the
   components of fingerprints are joined up by `components`, then named by their smallest id.

Defined results
  null or empty text, or no word   fingerprint zero, linked like any other
  null doc_id          has a fingerprint and the component of its fingerprint; never names a component
                       unless no row that it reaches has an id (then null)
  repeated rows, ties  equal fingerprints, one component; every row is returned
  empty table          empty result
  extra columns        ignored by `near_components`, kept by `near_dedup`
  very long texts      whole, in blocks of bounded memory
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.components import components
from corpuslab.llm.shared import arrow_stage, keep_one, materialise, maybe_broadcast, text_key

BLOCK = 1 << 16


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """bytes.lower() changes A-Z only, bytes.split() splits at the six ASCII white-space bytes."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        spans = zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist(), strict=True)
        counts += set_bits(np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8"))
    return majority(counts, n)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_stage(docs.select("doc_id", F.col("text").cast("binary").alias("t")), run, "doc_id long, fp long")


class GrayIndex:
    """Distinct fingerprints of one bucket, sorted by Gray rank, under nodes of `fan` children."""

    def __init__(self, fps: np.ndarray, fan: int = 8):
        rank = fps.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        self.order = np.argsort(rank, kind="stable")
        self.fps = fps[self.order]
        self.fan = fan
        lo, hi = self.fps, self.fps  # AND and OR of all below
        masks, values = [np.full(len(fps), ~np.uint64(0))], [self.fps]
        while len(lo) > fan:
            cuts = np.arange(0, len(lo), fan)
            lo, hi = np.bitwise_and.reduceat(lo, cuts), np.bitwise_or.reduceat(hi, cuts)
            masks.append(lo | ~hi)
            values.append(lo)
        # a node keeps only the pattern bits that its parent has not
        self.levels = [(v, m & ~np.repeat(masks[i + 1], fan)[: len(m)] if i + 1 < len(masks) else m) for i, (v, m) in enumerate(zip(values, masks, strict=True))]

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i > j in Gray order, at most `radius` bits apart, each once."""
        q = np.repeat(np.arange(len(self.fps)), len(self.levels[-1][0]))
        node = np.tile(np.arange(len(self.levels[-1][0])), len(self.fps))
        acc = np.zeros(len(q), dtype=np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            value, own = self.levels[level]
            here = node * self.fan**level < q  # a pair is found from its later member
            q, node, acc = q[here], node[here], acc[here]
            acc = acc + np.bitwise_count((self.fps[q] ^ value[node]) & own[node])
            near = acc <= radius
            q, node, acc = q[near], node[near], acc[near]
            if level:
                below = len(self.levels[level - 1][0])
                q, acc = np.repeat(q, self.fan), np.repeat(acc, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                real = node < below
                q, node, acc = q[real], node[real], acc[real]
        return q, node


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the first member of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_edges(radius: int, fan: int):
    def one(fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(fps, fan)
        i, j = index.links(radius)
        if not len(i):
            return ids[:0], ids[:0]
        ids = ids[index.order]
        first = forest(len(ids), i, j)
        other = np.flatnonzero(first != np.arange(len(ids)))
        return ids[other], ids[first[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray], final: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            path, key, fp, ident = cols
            new = np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1
            cuts = np.concatenate(([0], new, [len(path)]))
            if not final:
                cuts = cuts[:-1]  # the last bucket may go on in the next batch
            out_a, out_b = [ident[:0]], [ident[:0]]
            for k in np.flatnonzero(np.diff(cuts) > 1):
                s, e = cuts[k], cuts[k + 1]
                x, y = one(fp[s:e].view(np.uint64), ident[s:e])
                out_a.append(x)
                out_b.append(y)
            rest = [c[cuts[-1] :] for c in cols]
            return rest, pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if len(cols[0]):
                left, out = done(cols, False)
                yield out
        if left is not None and len(left[0]):
            yield done(left, True)[1]

    return run


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(x) for x in p] for p in np.array_split(bits, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 2, bucket: int = 1024, fan: int = 8) -> DataFrame:
    """fps(fp, id), fp distinct. Edges (a, b) of ids that span every component of the link graph."""
    spark = fps.sparkSession
    todo, paths, out = fps.withColumn("path", F.lit(-1)), [set()], None
    while paths:
        # from each path on, by each block of the bits that are still free
        nexts = [(at, fixed | set(part)) for at, fixed in enumerate(paths) for part in _split(sorted(set(range(64)) - fixed), radius + 1)]
        table = spark.createDataFrame([(at if len(paths) > 1 or out is not None else -1, i, _signed(sum(1 << b for b in bits))) for i, (at, bits) in enumerate(nexts)], "path int, next int, mask long")
        dealt = todo.join(F.broadcast(table), "path").select(F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "id")
        heavy = materialise(dealt.groupBy("path", "key").count().filter(F.col("count") > bucket).select("path", "key"), "heavy")
        n_heavy = heavy.count()
        light = dealt.join(maybe_broadcast(heavy, n_heavy), ["path", "key"], "left_anti") if n_heavy else dealt
        light = light.select("path", "key", "fp", "id").repartition("path", "key").sortWithinPartitions("path", "key")
        edges = arrow_stage(light, _bucket_edges(radius, fan), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        if not n_heavy:
            break
        todo = materialise(dealt.join(maybe_broadcast(heavy, n_heavy), ["path", "key"], "left_semi").select("path", "fp", "id"), "again")
        paths = [bits for _, bits in nexts]
    return out


def near_components(docs: DataFrame, words: int = 3, radius: int = 2, bucket: int = 1024) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    marks = materialise(fingerprints(docs, words), "marks")
    by_fp = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints")
    # every fingerprint is a node, with or without an id, as it may be all that links two documents
    roots = components(links(by_fp.select("fp", F.col("fp").alias("id")), radius, bucket))
    linked = materialise(by_fp.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp"), "fp"), "linked")
    names = materialise(linked.groupBy("root").agg(F.min("id").alias("component_id")), "names")
    found = linked.join(maybe_broadcast(names, names.count()), "root").select("fp", "component_id")
    alone = by_fp.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("id").alias("component_id"))
    named = materialise(found.unionByName(alone), "named")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of texts, as `keep_one` says, with all its columns."""
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = near_components(texts, words, radius)
    return keep_one(docs, materialise(found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")), "roots"))
