"""Top-k with repeated ids and large components; buckets and batches of packing."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import packing, topk


def brute(rows, k=5):
    x = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64).astype(object)) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in x if i % 50 == 0}):
        scores = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), c) for i, v in x if i == q for c, w in x if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return out


@pytest.mark.parametrize("size", [0.3, 3e5])
def test_repeated_ids_and_large_components(spark, size):
    """At the second size impacts have over 53 bits together with the number of dimensions."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, size, 24)]) for i in rng.integers(0, 200, 400)]
    rows += [(50, rows[0][1]), (50, rows[1][1])] + [(7, [float(x) for x in rng.normal(0, size, 24)]) for _ in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, block=100, query_block=4, enough=16).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == brute(rows)


def test_search_skips_vectors_and_loses_none():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 60, (2000, 64)) + 200 * rng.normal(0, 1, (2000, 1)) * np.ones(64)).astype(np.int64)
    index = topk.ImpactIndex(x)
    for q in x[:20]:
        rows = index.search(q, 6, 64)
        assert len(rows) < 2000 and set(np.argsort(-(x @ q), kind="stable")[:6].tolist()) <= set(rows.tolist())


def test_batches_hold_equal_lengths(spark):
    docs = spark.createDataFrame([(i, "and the thing " * (i % 40)) for i in range(300)] + [(None, None), (3, "x")], "doc_id long, text string").withColumn("bucket", F.lit("x"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        rows = packing.pack(docs, f.read(), P.PATTERN, 64, batch_tokens=256).collect()
    groups = defaultdict(list)
    for r in rows:
        assert r["length"] == 1 << r["bucket"]
        groups[r["batch_id"]].append(r["length"])
    assert all(len(set(g)) == 1 and sum(g) <= 256 for g in groups.values()) and any(sum(g) == 256 for g in groups.values())
    assert sum(map(len, groups.values())) == len(rows) == len({r["sequence_id"] for r in rows})


def test_merges_out_of_order_are_refused():
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    with pytest.raises(ValueError, match="merges"):
        packing.Encoder(json.dumps(spec), P.PATTERN)


@pytest.mark.parametrize("size", [60, 1 << 24])
def test_a_round_takes_one_sum_where_its_digits_fit(monkeypatch, size):
    """Counts and impacts come from one sum a round; impacts of more digits take one each and a count. Both find the best."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, size, (500, 16))).astype(np.int64)
    index, calls, bincount = topk.ImpactIndex(x), [], np.bincount
    monkeypatch.setattr(topk.np, "bincount", lambda *a, **k: calls.append(k.get("weights") is not None) or bincount(*a, **k))
    for q in x[:10]:
        calls.clear()
        rows = index.search(q, 6, 0)
        assert set(np.argsort(-(x @ q), kind="stable")[:6].tolist()) <= set(rows.tolist())
        assert len(calls) <= 8 and all(calls) if size == 60 else len(calls) > 8 and not all(calls)
