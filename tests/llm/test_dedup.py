"""Exact and near duplicates against brute force, with the defined results for nulls, repeats and empty tables."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslab.llm import components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, keep_id string"
ROWS = [(1, "Same Text", "x"), (2, "same text", "x"), (3, None, "x"), (4, "", None), (5, "same  text", "y"), (5, "same  text", "y"), (None, "SAME TEXT", "z"), (7, "É", "z"), (8, "é", "z"), (9, "w " * 5000, "z")]


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_decide(spark):
    out = exact_dedup.decide(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    for t, ids in groups.items():
        mine = [r for r in out if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        assert {r["keep_id"] for r in mine} == {max(i for i in ids if i is not None)}
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert sum(r["kept"] for r in mine) == 1


def test_smallest_id_stays(spark):
    out = exact_dedup.decide(spark.createDataFrame(ROWS[:2], SCHEMA), keep="min").collect()
    assert {r["keep_id"] for r in out} == {1}


def test_collisions_are_told_apart(spark):
    weak = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 4, "0"))  # noqa: E731  equal lengths collide
    out = exact_dedup.decide(spark.createDataFrame(ROWS, SCHEMA), hashed=weak).collect()
    want = exact_dedup.decide(spark.createDataFrame(ROWS, SCHEMA)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_sha256"], str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(key, out)) == sorted(map(key, want))


def test_dedup_keeps_columns_and_one_row_a_group(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "5", "7", "8", "9"]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decide(none).count() == 0 and simhash.near_components(none).count() == 0
    assert exact_dedup.dedup(none).count() == 0 and simhash.near_dedup(none).count() == 0


def brute_fingerprint(text, words=3):
    found = [w for w in lower(text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two", "A b\tC\nd é f g", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_shingle_hash_is_sparks(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("bucket", "spread"), [(1024, 64), (4, 64), (4, 9)])
def test_links_lose_nothing(spark, bucket, spread):
    """Random fingerprints with near ones; a small bucket forces blocks of blocks, few bits a dense group."""
    rng = np.random.default_rng(bucket + spread)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64) if spread == 64 else np.zeros(1, np.uint64)
    fps = {int(s) for s in seeds}
    while len(fps) < 120:
        f = int(rng.choice(seeds))
        for b in rng.integers(0, spread, rng.integers(0, 5)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(table, 2, bucket, fan=4)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps, 2)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    index = simhash.GrayIndex(fps, 8)
    i, j = index.links(2)
    got = {frozenset((int(index.fps[a]), int(index.fps[b]))) for a, b in zip(i, j, strict=True)}
    want = {frozenset((int(a), int(b))) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2}
    assert got == want and len(i) == len(want)


def test_near_components(spark):
    rows = [(3, "a b c d e f"), (2, "A B c d e f"), (9, None), (10, " "), (11, "quite another text of words here"), (None, "a b c d e f"), (3, "a b c d e f")]
    out = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in out)
    assert got == [("10", 9), ("11", 11), ("2", 2), ("3", 2), ("3", 2), ("9", 9), ("None", 2)]
    assert {r["fingerprint"] for r in out if r["doc_id"] in (9, 10)} == {"0" * 16}


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)}


def test_rows_without_id_link_components(spark, monkeypatch):
    """Fingerprints 0, 3 and 15: 0 and 15 are linked only through the row without an id; 1023 << 30 and its neighbour have none at all."""
    rows = [(8, "0"), (None, "3"), (4, "15"), (None, str(1023 << 30)), (None, str(1022 << 30)), (6, str(255 << 50)), (None, str(254 << 50))]
    marks = spark.createDataFrame([(i, int(t)) for i, t in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: marks)
    out = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {int(r["fingerprint"], 16): r["component_id"] for r in out}
    assert got == {0: 4, 3: 4, 15: 4, 1023 << 30: None, 1022 << 30: None, 255 << 50: 6, 254 << 50: 6} and len(out) == len(rows)


def test_rows_that_share_an_id_are_not_lost(spark):
    """Stages keep rows of one id but unlike texts; rows equal in both stay once; names that stages use may be taken."""
    from corpuslab.llm import near

    rows = [(1, "first text of seven words here now", 1, 1), (1, "another thing with quite unlike words", 2, 2), (1, "another thing with quite unlike words", 3, 3), (2, "FIRST text of seven words here now", 4, 4), (None, "x", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cl_id int, cl_key int").withColumnsRenamed({"cl_id": "cl_hash"})
    for found in (near.near_dedup(docs), simhash.near_dedup(docs), exact_dedup.dedup(docs, "min")):
        out = found.collect()
        assert found.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"][:5]) for r in out) == [("1", "anoth"), ("1", "first"), ("None", "x")]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from corpuslab.llm import shared

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(cluster)
