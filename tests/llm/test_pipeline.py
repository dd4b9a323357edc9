"""The pipeline against a brute-force version in plain Python."""

import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from corpuslab.llm import lang_id, packing, pii


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r["doc_id"] for r in lang_id.identify(table).filter("rejected").collect()}
    docs = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] not in rejected}
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    last = {}
    for i, t in docs.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    docs = {i: docs[i] for i in last.values()}
    words = {i: lower(t).split() for i, t in docs.items()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    label = {i: i for i in docs}
    near = [(i, j) for i in docs for j in docs if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    f = pii.Feistel(pii.TEST_KEY)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for i in docs:
        if label[i] == i:
            ids, at = [*tok.encode(pii.replace(docs[i], f)[0], add_special_tokens=False).ids, 0], 0
            for n in packing.binary_lengths(len(ids), 1024):
                want.add((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at += n
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_odd_rows_go_through_every_stage(spark, tmp_path, sf_dir):
    """Nulls in every column, empty and repeated texts, rows that share an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.filter("doc_id = 5").first()
    odd = [(None, some["text"] + " and more", None, None, None), (9001, None, "en", "x", 0), (9002, "", None, None, 0), (9003, "12 34 !", "en", None, 7), (5, some["text"], "en", "x", 1), (5, "the of and that this with from they have been there were which", "en", "x", 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    assert not {9001, 9002, 9003} & ids and 5 in ids
    starts = [(r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0]
    assert sum(n for _, n in starts) == sum(r["length"] for r in rows) and len({r["sequence_id"] for r in rows}) == len(rows)
