"""Byte-level BPE against tiktoken: long runs without a space, rows without an id, repeated rows, the cache."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import bpe, pieces

CJK = "自然言語処理は人間が日常的に使っている言葉をコンピュータに処理させる技術であり裏覚醒ドラゴンの魔法" * 40


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return bpe.read_ranks(f.readlines())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_map_holds_every_pair_once(ranks):
    merges = bpe.pairs(ranks)
    base, table = bpe.displaced(merges)
    assert (table != bpe.FREE).sum() == len(merges)
    assert all(table[base[a] + b] == (a + 1) << 17 | r for (a, b), r in merges.items())
    assert len(table) >= base.max() + bpe.EDGE  # the mark behind a word reads inside the table


def test_long_runs_are_cut_where_no_token_reaches(ranks, reference):
    cutter = bpe.Cutter(ranks)
    assert len(CJK.encode()) > 5000 and max(len(x.encode()) for x in cutter(CJK)) <= 64
    for text in (CJK, "x" * 100, "é日" * 50, "Привет" * 30, "🙂" * 40):
        assert "".join(cutter(text)) == text
        assert [i for x in cutter(text) for i in reference._encode_single_piece(x.encode())] == reference._encode_single_piece(text.encode())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "の", "魔", "ー", "ティ", "裏", "é", "ß", "д", "🙂", "字", "ab", "-"]), min_size=33, max_size=80))
def test_cuts_change_no_id(parts):
    with open(P.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        ranks = bpe.read_ranks(f.readlines())
    word = "".join(parts)
    found = [i for x in bpe.Cutter(ranks)(word) for i in bpe.heap_merge(x.encode(), ranks)]
    assert found == bpe.heap_merge(word.encode(), ranks)


def test_cjk_goes_through_the_fold(spark, ranks, reference, monkeypatch):
    def none(*_):
        raise AssertionError("merged through the heap")

    monkeypatch.setattr(bpe, "heap_merge", none)
    rows = [(1, CJK), (None, CJK[7:]), (1, CJK), (2, None), (3, "mixed " + CJK[:90] + " text" + "A" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["ids"], bytes(r["decoded"]).decode()) for r in bpe.encode_documents(docs, ranks, P.PATTERN).collect()]
    want = [(i, reference.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_long_letters_and_many_words(spark, ranks, reference, monkeypatch):
    """Pieces of over LONG bytes, words beyond the cache and a dictionary that is dropped."""
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "SLICE", 2000)
    monkeypatch.setattr(bpe, "CODES", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("etaoins"), rng.integers(1, 9))) for _ in range(120)) for _ in range(60)] + ["z" * 3000, "-" * 2100 + " end", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for r in bpe.digest_documents(docs, ranks, P.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_splitter_cuts_only_long_words():
    s = pieces.Splitter(P.PATTERN, lambda w: [w[:10], w[10:]])
    assert s.split("a " + "b" * 40) == ["a", " " + "b" * 9, "b" * 31] and s.split("a bb") == ["a", " bb"]
