"""Loaders and writers on files of the shapes that the reference data have."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import align, gold
from corpuslab.sources import files, sinks


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_useg(spark, tmp_path):
    folder = tmp_path / "xx-mock"
    folder.mkdir()
    row = lambda word, morph, meta: "\t".join([word, "_", "_", morph, meta if isinstance(meta, str) else json.dumps(meta)])
    text = "\n".join([
        row("alpha", "_", {"segmentation": [{"morpheme": "alpha", "type": "stem"}]}), row("walking", "walk+ing", {"segmentation": [{"span": [3, 0, 1, 2], "type": "root"}, {"morpheme": "ing", "type": ["infl", "suffix"]}]}),
        row("redo", "re+do", {}), row("odd", "x+y", {"segmentation": [{"morpheme": "dd", "type": " "}]}), row("gone", "_", {}), row("bad", "b+ad", "{broken"), "few\tfields",
    ])
    put(folder / "UniSegments-1.0-xx-mock.useg", text)
    with gzip.open(folder / "UniSegments-1.0-xx-zip.useg.gz", "wt") as f:
        f.write(row("beta", "_", {"segmentation": [{"morpheme": "beta", "type": "stem"}]}))
    rows = {r["word"]: r for r in gold.read_useg(spark, str(folder)).collect()}
    assert set(rows) == {"alpha", "walking", "redo", "odd", "beta"}
    assert [tuple(s) for s in rows["alpha"]["segments"]] == [(0, 5, "stem")] and rows["alpha"]["boundaries"] == []
    assert [tuple(s) for s in rows["walking"]["segments"]] == [(0, 4, "root"), (4, 7, "infl suffix")] and rows["walking"]["boundaries"] == [4]
    assert [s["type"] for s in rows["redo"]["segments"]] == ["prefix", "suffix"]
    assert [tuple(s) for s in rows["odd"]["segments"]] == [(1, 3, "morpheme")]  # the string doesn't cover the word either
    assert (rows["beta"]["dataset"], rows["beta"]["lang"], rows["alpha"]["dataset"]) == ("xx-zip", "xx", "xx-mock")


def test_parallel_pairs(spark, tmp_path):
    lines = [
        {"source": "a", "target": "b", "source_lang": "en", "target_lang": "de", "extra": 1}, {"src": " c ", "translation": "d", "lang_pair": "en->fr"}, {"sentence1": "e", "sentence2": "f", "langs": ["en", " es "]},
        {"source": "g", "target": "h"}, {"source": "", "target": "x"}, {"original": "i", "translated": "j", "language_pair": "tr:en", "lang1": "xx"}, [1], {"source": "k", "target": "l", "langs": "en/de"},
    ]
    path = put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, lines)) + "\n\nbroken\n")
    get = lambda **k: [(r["source"], r["target"], r["source_lang"], r["target_lang"]) for r in files.parallel_pairs(spark, path, **k).orderBy("line").collect()]
    want = [("a", "b", "en", "de"), ("c", "d", "en", "fr"), ("e", "f", "en", "es"), ("i", "j", "tr", "en"), ("k", "l", "en", "de")]
    assert get() == want and get(limit=2) == want[:2]
    assert ("g", "h", "en", "hu") in get(source_lang="en", target_lang="hu")
    assert files.parallel_pairs(spark, path).orderBy("line").first()["metadata"] == {"extra": "1"}


@pytest.mark.parametrize(("value", "want"), [("en->de", ("en", "de")), ("en=>de", ("en", "de")), ("a:b-c", ("a", "b-c")), ("en | tr", ("en", "tr")), ("en/de", ("en", "de")), ("en-de", ("en", "de")), ("en,de", ("en", "de")), ("->x", None), ("ende", None)])
def test_language_pairs(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(files.split_pair(F.col("v")).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == want


def test_probes_and_dictionaries(spark, tmp_path):
    path = put(tmp_path / "f.jsonl", '{"text": "a b", "span": "a", "language": "en", "case_sensitive": "Yes"}\n{"text": "c", "substring": "c", "expectation": "multi_token"}\n{"text": "d"}\n')
    rows = files.feature_probes(spark, path, language="de").orderBy("line").collect()
    assert [(r["text"], r["span"], r["language"], r["feature"], r["expectation"], r["case_sensitive"]) for r in rows] == [("a b", "a", "en", "lexicon", "single_token", True), ("c", "c", "de", "lexicon", "multi_token", False)]
    path = put(tmp_path / "d.txt", "# note\nHaus\tmaison\n\nHaus  demeure x\nalone\nKatze chat\n")
    assert [(r["src"], r["tgt"]) for r in files.dictionary(spark, path, 2).orderBy("line").collect()] == [("Haus", "maison"), ("Haus", "demeure")]


def test_similarity_files(spark, tmp_path):
    plain = put(tmp_path / "men", "sun sunlight 50.0\nautomobile car 50.0\n")
    assert files.similarities(spark, plain, header=False).count() == 2 and files.similarities(spark, plain).count() == 1
    tabs = put(tmp_path / "ws.tab", "Word 1\tWord 2\tHuman\nlove\tsex\t6.77\ntiger\tbig cat\t7.35\nx\ty\tbad\n")
    assert [(r["w2"], r["score"]) for r in files.similarities(spark, tabs, "\t").orderBy("line").collect()] == [("sex", 6.77), ("big cat", 7.35)]
    js = put(tmp_path / "s.json", '[{"word1": "a", "word2": "b", "score": 1}]')
    assert files.similarities(spark, js).first()["score"] == 1.0
    pairs = put(tmp_path / "p.txt", "Cat DOG 3\nbig cat dog 4\n")
    assert [(r["w1"], r["w2"]) for r in files.word_pairs(spark, pairs).collect()] == [("cat", "dog")]


def test_vector_files(spark, tmp_path):
    path = put(tmp_path / "v.txt", "5 2\nCat 1 2\ncat 3 4\nnull 0 0\nbad 1\ndog 0.5 -1 \nlast 7 8\n")
    rows = files.text_vectors(spark, path, 2).orderBy("line").collect()
    assert [(r["word"], r["vector"]) for r in rows] == [("cat", [1, 2]), ("null", [0.01, 0]), ("dog", [0.5, -1]), ("last", [7, 8])]
    v = files.text_vectors(spark, path, 2, most=2)
    assert {r["word"] for r in v.collect()} == {"cat", "null"} and files.text_vectors(spark, path, 2, lower=False).count() == 5
    sub = files.lower_case_subset(spark.createDataFrame([(0, "The", [1.0]), (1, "the", [2.0]), (2, "A", [3.0])], "line long, word string, vector array<double>"))
    assert sorted((r["word"], r["vector"][0]) for r in sub.collect()) == [("a", 3.0), ("the", 1.0)]
    pairs = spark.createDataFrame([("cat", "dog"), ("cat", "none")], "src string, tgt string")
    assert files.known_pairs(pairs, v, files.text_vectors(spark, path, 2)).count() == 1 and files.identical_strings(v, v).count() == 2
    sinks.write_vectors(v, str(tmp_path / "out"))
    again = files.text_vectors(spark, str(tmp_path / "out"), 2).orderBy("line").collect()
    assert [(r["word"], r["vector"]) for r in again] == [("cat", [1, 2]), ("null", [0.01, 0])]


def test_other_sources(spark, tmp_path):
    a, b = put(tmp_path / "a", "one\ntwo\none\nfour\n"), put(tmp_path / "b", "eins\nzwei\ndrei\nzwei\n")
    rows = files.aligned_sentences(spark, a, b).collect()
    assert sorted((r["source"], r["target"]) for r in rows) == [("one", "eins"), ("two", "zwei")]
    assert [r["line"] for r in rows] == [r["line"] for r in files.aligned_sentences(spark, a, b).collect()]
    path = put(tmp_path / "t.csv", 'word,model,token_pieces\ncafé€,m,"[""ca"", ""fé€""]"\n', "cp1252")
    assert files.token_pieces(spark, path).first()["pieces"] == ["ca", "fé€"]
    lang = tmp_path / "en"
    lang.mkdir()
    assert files.preferred_gold(spark, str(lang)).count() == 0
    put(lang / "Other.jsonl", '{"word": "b"}')
    assert files.preferred_gold(spark, str(lang)).first()["word"] == "b"
    put(lang / "MorphoLex.jsonl", '{"word": "a"}')
    assert files.preferred_gold(spark, str(lang)).first()["word"] == "a"
    pages = spark.createDataFrame([(1, "en", "x\n\n#REDIRECT y\n z "), (1, "en", "x\n\n#REDIRECT y\n z "), (2, "en", "w"), (3, "de", "v")], "id long, lang string, text string")
    assert sorted((r["lang"], r["text"]) for r in files.wiki_paragraphs(pages, 2).collect()) == [("de", "v"), ("en", "x"), ("en", "z")]


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([("en", 0.5), ("de", None)], "lang string, f1 double")
    sinks.write_csv(m, str(tmp_path / "csv"), ["f1"])
    assert sorted((r["lang"], r["f1"]) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("de", "MISSING"), ("en", "0.5000")]
    assert files.recorded_metrics(spark, str(tmp_path / "csv")).columns == ["lang", "f1"]
    sinks.write_metrics(m, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    corpus = spark.createDataFrame([(i, f"text {i}\nmore", "en" if i % 2 else None) for i in range(50)], "para_id long, text string, lang string")
    sinks.write_corpus(corpus, str(tmp_path / "c"))
    read = lambda x: "".join(f.read_text() for f in sorted((tmp_path / "c" / x).glob("part-*"))).split("\n")[:-1]
    assert list(zip(read("text"), read("langs"), strict=True)) == [(f"text {i} more", "en" if i % 2 else "") for i in range(50)]


def test_word_similarity_vectors_and_axes(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    vecs = {f"w{i}": rng.normal(size=4) for i in range(20)}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()] + [("Cap", [1.0, 0.0, 0.0, 0.0])], "word string, vector array<double>")
    pairs = [(f"w{a}", f"w{b}", float(s)) for a, b, s in zip(rng.integers(0, 20, 30), rng.integers(0, 20, 30), rng.integers(0, 6, 30), strict=True) if a != b]
    got = align.word_similarity(spark.createDataFrame([*pairs, ("w1", "no", 1.0)], "w1 string, w2 string, score double"), table).first()
    cos = [vecs[a] @ vecs[b] / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b]) for a, b, _ in pairs]
    assert (got["found"], got["not_found"]) == (len(pairs), 1) and got["rho"] == pytest.approx(np.corrcoef(pd.Series([s for *_, s in pairs]).rank(), pd.Series(cos).rank())[0, 1])
    assert align.word_similarity(spark.createDataFrame([("cap", "w1", 1.0)], "w1 string, w2 string, score double"), table, lower=False).first()["found"] == 1
    words = spark.createDataFrame([(1, "w1"), (1, "w2"), (1, "w1"), (2, "no")], "id long, word string")
    idf = spark.createDataFrame([("w1", 1.0), ("w2", 2.0)], "word string, idf double")
    out = align.sentence_vectors(words, table, idf).collect()
    want = 2 * vecs["w1"] + 2 * vecs["w2"]
    assert [r["id"] for r in out] == [1] and np.allclose(out[0]["vector"], want / np.linalg.norm(want))
    x = np.array(list(vecs.values()))
    mean, axes = align.principal_axes(table.filter("word <> 'Cap'"), 2)
    u = np.linalg.svd(x - x.mean(axis=0))[2][:2]
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes @ u.T), np.eye(2), atol=1e-6)
    point = align.project(table, mean, axes).filter("word = 'w3'").first()["point"]
    assert np.allclose(point, axes @ (vecs["w3"] - mean))
