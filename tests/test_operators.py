"""Decoder, learner, gold, metrics, vectors and experiments on small inputs."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import affixes as A
from corpuslab.operators import align as AL
from corpuslab.operators import decode as D
from corpuslab.operators import embed as E
from corpuslab.operators import experiments as X
from corpuslab.operators import gold as G
from corpuslab.operators import learn as L
from corpuslab.operators import metrics as M
from corpuslab.sources import corpus as C

VOCAB = {t: (float(len(t)) ** 0.5, 0.1 * i) for i, t in enumerate(["a", "b", "c", " ", "ab", "bc", "abc", "a b", "Ca", "C", ".", "ca"])}


def enumerate_cost(model, text, lang):
    """Least cost over all segmentations."""
    best = math.inf
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        toks = [text[a:b] for a, b in itertools.pairwise(at)]
        if not all(t in VOCAB for t in toks):
            continue
        cost, before = 0.0, D.BOS
        for t in toks:
            c, cls = model.arc(t, lang, False)
            cost, before = cost + c + model.turn[before][cls], cls
        best = min(best, cost)
    return best


@pytest.mark.parametrize("text", ["a", "abc", "abcabc", "a b c", "Cab.", "CaCa b", "abc abc.a", "cacacaca"])
@pytest.mark.parametrize("gamma", [0.0, 0.7])
def test_decoder_is_optimal(text, gamma):
    model = D.Model(VOCAB, {"gamma_boundary": gamma}, lam=0.1, bigram={("lower", "lower"): 0.2, ("<BOS>", "InitCap"): -0.5})
    tokens, used, low = D.decode(model, text, "en")
    assert low[-1] == pytest.approx(enumerate_cost(model, text, "en")) and used <= set(VOCAB)


def test_decoder_rules():
    model = D.Model({c: (1.0, 0.0) for c in "abcdefghijklmnopqrstuvwxyz :/.@1234567890"})
    assert D.decode(model, "a 12 b", "en")[0] == ["a", " ", "12", " ", "b"]  # a protected span is one free token
    assert D.decode(model, "go http://example.org/far/too/long now", "en")[0] == list("go http://example.org/far/too/long now")  # no path: characters
    assert D.decode(model, "", "en")[0] == [] and D.decode(D.Model({}), "日本", "ja")[0] == ["日本"]
    assert D.decode(D.Model(VOCAB), "abc", "en", frozenset("abc"))[0] == ["a", "b", "c"]
    gold = D.Model(VOCAB | {"cab": (1.0, 0.0)}, gold={("en", "cab"): [1]}, gold_reward=5.0)
    assert D.decode(gold, "cab", "en")[0] == ["c", "ab"]


def test_decode_words_sql(spark):
    words = spark.createDataFrame([("abc",), ("cab",), ("xq",), ("abcabc",)], "word string")
    cost = {"a": 1.0, "b": 1.5, "c": 1.0, "ab": 2.0, "bc": 1.2, "abc": 2.5}
    got = {r["word"]: r["cost"] for r in D.decode_words_sql(words, spark.createDataFrame(list(cost.items()), "tok string, cost double"), 3).collect()}
    assert got == {"abc": pytest.approx(2.2), "cab": pytest.approx(3.0), "abcabc": pytest.approx(4.4)}


def test_training_saves_and_reloads(spark, tmp_path):
    texts = ["walking and walked", "the walker was walking", "talking and talked", "the talker was talking"] * 2
    paras = spark.createDataFrame([(i, f"{t} {i}", "en") for i, t in enumerate(texts)], "para_id long, text string, lang string")
    learned = L.train(paras, max_iterations=3, max_token_len=6, min_freq=2, gamma_boundary=0.1, top_k_add=4)
    assert learned.history and all(h["best_rc"] < 0 for h in learned.history) and len(learned.vocab) > len({c for t in texts for c in t})
    total = lambda v: sum(r["c"] for r in D.decode_paragraphs(paras, D.Model(v, learned.params), with_costs=True).select(F.element_at("dp_min", -1).alias("c")).collect())
    assert total(learned.vocab) < total({t: c for t, c in learned.vocab.items() if len(t) == 1})
    L.save(spark, learned, str(tmp_path / "m"))
    again = L.load(spark, str(tmp_path / "m"))
    assert again.vocab == learned.vocab and again.lam == learned.lam and again.params == learned.params
    small = L.train(paras, max_iterations=3, budget=len(learned.vocab) - 3, max_token_len=6, min_freq=2, gamma_boundary=0.1, top_k_add=4)
    assert len(small.vocab) <= len(learned.vocab)
    same = L.tokenize(spark.createDataFrame([(1, texts[0] + " 0", None), (2, "neu", "de")], "para_id long, text string, lang string"), learned, corpus=paras)
    assert {r["para_id"]: r["lang"] for r in same.collect()} == {1: "en", 2: "de"}


def test_bisection():
    assert abs(L.bisect(lambda lam: round(100 - 10 * lam), 60, 0.0, 2.0) - 4.0) < 0.1


def test_affixes(spark, tmp_path):
    toks = spark.createDataFrame([("en", "unhappiness"), ("en", "un"), ("de", "Zeitung"), ("xx", "ing")], "lang string, tok string")
    got = {r["tok"]: (r["has_pre"], r["has_suf"]) for r in A.affix_flags(toks, A.affix_table(spark)).collect()}
    assert got == {"unhappiness": (True, True), "un": (False, False), "Zeitung": (False, True), "ing": (False, False)}
    (tmp_path / "a.json").write_text(json.dumps({"en": {"pre": ["zz"], "suf": []}}))
    over = A.read_overrides(spark, A.affix_table(spark), str(tmp_path / "a.json"))
    assert [r["affix"] for r in over.filter("lang = 'en'").collect()] == ["zz"] and over.filter("lang = 'de'").count() > 0


def test_gold_sources(spark, tmp_path):
    meta = json.dumps({"segmentation": [{"span": [0, 1, 2, 3], "type": "stem"}, {"span": [4, 5, 6], "type": "suffix"}]})
    (tmp_path / "x.useg").write_text(f"walking\tv\tx\twalk + ing\t{meta}\nredo\tv\tx\tre+do\t{{}}\nshort\trow\n")
    rows = {r["word"]: r for r in G.read_useg(spark, str(tmp_path / "x.useg")).collect()}
    assert rows["walking"]["boundaries"] == [4] and [s["type"] for s in rows["redo"]["segments"]] == ["prefix", "suffix"] and rows["redo"]["boundaries"] == [2]
    (tmp_path / "g.jsonl").write_text('{"word": "a", "segments": [{"start": 0, "end": 1, "type": "stem"}]}\nbroken\n{"word": "b", "segments": []}\n')
    assert [r["word"] for r in G.read_gold(spark, str(tmp_path / "g.jsonl")).collect()] == ["a"]


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("hello world\n\nWir gehen\n")
    (tmp_path / "l.txt").write_text("en\nen\nde\n")
    got = C.text_corpus(spark, str(tmp_path / "t.txt"), str(tmp_path / "l.txt")).orderBy("para_id").collect()
    assert [(r["para_id"], r["lang"]) for r in got] == [(0, "en"), (2, "de")]
    (tmp_path / "l.txt").write_text("en\n")
    with pytest.raises(ValueError, match="lines"):
        C.text_corpus(spark, str(tmp_path / "t.txt"), str(tmp_path / "l.txt"))
    s = spark.createDataFrame([(1, ["a"], "en"), (2, ["#REDIRECT"], "en"), (3, [" "], "en"), (4, ["b"], "en")], "id long, tokens array<string>, lang string")
    assert [r["id"] for r in C.joined_tokens(s, 2).orderBy("id").collect()] == [1, 4] and C.take_then_filter(s, 3).count() == 2


def test_metrics_edges(spark):
    pairs = spark.createDataFrame([(2, 0), (3, 3)], "a long, b long")
    r = M.pair_consistency(pairs).first()
    assert r["length_ratio_mean"] == 1 and r["length_ratio_stdev"] == 0 and r["median_abs_token_diff"] == 1
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 5.0)], "a double, b double")
    assert M.correlations(rows, "a", "b").first()["spearman"] == pytest.approx(0.8660254)
    gold = spark.createDataFrame([([1, 2], [2, 3]), ([1], None)], "g array<int>, p array<int>").select(*[c.alias(k) for k, c in M.boundary_counts(F.col("g"), F.col("p")).items()])
    assert tuple(M.micro_f1(gold).first())[1:] == (0.5, pytest.approx(1 / 3), pytest.approx(0.4))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    pairs = spark.createDataFrame([(v.tolist(), (q @ v).tolist()) for v in x], "x array<double>, y array<double>")
    w = AL.procrustes(pairs, 6)
    assert np.allclose(w, q, atol=1e-8) and np.allclose(w.T @ w, np.eye(6), atol=1e-10)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in AL.neighbours(v, v, 3, block=16, same=True).collect():
        order = [j for j in np.argsort(-(u[r["id"]] @ u.T), kind="stable") if j != r["id"]]
        assert r["nid"] == order[r["rank"] - 1]
    a = np.diag([1.0, 2.0, 3.0]) + 0.1
    c = np.array([[1.0], [2.0], [3.0]])
    assert np.allclose(E.conjugate_gradient(lambda z: a @ z, c, 1e-14), np.linalg.solve(a, c))


def test_experiments(spark):
    assert [r["name"] for r in X.expand_grid("e", {"a": [1, 2]}, 2)] == ["e_combo1_run1", "e_combo1_run2", "e_combo2_run1", "e_combo2_run2"]
    assert X.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert X.bigram_keys({"lower|||NUM": 1}) == {("lower", "NUM"): 1.0}
    t = X.search(lambda p: 1 / p["x"], {"x": [0, 2, 4]}, 12)
    assert t[0]["value"] == 0.25 and t[-1]["value"] == float("inf") and X.trials_table(spark, t).count() == 12
