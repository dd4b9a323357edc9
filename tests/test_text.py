"""Text functions against direct restatements on tiny inputs."""

import re
import time

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X
from corpuslab.functions import text as T
from corpuslab.operators import decode as D

WORDS = ["", ".", ",", "Word", "WORD", "word", "a-b", "A-b", "3.14", "2024-09-04", "x@y.org", "see http://a.b/c", "😀", "Éa", "éa", "ÉA", "日本", "1,000.5", "Hello World", "hello World", "O'Neil", "--", "**", "straße", "ǅ", "٣"]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_token_class(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "t string").select("t", T.token_class(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == {w: X.CLASSES[D.token_class(w)] for w in WORDS}


@pytest.mark.parametrize("text", ["", "call 12 or 13, see http://a.b/c. mail x@y.org", "2024-09-04", "www.a.b 1 2", "no numbers", "+5 -6.5 1 000 000"])
def test_protected_spans(spark, text):
    got = one(spark, T.protected_spans, text)
    assert [(r["s"], r["e"]) for r in got] == D.spans_of(text)


@pytest.mark.parametrize("text", ["abc", "éa", "a‍b", "x️y", "́a", "a‍", "🚀b"])
def test_blocked_cuts(spark, text):
    assert one(spark, T.blocked_cuts, text) == [k for k, ok in enumerate(D.cuts_of(text)) if not ok]


@pytest.mark.parametrize(("text", "want"), [("#REDIRECT x", True), ("r e d i r e c t", True), ("Weiterleitung", True), ("plain", False), ("RE DI RECT", True)])
def test_redirect(spark, text, want):
    assert one(spark, T.is_redirect, text) is want


@pytest.mark.parametrize(("text", "punct", "mixed", "script"), [("", False, False, "other"), (" ", False, False, "other"), ("., ", True, False, "other"), ("aд", False, True, "en"), ("да", False, False, "ru"), ("日x", False, True, "ja"), ("¿?", True, False, "other"), ("a.", False, False, "en")])
def test_predicates(spark, text, punct, mixed, script):
    assert one(spark, T.is_punct_only, text) is punct is D.punct_only(text)
    assert one(spark, T.is_mixed_script, text) is mixed
    assert one(spark, T.script_guess, text) == script == D.script_of(text)


@pytest.mark.parametrize("tokens", [[], ["a", ".", ",", "b", "**", "**", "c"], ["日", "本", "x", "語"], ["日"] * 19, [".", " ", "a", "''", "'''"], ["日本語", "日本", "語"]])
def test_tidy(spark, tokens):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(T.merge_cjk(T.clean_runs(F.col("t"))).alias("x")).first()["x"] == D.tidy(tokens)


@pytest.mark.parametrize(("text", "want"), [("hello", ["he", "el", "ll", "lo", "hel", "ell", "llo", "hell", "ello"]), ("", []), ("a", []), ("🚀b", ["🚀b"])])
def test_ngrams(spark, text, want):
    assert one(spark, T.char_ngrams, text) == want


def test_locate_and_spans(spark):
    df = spark.createDataFrame([("ab ab c", ["ab", "ab", "x", "c"])], "t string, k array<string>")
    got = df.select(T.locate_tokens(F.col("t"), F.col("k")).alias("x"), T.token_spans(F.col("k")).alias("y")).first()
    assert [(r["s"], r["e"]) for r in got["x"]] == [(0, 2), (3, 5), (None, None), (6, 7)]
    assert [(r["s"], r["e"]) for r in got["y"]] == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_perturbations(spark):
    got = spark.createDataFrame([("abcd", 5), ("a", 3), ("", 1)], "t string, s long").select(T.perturbations(F.col("t"), F.col("s")).alias("x")).collect()
    assert got[0]["x"] == ["abdc", "acd", "ábçd"] and got[1]["x"] == ["á"] and got[2]["x"] == [""]


def test_patterns_compile():
    for p in (X.URL, X.EMAIL, X.NUMBER, X.EMOJI):
        D._python(p)
    assert re.fullmatch(X.IDENTIFIER, "a_1")


def test_offsets_and_runs_are_linear_in_long_lines(spark):
    from corpuslab.operators import evaluate as E

    texts = ["a ab. a", "", "x" * 5 + " " + "é " * 3, "日本 a 日本"]
    rows = spark.createDataFrame([(i, t, re.findall(r"\w+", t)) for i, t in enumerate(texts)] + [(9, "ab", ["b", "a", "q"])], "id long, text string, tokens array<string>")
    got = {r["id"]: r["spans"] for r in E.token_offsets(rows).collect()}
    for r in rows.select("id", T.locate_tokens(F.col("text"), F.col("tokens")).alias("x")).collect():
        assert [(a["s"], a["e"]) for a in got[r["id"]]] == [(a["s"], a["e"]) for a in r["x"]]
    assert {r["id"]: (r["tokens"], r["kept"]) for r in D.kept_counts(spark.createDataFrame([(1, ["a", ".", ",", "_", "b"]), (2, [])], "id long, tokens array<string>")).collect()} == {1: (5, 3), 2: (0, 0)}
    one_line = spark.createDataFrame([(1, "word, , " * 200_000)], "id long, text string")
    began = time.time()  # searches from the beginning would take 4e10 steps
    found = E.token_offsets(one_line.select("id", "text", T.words(F.col("text")).alias("tokens"))).select(F.element_at("spans", -1)["e"].alias("e")).first()
    assert found["e"] == 8 * 200_000 - 4 and time.time() - began < 60


@pytest.mark.parametrize("text", ["", " ", "a b c", "a b c d", "  a b c  ", " a b c d　 ", "a  b c", "a\tb c d e", "   ", "x" * 50, "a b c ", "日 本 語 x"])
def test_spaces_are_told_early(spark, text):
    assert one(spark, T.too_many_spaces, text) is (text.strip().count(" ") > 2)


@pytest.mark.parametrize("text", ["redİrect", "REDİRECT", "red i　rect", "w e\titerleitung", "yönlendİr", "YÖNLENDIR", "redırect", "ПЕРЕНАПРАВ", "إعادةتوجيه", "UMLEITEN", "転送", "direct red", "x"])
def test_redirects_are_not_lost_before_the_patterns(spark, text):
    t = F.col("t")
    exact = lambda t: T.matches(t, "(?u)" + X.REDIRECT) | F.regexp_replace(F.upper(t), rf"{X.SPACE}+", "").contains("REDIRECT") | F.regexp_replace(F.upper(t), rf"{X.SPACE}+", "").contains("WEITERLEITUNG")
    assert one(spark, T.is_redirect, text) == one(spark, exact, text)
