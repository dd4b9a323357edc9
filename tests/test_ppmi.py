"""N-grams counted inside the row."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import embed as E


def test_grams_are_counted_without_moving_words(spark):
    lists = [[], ["a"], ["b", "a", "b", "ab", "a", "b"]]
    rows = spark.createDataFrame([(x,) for x in lists], "g array<string>").select("g", T.gram_counts(F.col("g")).alias("c")).collect()
    assert [{c["feat"]: c["x"] for c in r["c"]} for r in rows] == [dict(Counter(r["g"])) for r in rows]
    words = spark.createDataFrame([("en", w) for w in ("banana", "bandana", "nan", "a", "aaaa")] + [("de", "nan")], "lang string, word string")
    got = {r["feat"]: (r["words"], r["ppmi"]) for r in E.summed_ppmi(words).collect()}
    x = words.select("lang", "word", F.explode(T.char_ngrams(F.lower("word"))).alias("feat")).groupBy("lang", "word", "feat").agg(F.count("*").alias("x"))
    want = {r["feat"]: (r["n"], r["p"]) for r in E.ppmi(x, ("lang", "word")).groupBy("feat").agg(F.count("*").alias("n"), F.sum("ppmi").alias("p")).collect()}
    assert {f: n for f, (n, _) in got.items()} == {f: n for f, (n, _) in want.items()} and all(got[f][1] == pytest.approx(want[f][1], abs=1e-9) for f in want)
    plan = E.summed_ppmi(words)._jdf.queryExecution().toString()
    assert "word#" not in plan  # words have been added up by their n-grams
