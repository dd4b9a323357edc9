"""Queries that take tokens of the default greatest length, against SQL or brute force on the smallest tables."""

import math

import duckdb
import pytest

from corpuslab.functions import fixed as X
from corpuslab.plans import learn, stats


@pytest.mark.parametrize("name", ["substring_counts", "candidate_filter_reasons", "candidate_costs", "base_token_costs", "occurrence_index"])
def test_spans_of_the_default_length(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = stats.QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(stats.SQL[name]).df()[list(out.columns)]
    if "tok" in out:
        assert out["tok"].str.len().max() == X.DEFAULTS["max_token_len"]
    key = out.columns[0]
    out, want = out.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True)
    assert len(out) == len(want)
    for c in out.columns:
        same = (out[c] - want[c]).abs() < 2e-6 if out[c].dtype.kind == "f" else out[c] == want[c]
        assert same.all(), c


def test_all_words_are_decoded(spark, tmp_path):
    texts = ["internationalisation of the internationalisations", "an internationalisation, the nation and a tion", "the longest-of-all Donaudampfschifffahrtsgesellschaft the nation"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: r["cost"] for r in learn.decode_words(spark, str(tmp_path)).collect()}
    words = sorted({r["w"] for r in learn.C.document_words(spark.read.parquet(f"{tmp_path}/documents.parquet")).selectExpr("lower(word) AS w").collect()})
    counts = {}
    for w in words:
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 14) + 1):
                counts[w[i:j]] = counts.get(w[i:j], 0) + 1
    counts = {t: n for t, n in counts.items() if n >= 3 or len(t) == 1}
    total = sum(counts.values())
    for w in words:
        best = [0.0] + [math.inf] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = min(best[i] - math.log(counts[w[i:j]] / total) for i in range(max(0, j - 14), j) if w[i:j] in counts)
        assert got[w] == pytest.approx(best[-1], abs=2e-6)
    assert set(got) == set(words) and max(map(len, got)) > 8


def _small(spark, path):
    texts = [f"{a} {b} the {c} nations" for a in ("walking", "talking", "working") for b in ("internationally", "nationally") for c in ("other", "seven")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")


def test_growth_runs_until_nothing_improves(spark, tmp_path, monkeypatch):
    _small(spark, tmp_path)
    seen, train = [], learn.L.train
    monkeypatch.setattr(learn.L, "train", lambda *a, **k: seen.append((k, train(*a, **k))) or seen[-1][1])
    rows = learn.vocab_growth(spark, str(tmp_path)).collect()
    assert seen[0][0] == {} and max(r["iteration"] for r in rows) > 1 and max(len(r["token"]) for r in rows) > 4
    assert {r["token"] for r in learn.pricing_topk(spark, str(tmp_path)).collect()} == {r["token"] for r in rows if r["iteration"] == 1}
    monkeypatch.setattr(learn, "BUDGET", 30)
    left = {r["token"] for r in learn.budget_bisection(spark, str(tmp_path)).collect()}
    grown = seen[0][1].vocab
    assert left <= set(grown) and len(left) < len(grown) and {t for t in grown if len(t) == 1} <= left
