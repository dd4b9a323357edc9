"""License scans against a brute-force local alignment of every template with every text, without index and band."""

import random

import pytest

from corpuslab.llm import license_scan as L


def words(text):
    return bytes(L.normalise(text.encode())[0]).split()


def brute(template, text):
    """Most matched words of a best local alignment (match 2, mismatch and gap -1)."""
    a, b = words(template), words(text)
    prev, best = [(0, 0)] * (len(b) + 1), (0, 0)
    for t in a:
        now = [(0, 0)]
        for j, w in enumerate(b):
            s, m = prev[j]
            cell = max((s + 2, m + 1) if t == w else (s - 1, m), (prev[j + 1][0] - 1, prev[j + 1][1]), (now[j][0] - 1, now[j][1]), key=lambda c: c[0])
            now.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, now[-1], key=lambda c: c[0])
        prev = now
    return best[1], len(a)


def altered(rng, text, rate):
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < rate / 3 else [w, "inserted"] if x < 2 * rate / 3 else ["changed"] if x < rate else [w]
    return " ".join(out)


@pytest.mark.parametrize("rate", [0.0, 0.04, 0.1, 0.3])
def test_matches_are_those_of_brute_force(spark, rate):
    rng, rows, planted = random.Random(int(rate * 100)), [], []
    names = sorted(n for n in L.TEMPLATES if "/line" not in n and "/short" not in n)
    for i, name in enumerate(names):
        noise = [" ".join(rng.choices("the of software and a use without any form text other words".split(), k=30)) for _ in range(2)]
        planted.append(altered(rng, L.TEMPLATES[name], rate))
        rows.append((i, f"{noise[0]}.\n{planted[-1]}\n{noise[1]}"))
    found = {}
    for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r
    for i, name in enumerate(names):
        matched, size = brute(L.TEMPLATES[name], rows[i][1])
        mine = found.get(i, {})
        if matched >= 0.8 * size:  # it, or a longer licence that holds it
            best = max(mine.values(), key=lambda r: r["matched_words"])
            assert best["license"] == name or best["matched_words"] >= matched, (name, mine)
            if best["license"] == name:
                assert abs(best["matched_words"] - matched) <= 2 and best["template_words"] == size
        else:
            assert name not in mine


def test_templates_are_winnowed():
    idx = L.index()
    total = sum(max(0, len(t) - L.K + 1) for t in idx.texts)
    assert len(idx.places) < 0.4 * total and all(any(p[0] == i for p in idx.places) for i in range(len(idx.names)))


def test_every_template_is_found_anywhere(spark):
    rows = [(i, f"prefix words {i} {L.TEMPLATES[n]} suffix words") for i, n in enumerate(L.index().names)]
    found = {(r["doc_id"], r["license"]): r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((i, n) in found and found[i, n]["coverage"] == 1 for i, n in enumerate(L.index().names))
    for (i, n), r in found.items():
        if L.index().names[i] == n:
            assert words(rows[i][1][r["start"] : r["end"]]) == words(L.TEMPLATES[n])


def test_repeated_phrases_are_cheap():
    """A phrase of many templates, 20,000 times: its groups are told from matches without alignment."""
    text = ("permission is hereby granted " + "other words ") * 20_000
    norm = L.normalise(text.encode())[0]
    h = L.hashes(norm)
    assert L.scan(norm, L.index().hits(h, L.winnow(h)), L.index(), 0.8) == []


def test_table_edges(spark):
    rows = [(1, "x", "MIT"), (1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert [(r["doc_id"], r["license"]) for r in L.scan_licenses(docs).collect()] == [(1, "MIT/line")] * 2 and L.scan_licenses(docs.limit(0)).count() == 0
