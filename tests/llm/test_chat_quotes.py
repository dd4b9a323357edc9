"""Quotation linking against a brute-force version in plain Python, on conversations that quote."""

import random
import re

import pytest

from corpuslab.llm import chat_quotes

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def normal(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")


def passages(text, quoted):
    """(level, lines) of every passage."""
    out, run, now = [], [], None
    for line in [*re.split(r"\r?\n", text), None]:
        m = re.match(r"(?:[ \t]*>)*", line or "")
        level, body = m[0].count(">"), (line or "")[m.end() :].strip(" ")
        if line is None or level != now or not body.strip():
            if run:
                out.append((now, run))
            run, now = [], level
        if line is not None and body.strip():
            run.append(body)
    return [(v, r) for v, r in out if (v > 0) == quoted]


def units(lines):
    found = [(0, normal("\n".join(lines)))]
    if len(lines) > 1:
        found += [(i + 1, normal(x)) for i, x in enumerate(lines) if len(x.split()) >= 3]
    return found


def brute(rows):
    wrote = {}
    for c, t, _, text in rows:
        if c is not None and t is not None:
            for _, lines in passages(text or "", False):
                for _, u in units(lines):
                    wrote[c, u] = min(t, wrote.get((c, u), t))
    linked, reply = {}, {}
    for c, t, _, text in {(c, t, None, x) for c, t, _, x in rows}:
        if c is None or t is None:
            continue
        for level, lines in passages(text or "", True):
            of = {}
            for line, u in units(lines):
                s = wrote.get((c, u))
                if s is not None and s < t:
                    whole, words = of.get(s, (False, 0))
                    of[s] = (True, len(u.split(" "))) if line == 0 else (whole, words if whole else words + len(u.split(" ")))
            if of:
                s = max(of, key=lambda s: (*of[s], s))
                linked[c, t, text] = linked.get((c, t, text), 0) + 1
                low, words = reply.setdefault((c, t), {}).get(s, (10**9, 0))
                reply[c, t][s] = (min(low, level), words + of[s][1])
    target = {m: max(of, key=lambda s: (-of[s][0], of[s][1], s)) for m, of in reply.items()}
    out = []
    for c, t, role, text in rows:
        thread, level = t, 0
        while (c, thread) in target:
            thread, level = target[c, thread], level + 1
        out.append((c, t, role, len(passages(text or "", True)), linked.get((c, t, text), 0), target.get((c, t)), thread, level))
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        texts = []
        for t in range(rng.randint(1, 14)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.8:  # quote an earlier message, whole or some lines, one level deeper
                    lines = rng.choice(texts).split("\n")
                    a = rng.randrange(len(lines))
                    parts.append("\n".join("> " + x.upper() if rng.random() < 0.2 else ">" + x for x in (lines if rng.random() < 0.5 else lines[a : a + 2])))
                else:
                    parts.append("> " + " ".join(rng.choices(WORDS, k=4)))
                parts.append(rng.choice(["", "\n", " ".join(rng.choices(WORDS, k=3))]))
            parts.append("\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4))))
            texts.append("\n".join(parts))
            rows.append((c, t, rng.choice(["user", "assistant"]), texts[-1]))
    return rows + rows[:5] + [(None, 3, "user", "> x y z"), (1, None, None, "> alpha"), (2, 99, "user", None), (0, 1, "user", "> another text of this turn\n" + rows[0][3])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_are_those_of_brute_force(spark, seed):
    rows = made(seed)
    out = chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = [(r["conv_id"], r["turn"], r["role"], r["n_quotes"], r["n_linked"], r["reply_to"], r["thread"], r["level"]) for r in out]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[4] for r in want) > 20 and any(r[7] > 1 for r in want) and all(r["n_linked"] <= r["n_quotes"] for r in out)
    assert not any(re.search(r"(?m)^[ \t]*>", r["text"]) for r in out)


def test_a_passage_counts_once(spark):
    rows = [(1, 0, "user", "one two three\nfour five six"), (1, 1, "user", "> one two three\n> four five six\nyes")]
    out = {r["turn"]: r for r in chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[1]["n_quotes"], out[1]["n_linked"], out[1]["reply_to"], out[1]["text"]) == (1, 1, 0, "yes")


def test_very_long_message(spark):
    text = "\n".join(f"> line number {i} of it" for i in range(20_000)) + "\nend"
    rows = [(1, 0, "user", "line number 5 of it"), (1, 1, "user", text)]
    out = {r["turn"]: r for r in chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1]["reply_to"] == 0 and out[1]["text"] == "end" and out[1]["n_linked"] == 1
