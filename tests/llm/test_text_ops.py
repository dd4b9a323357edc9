"""Tokenizers, packing, language ID, PII, HTML, licences, quotes and search against brute force or libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.llm import bpe, chat_quotes, html_extract, lang_id, license_scan, packing, pieces, pii, topk

ODD = [None, "", " ", "  a  b ", "it's they'll", "x\n\n y   z", "a" * 300, "日本語 テキスト", "\x1c \x85 b", "é <|endoftext|> 12 34.5", "tab\t\tend \n"]


@pytest.fixture(scope="session")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return bpe.read_ranks(f.readlines())


@pytest.fixture(scope="session")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'st.\n\t1é日  !")), max_size=4))
def test_words_are_those_of_the_pattern(texts):
    s = pieces.Splitter(P.PATTERN)
    words, codes, bounds = s.batch(pa.array(texts, pa.string()))
    assert [[words[c] for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [s.split(t) for t in texts]


def test_bounded_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["aaaa", None, "bbbbbbbbbb", "c", ""])], names=["i", "t"])
    assert [p.num_rows for p in pieces.bounded(batch, 5)] == [2, 1, 2]
    assert [p.num_rows for p in pieces.bounded(batch.slice(2), 5)] == [1, 2]
    assert sum(p.num_rows for p in pieces.bounded(batch, 1)) == 5 and not list(pieces.bounded(batch.slice(5), 5))


def test_encode_and_decode(spark, ranks, reference):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeth ing.,\né") for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.encode_documents(docs, ranks, P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(t) and bytes(r["decoded"]).decode() == t
    assert bpe.digest_documents(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_heap_merges_alike(ranks, reference):
    for w in ("a" * 500, "=" * 333, "thththinging" * 40):
        assert bpe.heap_merge(w.encode(), ranks) == reference.encode_ordinary(w)


def test_binary_lengths():
    for n in range(1, 3000):
        p = packing.binary_lengths(n, 1024)
        assert sum(p) == n and all(x & (x - 1) == 0 for x in p) and p == sorted(p, reverse=True) and len({x for x in p if x < 1024}) == sum(x < 1024 for x in p)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [*ODD, "and the thing " * 800]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a b")], "doc_id long, text string")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        rows = packing.pack(docs, f.read(), P.PATTERN, 1024).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert sum(r["doc_id"] is None for r in rows) >= 1
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        if i:
            assert [x for r in mine for x in r["ids"]] == want
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(want) and r["bucket"] == r["length"].bit_length() - 1


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_sums_to_one(order):
    """After any context, seen or not, the probabilities of all characters add up to one, in every language."""
    counts = [("en", w, n) for w, n in (("the", 5), ("then", 2), ("thing", 1), ("a", 3), ("net", 2))] + [("de", w, n) for w, n in (("der", 4), ("die", 1), ("ein", 2), ("eine", 1), ("das", 3))]
    model = lang_id.train(counts, order)
    known = sorted({c for _, w, _ in counts for c in w})
    alphabet = round(np.exp(-model.floor))
    for prefix in ("", "t", "th", "the", "ei", "zz", "tx", "ne"):
        total = np.zeros(2)
        for c in [*known, None, "ß"]:
            points, scored, _ = lang_id._marked([prefix + (c or "")], order)
            p = np.exp(model.steps(points, scored))[-1 if c is None else len(prefix)]
            total += p * (alphabet - len(known) - 1 if c == "ß" else 1)
        assert np.allclose(total, 1, atol=1e-4), (prefix, total)  # a probability is a thousandth of an unknown character at least
    assert (model.keys[order][:-1] < model.keys[order][1:]).all()
    assert model.words(["the"])[0][0].argmax() == model.langs.index("en") and model.words(["eine"])[0][0].argmax() == model.langs.index("de")


def test_equal_languages_give_the_first_name():
    model = lang_id.train([(x, w, 2) for x in ("b", "a") for w in ("one", "two")], 3)
    assert model.langs == ["a", "b"] and model.words(["one"])[0][0].argmin() == 0
    entropy, _ = lang_id.entropies(model, pa.array(["one two one"]))
    assert model.langs[entropy[0].argmin()] == "a"


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97 and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["rejected"] for r in out]) <= 0.02


def test_language_id_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("lang_pred"))
    extra = spark.createDataFrame([(10_001, None, "en", 1), (10_002, "12 !?", None, 1), (None, "the thing of the", "en", 1), (10_004, "the " * 50_000, None, 1)], docs.schema)
    out = {r["doc_id"]: r for r in lang_id.identify(docs.unionByName(extra)).filter("doc_id > 10000 or doc_id is null").collect()}
    assert out[10_001]["lang_pred"] == out[10_002]["lang_pred"] == "und" and out[10_001]["score"] == 0 and out[10_002]["rejected"]
    assert out[None]["lang_pred"] in ("en", "fr", "de", "es") and not out[None]["held_out"] and out[10_004]["lang_pred"] == "en"
    assert lang_id.identify(docs.limit(0)).count() == 0
    kept = lang_id.keep_known(docs.unionByName(extra))
    assert kept.columns == docs.columns and not {10_001, 10_002} & {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert all(r["lang_pred"] == "und" for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect())


VALID = [
    ("card", "4111 1111 1111 1111"), ("card", "5500-0055-5555-5559"), ("phone", "+1 (183) 555-1276"), ("phone", "(212) 555-0147"), ("phone", "+49 30 1234567"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ("iban", "GB82WEST12345698765432"), ("ip", "59.36.80.30"), ("date", "2021-03-14"), ("date", "14/03/2021"), ("date", "3/14/2021"), ("date", "05/06/1999"), ("date", "1.2.2003"), ("email", "anna.34@mail7.example.com"), ("secret", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'),
]
CLEAN = ["4111111111111112", "2021-13-45", "999.1.1.1", "31/02/2020", "127.0.0.1", "000-12-3456", "version 1.2.3", "1234567890123456", "12:30", "a@b", "DE00 0000 0000 0000 0000 00", "password = correcthorsebattery", "chapter 12-34"]


@pytest.mark.parametrize(("kind", "value"), VALID)
def test_values_are_permuted_within_their_format(kind, value):
    f = pii.Feistel("k")
    text = f"x {value} y {value}."
    new, counts = pii.replace(text, f)
    assert counts == {kind: 2} and value not in new and len(new) == len(text)
    assert pii.replace(text, pii.Feistel("other"))[0] != new
    a, b = new[2:].split(" y ")
    assert b == a + "."  # equal values stay equal
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() and c.islower() else "A" if c.isalpha() else c for c in s)
    if kind != "secret":
        assert shape(a) == shape(value)
    assert pii.replace(new, f)[1] == counts  # still valid
    assert pii.replace(new, f, back=True)[0] == text  # and the key leads back


@pytest.mark.parametrize("value", CLEAN)
def test_what_is_not_valid_stays(value):
    assert pii.replace(f"x {value} y", pii.Feistel("k")) == (f"x {value} y", {})


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 10**12), st.data())
def test_feistel_is_a_permutation(n, data):
    f, x = pii.Feistel("k"), data.draw(st.integers(0, n - 1))
    y = f.permute(x, n, "d")
    assert 0 <= y < n and f.permute(y, n, "d", back=True) == x


def test_pii_table(spark):
    rows = [(1, "mail a.b1@example.org now", "x"), (None, None, "y"), (2, "", None), (3, "7 words " * 20_000 + "59.36.80.30", "z"), (1, "mail a.b1@example.org now", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_values string")
    out = pii.find(docs, "k").collect()
    assert len(out) == 5 and sum(r["n_values"] for r in out) == 3 and out[0]["text"] == out[4]["text"] != rows[0][1] and out[1]["text"] is None
    assert pii.pseudonymise(docs, "k").columns == docs.columns and pii.find(docs.limit(0), "k").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="menu"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy now cheap things here today.</div><div id=cookie-notice>We use cookies, please accept all.</div>
<article><h1>The title</h1><p>First &amp; long paragraph with <b>bold</b> words &eacute;.<p>Second<br>paragraph &#8211; here.</p><aside>Related: other stories</aside><form><input><label>Mail</label></form>
<div class="share"><a href=x>Tweet</a></div><ul><li>One item</li></ul></article><section id="comments"><p>Great article, I read all of it with much joy, thanks.</p></section><footer>&copy; 2020 all rights reserved.</footer>"""


def test_html():
    assert html_extract.main_text(PAGE) == "The title First & long paragraph with bold words é. Second paragraph – here. One item"
    for x in (None, "", "<nav>", "<!-- open", "<script>x", "<p", "&"):
        assert isinstance(html_extract.main_text(x), str)
    assert html_extract.main_text(None) == "" and len(html_extract.main_text("<article><p>" + "word " * 100_000)) == 499_999
    plain = "<body><div><a href=1>a</a> <a href=2>b</a></div><div>" + "many plain words stand here " * 10 + "</div><div>" + "and again some more of them " * 10 + "</div><div><a href=3>next</a></div>"
    assert html_extract.main_text(plain).startswith("many plain") and "next" not in html_extract.main_text(plain)


def test_tree_learns_its_table():
    assert np.mean([html_extract.tree().decide(r) == r[-1] for r in html_extract.labelled()]) >= 0.96


def test_html_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        import html as H
        import re

        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert " ".join(out[r["page_id"]]["text"].split()) == want and out[r["page_id"]]["n_chars"] == len(out[r["page_id"]]["text"])


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    b = rng.integers(97, 101, 400).astype(np.uint8)
    h = license_scan.hashes(b)
    power = [pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(license_scan.K)]
    raw = [sum((int(b[i + j]) + 1) * 0x9E3779B97F4A7C15 * power[j] for j in range(license_scan.K)) % 2**64 for i in range(len(h))]
    assert [(x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64 for x in raw] == h.tolist()
    at = set(license_scan.winnow(h).tolist())
    assert all(any(i + j in at and h[i + j] == h[i : i + 8].min() for j in range(8)) for i in range(len(h) - 7))


def test_licenses(spark):
    t = license_scan.TEMPLATES
    mit = t["MIT/grant"].upper().replace("SUBLICENSE, ", "").replace(" ", "\n  ")
    rows = [(1, "é Released under the MIT\n License. And more"), (2, "clean words only, licensed drivers under the bridge"), (3, None), (4, ""), (5, "x " * 30_000 + t["Apache-2.0/header"] + " y"), (6, mit), (None, t["GPL-3.0/line"]), (7, t["MIT/line"] + " " + t["MIT/line"]), (1, "no")]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r["doc_id"]), r["license"]) for r in out)
    assert got == [("1", "MIT/line"), ("5", "Apache-2.0/header"), ("6", "MIT/grant"), ("7", "MIT/line"), ("7", "MIT/line"), ("None", "GPL-3.0/line")]
    one = next(r for r in out if r["doc_id"] == 1)
    assert rows[0][1][one["start"] : one["end"]] == "Released under the MIT\n License" and one["coverage"] == 1
    assert 0.95 < next(r for r in out if r["doc_id"] == 6)["coverage"] < 1


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I open the file?\nIt will not open here.", "a"), (1, 1, "assistant", "Try the other menu, please.", "a"), (1, 2, "user", "On Monday bot wrote:\n> Try the other menu, please.\n>> How do I open the file?\nThat worked.", "a"),
        (1, 3, "assistant", "> That worked.\n\nGood.", "a"), (1, 4, "user", "> never said by anyone here\nHm.", "a"), (2, 0, "user", None, None), (2, 1, None, "", "b"), (None, 1, "user", "> Try the other menu, please.", "b"), (2, 1, None, "", "b"),
    ]
    out = chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string")).collect()
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[1, 2]["text"] == "That worked." and by[1, 2]["reply_to"] == 1 and by[1, 2]["n_quotes"] == 2
    assert by[1, 3]["text"] == "Good." and by[1, 3]["reply_to"] == 2 and by[1, 3]["thread"] == 1 and by[1, 3]["level"] == 2
    assert by[1, 4]["reply_to"] is None and by[1, 4]["text"] == "Hm." and by[1, 4]["thread"] == 4
    assert by[2, 0]["text"] == "" and by[None, 1]["reply_to"] is None
    assert by[1, 0]["text"] == rows[0][3]
    formatted = {r["turn"]: r["message"] for r in chat_quotes.chat_format(spark.createDataFrame(out)).filter("conv_id = 1").collect()}
    assert formatted[3] == "<|assistant|>\nGood."


def test_quotes_empty(spark):
    assert chat_quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for i in range(300)]
    rows += [(i, rows[7][1], 0) for i in range(300, 420)]  # many equal vectors
    rows += [(500, None, 0), (501, [None] * 8, 0), (550, [float("nan")] * 8, 0), (600, [1.0], 0), (None, rows[1][1], 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, block=64, query_block=3, enough=8).collect()
    fits = [(i, v) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and None not in v and not np.isnan(v).any()]
    x = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in fits]
    for q in {i for i, _ in x if i % 50 == 0}:
        # every row counts, and the two rows of id 50 share a list
        want = sorted((-int(v @ w), c) for i, v in x if i == q for c, w in x if c != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df.filter("vec_id in (0, 1, 2)"), F.lit(True)).count() == 6


@pytest.mark.parametrize(("kind", "value", "rest"), [
    ("card", "4111 1111 1111 1111", " 123"), ("card", "4111111111111111", " 12/27"), ("card", "4111-1111-1111-1111", "-123"), ("iban", "AT61 1904 3002 3457 3201", " BIC"), ("iban", "AT611904300234573201", " CODE"),
    ("phone", "+49 171 1234567", " 2024 123"), ("secret", "api_key = " + "a1B2" * 100, ""), ("secret", "token: " + "0f" * 5000, ""),
])
def test_values_before_more_text_are_found(kind, value, rest):
    for key in map(str, range(20)):
        f = pii.Feistel(key)
        text = f"x {value}{rest}, y"
        new, counts = pii.replace(text, f)
        assert counts == {kind: 1} and value not in new and len(new) == len(text) and new.endswith(f"{rest}, y")
        assert pii.replace(new, f, back=True)[0] == text


def test_a_phone_is_the_same_however_it_is_written():
    f = pii.Feistel("k")
    digits = {"".join(c for c in pii.replace(f"x {v} y", f)[0] if c.isdigit()) for v in ("+49 171 1234567", "+49171 1234567", "+491711234567", "+49-171-123-4567")}
    assert len(digits) == 1 and digits.pop()[:2] == "49"
    assert pii.replace("x +353861234567 y", f)[0].startswith("x +353") and pii.replace("x +12125550147 y", f)[0].startswith("x +1")


def test_packing_cuts_out_added_tokens(spark, tmp_path):
    """The query's ids are those of the library's default setting."""
    from tokenizers import Tokenizer

    from corpuslab.llm import queries

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " \n<|endoftext|>\n ", "<|endoftext| > <|endoftext", "tail " * 3000 + "<|endoftext|> x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_packing(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [(r["start"], r["length"]) for r in mine][-1] == (len(want) - mine[-1]["length"], mine[-1]["length"])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(want) for r in mine)


def test_rare_languages_keep_their_words(spark):
    """Seventy languages, of which two use many words often; the others' words are seen once."""
    rows = [(i, f"{'word' if i < 2 else 'rare'}{chr(97 + i // 26)}{chr(97 + i % 26)} " * (40 if i < 2 else 1) + " ".join(f"w{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20)) * (3 if i < 2 else 1), f"l{i:02d}") for i in range(70) for _ in (0, 1)]
    labelled = spark.createDataFrame([(n, t, x) for n, (_, t, x) in enumerate(rows * 10)], "doc_id long, text string, lang string")
    few, _ = lang_id._sample(labelled, 600, 1)
    assert {x for x, _, _ in few} == {f"l{i:02d}" for i in range(70)} and len(few) == 70
