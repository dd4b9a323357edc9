"""Text functions as Column expressions: scripts, classes, filters, spans, graphemes.

All run inside the JVM. Offsets count code points.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions import fixed as X


#: The characters of X.SPACE.
ALL_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform gives it a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _java(pattern: str) -> str:
    """The same pattern in Java's spelling of scripts."""
    for script in ("Han", "Hiragana", "Katakana", "Cyrillic", "Greek", "Arabic", "Hebrew", "Tamil", "Latin"):
        pattern = pattern.replace(rf"\p{{{script}}}", rf"\p{{Is{script}}}")
    return pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(_java(pattern))


def punct_class() -> str:
    """A regular-expression class of the punctuation list and white space."""
    escaped = "".join("\\" + c if c in X.ASCII_PUNCTUATION else c for c in X.PUNCTUATION)
    return rf"[{escaped}\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, rf"\A{X.SPACE}+|{X.SPACE}+\z", "")


# ---- predicates -----------------------------------------------------------------------------------


def may_redirect(text: Column) -> Column:
    """Holds wherever is_redirect or X.REDIRECT does: letters of each spelling that have one lower case only, white space left out."""
    low = F.lower(text)
    tight = F.translate(low, ALL_SPACES, "")
    has = lambda x, *parts: reduce(Column.__and__, [x.contains(p) for p in parts])
    return has(tight, "red", "rect") | has(tight, "terle", "tung") | has(low, "uml") | has(low, "nlend") | has(low, "перен") | has(low, "إعادة") | has(low, "転送")


def is_redirect(text: Column) -> Column:
    """The patterns run where `may_redirect` holds."""
    plain = F.regexp_replace(F.upper(text), rf"{X.SPACE}+", "")
    found = matches(text, "(?u)" + X.REDIRECT)
    for word in X.REDIRECT_PLAIN:
        found = found | plain.contains(word)
    return may_redirect(text) & found


def is_punct_only(text: Column) -> Column:
    """Punctuation or white space only, and something besides white space."""
    return matches(text, full(punct_class() + "+")) & matches(text, X.NON_SPACE)


def script_flags(text: Column) -> list[Column]:
    """Whether letters of each script group occur: Cyrillic, Arabic, Greek, Japanese, any other letter."""
    groups = [r"\p{IsCyrillic}", r"\p{IsArabic}", r"\p{IsGreek}", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"]
    return [*(text.rlike(rf"[\p{{L}}&&{g}]") for g in groups), text.rlike(r"[\p{L}&&[^\p{IsCyrillic}\p{IsArabic}\p{IsGreek}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]")]


def is_mixed_script(text: Column) -> Column:
    """Letters of all groups but the last are beyond U+036F."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x{00}-\x{36F}]") & (sum((f.cast("int") for f in script_flags(text)), F.lit(0)) >= 2)


def internal_spaces(text: Column) -> Column:
    t = strip(text)
    return F.length(t) - F.length(F.translate(t, " ", ""))


def too_many_spaces(text: Column, k: int = 2) -> Column:
    """internal_spaces(text) > k, told at the first k + 1 spaces."""
    return matches(text, rf"\A{X.SPACE}*+{X.NON_SPACE}(?:[^ ]*+ ){{{k + 1}}}{X.SPACE}*+{X.NON_SPACE}")


def is_protected(token: Column) -> Column:
    return matches(token, X.URL) | matches(token, full(X.EMAIL)) | matches(token, full(X.NUMBER))


def is_all_cjk(text: Column) -> Column:
    """True for the empty string."""
    return matches(text, full(X.CJK + "*"))


def is_all_tamil(text: Column) -> Column:
    return matches(text, full(r"[\x{0B80}-\x{0BFF}]+"))


# ---- projections ----------------------------------------------------------------------------------


def token_class(token: Column) -> Column:
    """The first class that fits, in the order of the cost model."""
    cased, lower, upper = r"[\p{Lu}\p{Lt}]", r"\p{Ll}", r"\p{Lu}"
    return (
        F.when(token.isin(*X.END_MARKS), "EOS")
        .when(token.isin(*X.COMMA_MARKS), "PUNCT")
        .when(matches(token, X.URL), "URL")
        .when(matches(token, full(X.EMAIL)), "EMAIL")
        .when(matches(token, full(X.NUMBER)), "NUM")
        .when(matches(token, X.EMOJI), "EMOJI")
        .when(matches(token, cased) & matches(token, X.TITLE.replace(")*(", ")*+(")), "InitCap")
        .when(matches(token, upper) & ~matches(token, r"[\p{Ll}\p{Lt}]"), "ALLCAPS")
        .when(matches(token, lower) & ~matches(token, cased), "lower")
        .when(token.contains("-"), "hyphen")
        .otherwise("other")
    )


def script_label(ch: Column) -> Column:
    """Script of one character."""
    label = None
    for name in ("Cyrillic", "Arabic", "Greek", "Hiragana", "Katakana", "Han"):
        when = (label.when if label is not None else F.when)
        label = when(matches(ch, rf"\p{{{name}}}"), "CJK" if name == "Han" else name)
    return label.when(matches(ch, full(r"[\x{00}-\x{7F}]")), "Latin").otherwise("other")


def script_guess(text: Column) -> Column:
    """Language code by the script of the first letter; other if there is no letter."""
    first = F.regexp_extract(text, r"\p{L}", 0)
    return (
        F.when(first == "", "other")
        .when(matches(first, r"\p{Cyrillic}"), "ru")
        .when(matches(first, r"\p{Greek}"), "el")
        .when(matches(first, r"\p{Arabic}"), "ar")
        .when(matches(first, r"\p{Hebrew}"), "he")
        .when(matches(first, X.CJK), "ja")
        .otherwise("en")
    )


def words(text: Column, pattern: str = X.WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(0))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def ascii_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


# ---- spans ----------------------------------------------------------------------------------------


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (s, e) of all matches: gaps between matches and the matches themselves give the offsets."""
    p = _java(pattern)
    gaps = F.transform(F.split(text, p, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.length(x))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + y)

    def spans(both: Column) -> Column:
        start = lambda i: total(both["gaps"], i + 1) + total(both["found"], i)
        return F.transform(both["found"], lambda n, i: F.struct(start(i).alias("s"), (start(i) + n).alias("e")))

    return let(F.struct(gaps.alias("gaps"), found.alias("found")), spans)


def merge_spans(spans: Column) -> Column:
    """Sorted spans, joined where the next starts at or before the end."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) == 0) | (x["s"] > F.get(done, F.size(done) - 1)["e"]), F.concat(done, F.array(x))).otherwise(F.when(F.size(done) > 0, joined).otherwise(done))

    return F.aggregate(F.array_sort(spans), empty, step)


def protected_spans(text: Column) -> Column:
    """Merged spans of URLs, e-mail addresses and numbers."""
    found = F.concat(*[match_spans(text, p) for p in (X.URL, X.EMAIL, X.NUMBER)])
    return F.when(matches(text, r"\p{Nd}|@|://|www\."), merge_spans(found)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def blocked_cuts(text: Column) -> Column:
    """Offsets at which no token may start or end: before a mark, round a joiner or a variation selector."""
    n = F.length(text)

    def cuts(spans: Column) -> Column:
        joiners = F.filter(spans, lambda x: F.substring(text, x["s"] + 1, F.lit(1)).isin("\u200d", "\ufe0f"))
        both = F.concat(F.transform(spans, lambda x: x["s"]), F.transform(joiners, lambda x: x["e"]))
        return F.filter(F.array_sort(F.array_distinct(both)), lambda k: (k > 0) & (k < n))

    return F.when(matches(text, X.BLOCKED_CUT), let(match_spans(text, X.BLOCKED_CUT), cuts)).otherwise(F.array().cast("array<int>"))


def is_legal(i: Column, j: Column, protected: Column, blocked: Column) -> Column:
    """Whether [i, j) may be a token: both cuts allowed, and each protected span it overlaps is itself."""
    clash = F.exists(protected, lambda p: (i < p["e"]) & (j > p["s"]) & ~((i == p["s"]) & (j == p["e"])))
    return ~F.array_contains(blocked, i) & ~F.array_contains(blocked, j) & ~clash


# ---- token sequences ------------------------------------------------------------------------------


def char_ngrams(token: Column, orders: tuple[int, ...] = (2, 3, 4)) -> Column:
    """All character n-grams of the orders, repeats included; none where the token is shorter."""

    def grams(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(token) - k + 1)
        return F.when(F.length(token) >= k, F.transform(starts, lambda i: F.substring(token, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(k) for k in orders])


def gram_counts(grams: Column) -> Column:
    """Array of (feat, x): how often each value occurs, from the ends of the runs of the sorted array."""
    last = lambda a, i: (i == F.size(a) - 1) | (F.get(a, i) != F.get(a, i + 1))
    ends = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: last(a, i))
    sizes = lambda a, e: F.transform(e, lambda i, k: F.struct(F.get(a, i).alias("feat"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("long").alias("x")))
    once = F.size(F.array_distinct(grams)) == F.size(grams)  # most words; true of none
    ones = F.arrays_zip(grams.alias("feat"), F.array_repeat(F.lit(1).cast("long"), F.size(grams)).alias("x")).cast("array<struct<feat:string,x:bigint>>")
    return F.when(once, ones).otherwise(let(F.array_sort(grams), lambda a: let(ends(a), lambda e: sizes(a, e))))


def clean_runs(tokens: Column) -> Column:
    """For short lists; operators.decode.drop_runs is the same for long ones. Drop a markup token equal to the last one kept, and punctuation after punctuation kept.

    All markup tokens are punctuation, and the last token kept is punctuation exactly if the token before
    is, so one look back replaces the running state.
    """
    marked = F.transform(tokens, lambda t: F.struct(t.alias("t"), is_punct_only(t).alias("p")))
    drop = lambda xs, x, i: x["p"] & F.coalesce(F.get(xs, i - 1)["p"], F.lit(False))
    return F.transform(let(marked, lambda xs: F.filter(xs, lambda x, i: ~drop(xs, x, i))), lambda x: x["t"])


def merge_cjk(tokens: Column, most: int = 8) -> Column:
    """Join runs of CJK tokens of at most two characters, `most` pieces at a time."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    flush = lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["out"], F.array(F.array_join(s["run"], "")))).otherwise(s["out"])
    none = F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        short = (t != "") & is_all_cjk(t) & (F.length(t) <= 2)
        grown = F.concat(s["run"], F.array(t))
        is_full = F.size(s["run"]) + 1 >= most
        out = F.when(short & ~is_full, s["out"]).when(short, F.concat(s["out"], F.array(F.array_join(grown, "")))).otherwise(F.concat(flush(s), F.array(t)))
        run = F.when(short & ~is_full, grown).otherwise(none)
        return F.struct(out.alias("out"), run.alias("run"))

    return F.when(F.exists(tokens, lambda t: matches(t, X.CJK)), F.aggregate(tokens, start, step, flush)).otherwise(tokens)


def python_words(text: str) -> list[str]:
    """The words of `words` with the default pattern, outside Spark: letters, digits and marks that Python takes for word characters."""
    return re.findall(r"\b\w+\b", text)


def token_spans(tokens: Column) -> Column:
    """Spans of tokens that cover a text without gaps, by their lengths."""
    total = lambda n: F.aggregate(F.slice(tokens, F.lit(1), n), F.lit(0), lambda a, t: a + F.length(t))
    return F.transform(tokens, lambda t, i: F.struct(total(i).alias("s"), (total(i) + F.length(t)).alias("e")))


def locate_tokens(text: Column, tokens: Column) -> Column:
    """For short texts, as each search counts from the beginning; operators.evaluate.token_offsets is the same for long ones. Each token's (s, e), found from the end of the one before; tokens not found have null and leave the cursor."""
    kind = "struct<at:int,out:array<struct<s:int,e:int>>>"

    def step(state: Column, t: Column) -> Column:
        found = F.call_function("locate", t, text, state["at"] + 1)
        s = F.when(found > 0, found - 1)
        return F.struct(F.coalesce(s + F.length(t), state["at"]).alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), (s + F.length(t)).alias("e")))).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")).cast(kind)
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def perturbations(text: Column, seed: Column) -> Column:
    """Adjacent swap, deletion, confusable letters; the places come from a hash of seed, not from chance."""
    n = F.length(text)
    at = F.pmod(seed, n - 1).cast("int")
    gone = F.pmod(seed, n).cast("int")
    sub = lambda s, m: F.substring(text, s, m)
    rest = lambda s: F.substring(text, s, n)
    swap = F.concat(sub(F.lit(1), at), sub(at + 2, F.lit(1)), sub(at + 1, F.lit(1)), rest(at + 3))
    delete = F.concat(sub(F.lit(1), gone), rest(gone + 2))
    confusable = F.translate(text, X.CONFUSABLE_FROM, X.CONFUSABLE_TO)
    return F.when(n > 1, F.array(swap, delete, confusable)).otherwise(F.array(confusable))


#: Tokenizers as expressions; any Column -> array<string> function can be added.
TOKENIZERS = {
    "whitespace": lambda t: F.filter(F.split(t, rf"{X.SPACE}+"), lambda x: x != ""),
    "words_marks": lambda t: F.regexp_extract_all(t, F.lit(rf"{X.WORD}|[^\p{{L}}\p{{N}}_\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]"), F.lit(0)),
    "characters": lambda t: F.filter(F.split(t, ""), lambda x: x != ""),
}
