"""SQL pieces that several oracles share, and quoting."""

from __future__ import annotations

from corpuslab.functions import fixed as X
from corpuslab.functions.text import punct_class


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


LINES = r"""lines AS (
  SELECT * FROM (
    SELECT doc_id, lang, source, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS text
    FROM documents) WHERE regexp_matches(text, '\S'))"""

WORDS = f"""words AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, {q(X.WORD)})) AS word FROM documents)"""

SPACES = f"{X.SPACE}+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A{X.SPACE}+|{X.SPACE}+\z')}, '', 'g')"


def redirect(x: str) -> str:
    plain = f"regexp_replace(upper({x}), {q(SPACES)}, '', 'g')"
    return f"({has(x, X.REDIRECT)} OR " + " OR ".join(f"contains({plain}, {q(w)})" for w in X.REDIRECT_PLAIN) + ")"


def punct_only(x: str) -> str:
    return f"({has(x, full(punct_class() + '+'))} AND {has(x, X.NON_SPACE)})"


def mixed_script(x: str) -> str:
    letters = f"regexp_replace({x}, {q(chr(92) + 'P{L}')}, '', 'g')"
    groups = [r"\p{Cyrillic}", r"\p{Arabic}", r"\p{Greek}", r"\p{Han}\p{Hiragana}\p{Katakana}"]
    flags = [f"CAST({has(letters, f'[{g}]')} AS INTEGER)" for g in groups]
    rest = f"regexp_replace({x}, {q('[' + ''.join(groups) + ']')}, '', 'g')"
    return "(" + " + ".join([*flags, f"CAST({has(rest, chr(92) + 'p{L}')} AS INTEGER)"]) + " >= 2)"


def internal_spaces(x: str) -> str:
    t = strip(x)
    return f"(length({t}) - length(replace({t}, ' ', '')))"


def token_class(x: str) -> str:
    cased = r"[\p{Lu}\p{Lt}]"
    return f"""CASE WHEN {x} IN ('.', '!', '?') THEN 'EOS' WHEN {x} IN (',', ';', ':') THEN 'PUNCT'
      WHEN {has(x, X.URL)} THEN 'URL' WHEN {has(x, full(X.EMAIL))} THEN 'EMAIL' WHEN {has(x, full(X.NUMBER))} THEN 'NUM' WHEN {has(x, X.EMOJI)} THEN 'EMOJI'
      WHEN {has(x, cased)} AND {has(x, X.TITLE)} THEN 'InitCap'
      WHEN {has(x, chr(92) + 'p{Lu}')} AND NOT {has(x, '[' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')} THEN 'ALLCAPS'
      WHEN {has(x, chr(92) + 'p{Ll}')} AND NOT {has(x, cased)} THEN 'lower'
      WHEN contains({x}, '-') THEN 'hyphen' ELSE 'other' END"""


def script_guess(x: str) -> str:
    first = f"regexp_extract({x}, {q(chr(92) + 'p{L}')}, 0)"
    arms = "".join(f" WHEN {has(first, p)} THEN '{c}'" for p, c in ((r"\p{Cyrillic}", "ru"), (r"\p{Greek}", "el"), (r"\p{Arabic}", "ar"), (r"\p{Hebrew}", "he"), (X.CJK, "ja")))
    return f"CASE WHEN {first} = '' THEN 'other'{arms} ELSE 'en' END"


def spans(x: str, pattern: str) -> str:
    """list of {'s', 'e'} of all matches, from the lengths of gaps and matches."""
    gaps = f"list_transform(string_split_regex({x}, {q(pattern)}), lambda g: length(g))"
    found = f"list_transform(regexp_extract_all({x}, {q(pattern)}), lambda m: length(m))"
    start = f"list_sum(list_slice({gaps}, 1, i)) + coalesce(list_sum(list_slice({found}, 1, i - 1)), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST({start} AS INTEGER), 'e': CAST({start} + {found}[i] AS INTEGER)}})"


def protected(table: str, keys: str) -> str:
    """CTEs up to protected(keys, s, e): merged protected spans of the texts of a table."""
    return f"""raw_spans AS (
    SELECT {keys}, unnest(list_concat({spans('text', X.URL)}, {spans('text', X.EMAIL)}, {spans('text', X.NUMBER)})) AS x
    FROM {table} WHERE {has('text', chr(92) + 'p{Nd}|@|://|www' + chr(92) + '.')}),
  marked AS (
    SELECT {keys}, x.s AS s, x.e AS e,
      CASE WHEN x.s > max(x.e) OVER (PARTITION BY {keys} ORDER BY x.s, x.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM raw_spans),
  grouped AS (SELECT {keys}, s, e, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
  protected AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM grouped GROUP BY {keys}, g)"""


PROTECTED = protected("lines", "doc_id, line_no")


def legal_spans(max_len: int) -> str:
    """CTEs up to legal(text, mult, i, tok): legal spans of the distinct lines."""
    cut = lambda k: (
        f"(NOT odd OR {k} = 0 OR {k} = length(text) OR NOT ({has(f'substring(text, {k} + 1, 1)', X.BLOCKED_CUT)} OR {has(f'substring(text, {k}, 1)', r'[' + chr(92) + 'x{200D}' + chr(92) + 'x{FE0F}]')}))"
    )
    return f"""{LINES},
  dlines AS (SELECT text, count(*) AS mult, {has('any_value(text)', X.BLOCKED_CUT)} AS odd FROM lines GROUP BY text),
  {protected('dlines', 'text')},
  starts AS (SELECT text, mult, odd, unnest(range(0, length(text))) AS i FROM dlines),
  every AS (SELECT text, mult, odd, i, i + unnest(range(1, least({max_len}, length(text) - i) + 1)) AS j FROM starts),
  cutok AS (SELECT text, mult, i, j FROM every WHERE {cut('i')} AND {cut('j')}),
  legal AS (
    SELECT text, mult, i, substring(text, i + 1, j - i) AS tok FROM cutok WHERE text NOT IN (SELECT text FROM protected)
    UNION ALL
    SELECT text, mult, i, substring(text, i + 1, j - i) AS tok FROM cutok c WHERE text IN (SELECT text FROM protected)
      AND NOT EXISTS (SELECT 1 FROM protected p WHERE p.text = c.text AND c.i < p.e AND c.j > p.s AND NOT (c.i = p.s AND c.j = p.e)))"""


def reason(x: str, count: str, min_freq: int) -> str:
    """The first filter that a candidate fails; NULL if it is kept."""
    return f"""CASE WHEN {count} < {min_freq} THEN 'low_freq' WHEN {punct_only(x)} AND {count} < {2 * min_freq} THEN 'punct'
    WHEN {has(x, X.REDIRECT)} THEN 'redirect' WHEN {has(x, X.WIKI_NOISE)} THEN 'wiki_noise' WHEN {has(x, X.QUOTE_RUN_EDGE)} AND {mixed_script(x)} THEN 'quote_mixed'
    WHEN {internal_spaces(x)} > 2 THEN 'spaces' END"""
