"""Patterns, word lists and tables that results depend on.

Patterns are written so that Spark (Java) and DuckDB (RE2) read them alike;
white space and digits are spelled out as Unicode classes.
"""

# ---- fixed values: patterns ---------------------------------------------------------------------
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NON_SPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
URL = rf"(?:https?://|www\.){NON_SPACE}+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
NUMBER = r"(?:[+\-]?(?:(?:\p{Nd}{1,3}(?:[ ,.\x{00A0}]\p{Nd}{3})+|\p{Nd}+)(?:[.,]\p{Nd}+)?)|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]"
WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
REDIRECT = r"(?i)(redirect|redirection|weiterleitung|yönlendirme|yönlendir|перенаправ|إعادةتوجيه|転送|umleiten|r\s*e\s*d\s*i\s*r\s*e\s*c\s*t|w\s*e\s*i\s*t\s*e\s*r\s*l\s*e\s*i\s*t\s*u\s*n\s*g)"
REDIRECT_PLAIN = ("REDIRECT", "WEITERLEITUNG")
WIKI_NOISE = r"\A(?:\*{2,}|'{2,}|`{2,}|={2,}|[:;,#\-\x{3000}\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+)\z"
QUOTE_RUN_EDGE = rf"({SPACE}''+|''+{SPACE}|\A''+|''+\z)"
CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
# a title-cased string: runs of cased letters start with an upper-case one and go on in lower case
TITLE = r"\A[^\p{Lu}\p{Lt}\p{Ll}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*[^\p{Lu}\p{Lt}\p{Ll}]+)*(?:[\p{Lu}\p{Lt}]\p{Ll}*)?\z"
BLOCKED_CUT = r"[\p{M}\x{200D}\x{FE0F}]"

# ---- fixed values: word lists -------------------------------------------------------------------
END_MARKS = (".", "!", "?")
COMMA_MARKS = (",", ";", ":")
MARKUP_TOKENS = ("**", "***", "''", "'''", "``", "```", "==", "===", ": :")
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OTHER_PUNCTUATION = (
    "«»„“”—–…·：；！？。、「」『』‹›‚‟―•‣§¶°′″¿¡’＞＜，．（）［］【】｛｝﹁﹂﹃﹄ー※،؛؟ـ।॥௹௳௴௵௶௷†‡⸺⸻〃〜〝〞〟﹏"
)
PUNCTUATION = ASCII_PUNCTUATION + OTHER_PUNCTUATION
CLASSES = ("<BOS>", "MWE", "URL", "EMAIL", "NUM", "EMOJI", "InitCap", "ALLCAPS", "lower", "hyphen", "PUNCT", "EOS", "other")
CONFUSABLE_FROM, CONFUSABLE_TO = "aeiouc", "áéíóúç"
PAIR_SEPARATORS = ("->", "=>", ":", "|", "/", "-", ",")

# ---- fixed values: affixes of the languages of the test tables; others are given by file ---------
AFFIXES = {
    "en": {
        "pre": "re un in im dis mis non over under pre post anti".split(),
        "suf": "ing ed t er ers ly ness ment tion sion ous able less ful hood ity ive s es est or ist let ling".split(),
    },
    "de": {
        "pre": "be ge ent ver zer er ur miss un in".split(),
        "suf": "ung en er heit keit isch lich erei lein chen schaft st er mehr t te".split(),
    },
    "es": {
        "pre": "in im ir i des re pre pos anti".split(),
        "suf": "s es ito ita illo illa ísimo mente dor dora ero era ista ando iendo é ó aste aron í ió iste ieron ré rás rá remos réis rán más".split(),
    },
}
CROSS_CLASSES = {
    "PL": {"en": "s es", "de": "e er en n s", "es": "s es"},
    "NEG": {"en": "un in im ir il non", "de": "un in", "es": "in im ir i des a"},
    "PAST": {"de": "ge"},
    "SUPER": {"en": "est", "de": "st", "es": "ísimo"},
    "COMP": {"en": "er more", "de": "er mehr", "es": "más"},
    "DIM": {"en": "let ling", "de": "chen lein", "es": "ito ita illo illa"},
    "PROG": {"en": "ing", "es": "ando iendo"},
    "PAST_{SFX}": {"en": "ed t", "de": "t en te", "es": "é ó aste aron í ió iste ieron"},
    "FUT_{SFX}": {"es": "ré rás rá remos réis rán"},
    "POSS": {"en": "'s", "de": "s", "es": "de"},
    "AGENT": {"en": "er or ist", "de": "er erin", "es": "dor dora ero era ista"},
    "ADVERB": {"en": "ly", "de": "erweise lich", "es": "mente"},
}

# ---- fixed values: constants of the cost model ---------------------------------------------------
EPS = 1e-12
SCRIPT_MISMATCH = 0.05
CONSISTENCY_STEP = 0.05
PRODUCT_FLOOR = 1e-12
CHAR_SMOOTHING = 1e-3
PMI_CLIP = 20.0
DEFAULTS = {
    "alpha": 1.0, "beta": 0.5, "tau": 0.01, "merge_reward": 0.05, "short_penalty": 0.2, "space_penalty": 0.25,
    "min_freq": 3, "max_token_len": 14, "top_k_add": 8, "lambda_lo": 0.0, "lambda_hi": 2.0, "gamma_boundary": 10.0,
}


def affix_rows() -> list[tuple[str, str, str]]:
    """(lang, kind, affix), distinct, sorted."""
    return sorted({(lang, kind, a) for lang, kinds in AFFIXES.items() for kind, affixes in kinds.items() for a in affixes})


def class_rows() -> list[tuple[str, str, str]]:
    """(cls, lang, suffix), distinct, sorted."""
    return sorted({(cls, lang, s) for cls, langs in CROSS_CLASSES.items() for lang, items in langs.items() for s in items.split()})
