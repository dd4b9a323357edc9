"""PII: format-preserving Feistel pseudonyms.

Found values are validated, then permuted by a keyed Feistel network within
the set of values of their own format. The permutation is the same everywhere, so
equal values stay equal (and different ones different) across documents
and formats of writing; length, separators and validity are kept.

  card      13 to 19 digits of an issuer's range that pass the Luhn check (single spaces or hyphens allowed); the
            first four stay, the last is computed anew
  phone     international (+ and 8 to 15 digits) or (xxx) xxx-xxxx / xxx-xxx-xxxx; the country code (by a table) stays
  ssn       xxx-xx-xxxx in the ranges that are issued
  iban      passes mod 97; country stays, check digits are computed anew
  ip        IPv4 with octets to 255, but loopback and 0.0.0.0
  date      calendar dates of 1900 to 2099 as y-m-d, d/m/y, m/d/y, d.m.y (m/d/y if both fit); a day moves among those whose
            month and day have as many digits and, as to being over 12, a like day, so every format can write it
  email     letters stay letters and digits stay digits in the local part; the domain stays
  secret    hexadecimal or alphanumeric values of 16 and more characters after token/key/secret/password =

Numbers that fail validation are not personal data and stay as they are.

Defined results
  null text            stays null, no counts
  empty text, no value unchanged
  null doc_id          handled like any other
  repeated rows, ties  equal values get equal pseudonyms; overlapping finds: the first to start, then the order above
  empty table          empty result
  extra columns        ignored by `find`, kept by `pseudonymise`
  very long texts      whole
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shared import arrow_stage

#: The key comes from a secret store, through this setting. The second is for tests and the registered queries on made-up tables.
KEY_SETTING, TEST_KEY = "spark.corpuslab.pii.key", "corpuslab-test-key"
ROUNDS = 10
KINDS = ("email", "iban", "ip", "ssn", "date", "phone", "card", "secret")

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b)"
    r"|(?P<secret>(?i:(?:token|secret|api[_-]?key|password|passwd|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_-]{16,})(?![A-Za-z0-9+/_-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\w]|[.-][0-9])|(?<![\w+])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?!\w)|(?<![\w+.-])[0-9]{3}([-. ])[0-9]{3}\9[0-9]{4}(?![\w]|[.-][0-9]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
)


#: What a shorter end of a find that fails validation must still look like.
SHORTER = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
}
#: Country codes (ITU-T E.164) of one and two digits; all others have three.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Longer secrets are permuted in blocks of so many characters.
SECRET_BLOCK = 256


class Feistel:
    """A keyed permutation of the numbers below any n: a balanced Feistel network on the
    even number of bits that holds n, walked until it is below n again."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()
        self.known: dict[tuple[str, int, int], int] = {}

    def _round(self, domain: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hashlib.blake2b(domain + bytes([i]) + half.to_bytes(size, "big"), key=self.key, digest_size=min(64, size + 8)).digest()
        while len(digest) < size + 8:
            digest += hashlib.blake2b(digest, key=self.key, digest_size=64).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _pass(self, x: int, bits: int, domain: bytes, back: bool) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(domain, i, left, bits), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(domain, i, right, bits)
        return left << bits | right

    def permute(self, x: int, n: int, domain: str, back: bool = False) -> int:
        if n < 2:
            return x
        at = (domain, n, x)
        if not back and at in self.known:
            return self.known[at]
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        y = self._pass(x, bits, f"{domain}:{n}:".encode(), back)
        while y >= n:
            y = self._pass(y, bits, f"{domain}:{n}:".encode(), back)
        if not back:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = y
        return y

    def digits(self, s: str, domain: str, back: bool = False) -> str:
        return str(self.permute(int(s), 10 ** len(s), domain, back)).zfill(len(s)) if s else s

    def mixed(self, s: str, domain: str, back: bool = False) -> str:
        """Each ASCII letter or digit changes within its class; the rest stays."""
        sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "" for c in (c if c.isascii() else "_" for c in s)]
        x, n = 0, 1
        for c, of in zip(s, sets, strict=True):
            if of:
                x, n = x * len(of) + of.index(c), n * len(of)
        y, out = self.permute(x, n, f"{domain}:{''.join(of[:1] or c for c, of in zip(s, sets, strict=True))}", back), []
        for c, of in zip(reversed(s), reversed(sets), strict=True):
            if of:
                y, k = divmod(y, len(of))
                c = of[k]
            out.append(c)
        return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    """digits in the places of the digits of shape."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _only(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 if i % 2 else 2)
        total += x - 9 if x > 9 else x
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def day_class(m: int, d: int) -> str:
    """What the pseudonym of a day shares with it, however the day is written."""
    return f"{int(m > 9)}{int(d > 9) + int(d > 12)}"


@cache
def days(kind: str) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """The days of 1900 to 2099 of a class in order, and the place of each."""
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    found = [t for t in map(datetime.date.fromordinal, range(first, last + 1)) if day_class(t.month, t.day) == kind]
    return found, {t: i for i, t in enumerate(found)}


def is_issued(d: str) -> bool:
    """Whether the first digits are of a range of issuers, and the length is one of its cards."""
    two, four, n = int(d[:2]), int(d[:4]), len(d)
    if d[0] == "4":
        return n in (13, 16, 19)
    if d[0] == "5" or 2221 <= four <= 2720:
        return n == 16
    if two in (34, 37):
        return n == 15
    return (d[0] == "6" and n >= 16) or (d[0] == "3" and two != 31 and n >= 14)


def _card(v: str, f: Feistel, back: bool) -> str | None:
    d = _only(v)
    if not is_issued(d) or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    for _ in range(1000):  # a number of one digit only is no card: walk on
        body = d[:4] + f.digits(d[4:-1], "card" + d[:4], back)
        d = body + str(luhn(body))
        if len(set(d)) > 1:
            return _fill(v, d)
    return None


def _phone(v: str, f: Feistel, back: bool) -> str | None:
    d = _only(v)
    if v[0] == "+":
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        code = next((d[:n] for n in (1, 2) if d[:n] in CODES), d[:3])
    else:
        code = ""
        if len(d) != 10:
            return None
    return _fill(v, code + f.digits(d[len(code) :], "phone", back))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(v: str, f: Feistel, back: bool) -> str | None:
    d = _only(v)
    if not _ssn_ok(d):
        return None
    d = f.digits(d, "ssn", back)
    while not _ssn_ok(d):
        d = f.digits(d, "ssn", back)
    return _fill(v, d)


def _iban(v: str, f: Feistel, back: bool) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
        return None
    body = f.mixed(plain[4:], "iban" + plain[:2], back)
    new = plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in v)


OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}  # digits: first value, number of values


def _ip(v: str, f: Feistel, back: bool) -> str | None:
    """Octets keep their number of digits."""
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or parts[0] == "127" or v == "0.0.0.0":
        return None
    x, n = 0, 1
    for p in parts:
        first, size = OCTETS[len(p)]
        x, n = x * size + int(p) - first, n * size
    while True:
        x = f.permute(x, n, "ip" + "".join(str(len(p)) for p in parts), back)
        y, out = x, []
        for p in reversed(parts):
            first, size = OCTETS[len(p)]
            y, k = divmod(y, size)
            out.append(str(first + k))
        new = ".".join(reversed(out))
        if out[-1] != "127" and new != "0.0.0.0":
            return new


def _date(v: str, f: Feistel, back: bool) -> str | None:
    sep = re.search(r"[-/.]", v)[0]
    fields = v.split(sep)
    if len(fields[0]) == 4:
        order, (y, m, d) = "ymd", map(int, fields)
    elif sep == ".":
        order, (d, m, y) = "dmy", map(int, fields)
    else:
        a, b, y = map(int, fields)
        order, d, m = ("dmy", a, b) if a > 12 else ("mdy", b, a)
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    kind = day_class(m, d)
    found, place = days(kind)
    t = found[f.permute(place[datetime.date(y, m, d)], len(found), "date" + kind, back)]
    value = {"y": t.year, "m": t.month, "d": t.day}
    return sep.join(str(value[k]).zfill(len(x)) for k, x in zip(order, fields, strict=True))


def _email(v: str, f: Feistel, back: bool) -> str | None:
    local, _, domain = v.rpartition("@")
    return f"{f.mixed(local, 'email@' + domain.lower(), back)}@{domain}"


def _secret(v: str, f: Feistel, back: bool) -> str | None:
    if not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
        return None  # a word is no secret
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        x = f.permute(int(v, 16), 16 ** len(v), "hex", back)
        y = f"{x:0{len(v)}x}"
        return y if v == v.lower() else y.upper()
    return f.mixed(v, "secret", back)


def _long_secret(v: str, f: Feistel, back: bool) -> str | None:
    """Block by block, as the work of one permutation grows with the square of its length. Letters stay letters."""
    if len(v) <= SECRET_BLOCK:
        return _secret(v, f, back)
    if not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
        return None
    return "".join(f.mixed(v[i : i + SECRET_BLOCK], f"secret{i}", back) for i in range(0, len(v), SECRET_BLOCK))


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card, "secret": _long_secret}


def _pseudonym(kind: str, v: str, f: Feistel, back: bool) -> str | None:
    """The pseudonym of the longest valid value at the start of v, a find, that ends before a separator. Behind a shorter end the
    permutation is walked until no longer end is valid, so that the pseudonym is found with the same end again."""
    new = MAKERS[kind](v, f, back)
    if new is not None or kind not in SHORTER or (kind == "phone" and v[0] != "+"):
        return new
    ends = [len(v)]
    for end in range(len(v) - 1, 0, -1):
        if v[end] not in " .-" or not SHORTER[kind].fullmatch(v, 0, end):
            continue
        new = MAKERS[kind](v[:end], f, back)
        while new is not None and any(MAKERS[kind](new + v[end:e], f, back) is not None for e in ends):
            new = MAKERS[kind](new, f, back)
        if new is not None:
            return new
        ends.append(end)
    return None


def replace(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind. A find that fails validation is
    tried at its shorter ends, then stepped into, so that a value inside it can still be found."""
    out, at, seen, counts = [], 0, 0, {}
    while m := PATTERN.search(text, seen):
        kind = m.lastgroup if m.lastgroup != "value" else "secret"
        kind = next(k for k in KINDS if m.group(k) is not None)
        start, end = m.span("value") if kind == "secret" else m.span()
        new = _pseudonym(kind, text[start:end], f, back)
        if new is None:
            # go on behind the first run of digits or letters: a look-behind needs a border
            step = re.compile(r"\w+|\W").match(text, m.start())
            seen = max(step.end(), m.start() + 1)
            continue
        end = start + len(new)
        out += [text[at:start], new]
        at = seen = end
        counts[kind] = counts.get(kind, 0) + 1
    out.append(text[at:])
    return "".join(out), counts


def _run(key: str, text_at: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts = batch.column(text_at)
            some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]"), False).to_numpy(zero_copy_only=False)
            new, found = texts.to_pylist(), [None] * batch.num_rows
            for i in some.nonzero()[0].tolist():
                new[i], found[i] = replace(new[i], f)
            arrays = list(batch.columns)
            arrays[text_at] = pa.array(new, pa.string())
            if counts:
                arrays.append(pa.array([sum(x.values()) if x else 0 for x in found], pa.int64()))
                arrays += [pa.array([x.get(k, 0) if x else 0 for x in found], pa.int32()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "n_values", *(f"n_{k}" for k in KINDS)])
            else:
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def _key(docs: DataFrame, key: str | None) -> str:
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no key: give one, or set {KEY_SETTING}")
    return key


def find(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (with pseudonyms), n_values, and n_<kind> for each kind."""
    key = _key(docs, key)
    schema = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} int" for k in KINDS)
    return arrow_stage(docs.select("doc_id", "text"), _run(key, 1, True), schema)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All columns; text with pseudonyms. Lengths stay, so n_chars stays true."""
    key = _key(docs, key)
    return arrow_stage(docs, _run(key, docs.columns.index("text"), False), docs.schema)
