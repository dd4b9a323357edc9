"""PII: one pseudonym a value however it is written, against a plain list of what each format allows; linear matching; the key."""

import datetime
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import pii


def changed(value, f, back=False):
    new, counts = pii.replace(f"x {value} y", f, back)
    return new[2:-2], counts


DAYS = st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31))


@settings(max_examples=300, deadline=None)
@given(DAYS, st.integers(0, 50))
def test_a_day_is_the_same_in_every_format(day, key):
    """What m/d/y would misread (both fields up to 12) is written in the formats that say the same day."""
    f, y, m, d = pii.Feistel(str(key)), day.year, day.month, day.day
    texts = [f"{y}-{m:02}-{d:02}", f"{y}/{m}/{d}", f"{m:02}/{d:02}/{y}", f"{m}/{d}/{y}", f"{m}-{d:02}-{y}", f"{d:02}.{m:02}.{y}", f"{d}.{m}.{y}"] + [f"{d}/{m}/{y}", f"{d:02}-{m:02}-{y}"] * (d > 12)
    said = set()
    for text in texts:
        new, counts = changed(text, f)
        assert counts == {"date": 1} and len(new) == len(text) and changed(new, f, back=True)[0] == text
        a, b, c = map(int, re.split(r"[-/.]", new))
        said.add((a, b, c) if a > 99 else (c, b, a) if "." in new or d > 12 and int(re.split(r"[-/.]", text)[0]) == d else (c, a, b))
    assert len(said) == 1 and datetime.date(*said.pop())


def test_days_are_permuted():
    f = pii.Feistel("k")
    year = [datetime.date(2021, 1, 1) + datetime.timedelta(i) for i in range(365)]
    assert len({changed(t.isoformat(), f)[0] for t in year}) == 365


@pytest.mark.parametrize("texts", [
    ["+49 30 1234567", "+49301234567", "+49 (30) 123-4567", "+49-30-1234567"], ["+1 212 555 0147", "(212) 555-0147", "212-555-0147", "+12125550147", "212.555.0147"],
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
])
def test_numbers_are_the_same_in_every_format(texts):
    for key in "abc":
        f = pii.Feistel(key)
        plain = {re.sub(r"\W", "", changed(t, f)[0])[-10:] for t in texts}
        assert len(plain) == 1


@pytest.mark.parametrize("value", ["a" * 65 + "@example.org", "x" * 900 + "1@mail.example.com", "_under.score@example.org", "-dash@example.org", "a.b-c_d%e+f@sub.example.co"])
def test_mail_addresses_of_any_length(value):
    new, counts = changed(value, pii.Feistel("k"))
    assert counts == {"email": 1} and new.split("@")[1] == value.split("@")[1] and new != value and len(new) == len(value)


@pytest.mark.parametrize("part", ["-", "_", "a-", "a_", "a.", "a", "1 ", "1-", "+", "token", "token=", "api_key", "1.", "A1", "a@", "AB12 ", "(1", "secret: a"])
def test_matching_is_linear(part):
    start = time.process_time()
    pii.replace(part * (250_000 // len(part)) + "@", pii.Feistel("k"))
    short = time.process_time() - start
    start = time.process_time()
    pii.replace(part * (1_000_000 // len(part)) + "@", pii.Feistel("k"))
    assert time.process_time() - start < 8 * short + 1


def test_a_key_is_needed(spark):
    docs = spark.createDataFrame([(1, "a@example.org")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.find(docs)
    spark.conf.set(pii.KEY_SETTING, "from the setting")
    try:
        assert pii.find(docs).first()["text"] == pii.find(docs, "from the setting").first()["text"] != pii.find(docs, "other").first()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
