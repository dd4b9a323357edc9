"""What Spark has no function for, as Arrow-batched functions over distinct strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf("string")
def nfc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())
