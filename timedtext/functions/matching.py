"""Fuzzy matching that has no built-in: NFKC normalisation and matching-block similarity, as Arrow UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRIP = re.compile(r"[\s、。，．！？!?「」『』…・〜ー~]")


def normalised(s: str) -> str:
    return _STRIP.sub("", unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def normalise(s: pd.Series) -> pd.Series:
    return s.map(normalised, na_action="ignore")


def echoes(source: str, copied: str | None, threshold: float = 0.7) -> bool:
    if copied is None:
        return False
    a, b = normalised(source), normalised(copied)
    if not a or not b or a == b:
        return a == b
    return difflib.SequenceMatcher(None, a, b).ratio() >= threshold


@F.pandas_udf(T.BooleanType())
def _echo_slow(source: pd.Series, copied: pd.Series) -> pd.Series:
    return pd.Series([echoes(a, b) for a, b in zip(source, copied, strict=True)], dtype=bool)


# not for chance's sake: Spark would work it out once more in each filter on what it decides, with a Python worker each
_echo_slow = _echo_slow.asNondeterministic()


def echo_matches(source: Column, copied: Column) -> Column:
    """Is ``copied`` the source text, near enough? Null is no match."""
    return F.coalesce(_echo_slow(source, copied), F.lit(False))
