"""Header keys: the same rules as a Column function (for values) and on header strings (metadata)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a header key ignores, and the accepted target names in order.
DEGREES = "°º�"
BRACKETS = "[](){}"
SEPARATORS = "/\\-_.,;:+"
BYTE_ORDER_MARK = "﻿"
TARGET_KEYS = ("requested heating power w", "requested heating power", "heating power lin w",
               "heating power lin", "heating power can kw", "heating power can w",
               "heating power can", "heating power")
LEAKAGE_KEYS = ("requested heating power", "heating power can", "heating power lin",
                "heater voltage", "heater current", "heater signal")

_KEY_BLANKS = DEGREES + BRACKETS + SEPARATORS + BYTE_ORDER_MARK
_PLAIN_BLANKS = "°" + BRACKETS + SEPARATORS.replace("+", "") + BYTE_ORDER_MARK


def _squeeze(c: Column) -> Column:
    # Java's \s is ASCII only; header text may carry no-break and other Unicode spaces.
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def header_key(c: Column) -> Column:
    """Lookup key of a header held as a value; characters that carry no meaning become blanks."""
    return _squeeze(F.translate(c, _KEY_BLANKS, " " * len(_KEY_BLANKS)))


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; only for values that may hold non-ASCII letters."""
    return text.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def header_key_of(name: str) -> str:
    """The key of one column name, for header metadata on the driver."""
    text = unicodedata.normalize("NFKC", str(name))
    blanked = text.translate({ord(ch): " " for ch in _KEY_BLANKS})
    return " ".join(blanked.split()).lower()


def plain_key(c: Column) -> Column:
    """The simpler key of the flat pipeline, which spells out the state-of-charge abbreviation."""
    blanked = F.translate(F.lower(F.trim(c)), _PLAIN_BLANKS, " " * len(_PLAIN_BLANKS))
    return _squeeze(F.replace(blanked, F.lit("soc"), F.lit(" state of charge ")))


def plain_key_of(name: str) -> str:
    text = str(name).replace(BYTE_ORDER_MARK, " ").strip().lower()
    blanked = text.translate({ord(ch): " " for ch in _PLAIN_BLANKS})
    return " ".join(blanked.replace("soc", " state of charge ").split())


def number_duplicates(df: DataFrame, keys: list[str], name: str, order: str, out: str) -> DataFrame:
    """Unique column names, one row per header field: the n-th repeat of a name in a file gets ``__dup<n>``.

    A header is bounded by the width of one file, so the window is too.
    """
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("__dup"), n)))


def target_rank(key: Column) -> Column:
    """Preference of a header key as the target column; NULL where it cannot be one."""
    exact = F.array_position(F.array(*[F.lit(k) for k in TARGET_KEYS]), key)
    loose = key.contains("heating") & key.contains("power")
    return F.when(exact > 0, exact).when(loose, F.lit(len(TARGET_KEYS) + 1).cast("long"))


def is_leaky(key: Column) -> Column:
    """Does a header key name a channel that gives the answer away?"""
    return key.rlike("|".join(re.escape(k) for k in LEAKAGE_KEYS))


def is_leaky_name(name: str) -> bool:
    return any(k in plain_key_of(name) for k in LEAKAGE_KEYS)
