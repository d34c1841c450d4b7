"""Text clean-up for label reads and product fields."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import let

# Letter forms folded together, as pairs from -> to.
ARABIC_LETTERS = "يىكةأإآ"
PERSIAN_LETTERS = "ییکهااا"
# Persian and Arabic digits and their ASCII forms.
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "01234567890123456789"
ZERO_WIDTH_NON_JOINER = "‌"
DIACRITICS = "[ً-ْٰ]"
ARABIC_BLOCK = "[؀-ۿ]"
SHORT_TERM = 4


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return text.map(
        lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) and not v.isascii() else v,
        na_action="ignore",
    )


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(token: pd.Series, term: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two words; null where the token is."""
    return pd.Series(
        [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(token, term)],
        dtype="float64",
    )


def fuzzy_bounds(token: Column, term: Column) -> tuple[Column, Column]:
    """Least and most that :func:`fuzzy_ratio` can be, without looking for blocks.

    The letters in common bound it from above. The first block is at least as long as a common
    beginning, and where one word holds the other it is that word, so the ratio is known.
    """
    both = F.length(token) + F.length(term)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.aggregate(
        F.array_distinct(F.split(term, "")), F.lit(0),
        lambda n, c: n + F.least(count(token, c), count(term, c)),
    )
    begin = F.size(F.filter(
        F.sequence(F.lit(1), F.least(F.length(token), F.length(term))),
        lambda n: F.substring(token, F.lit(1), n) == F.substring(term, F.lit(1), n),
    ))
    ratio = lambda matches: F.lit(2.0) * matches / both
    known = F.when(F.contains(token, term), F.length(term)).when(F.contains(term, token), F.length(token))
    # The function itself treats frequent letters of very long terms apart.
    short = F.length(term) < 200
    return (
        F.when(short, ratio(F.coalesce(known, begin))).otherwise(0.0),
        F.when(short, ratio(F.coalesce(known, letters))).otherwise(1.0),
    )


def match_term(token: Column, term: Column) -> Column:
    """Similarity of a read token to a lexicon term; short terms need a literal hit."""
    literal = F.when(F.contains(token, term), F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        F.when((F.length(token) == 0) | (F.length(term) == 0), F.lit(0.0))
        .when(F.length(term) <= SHORT_TERM, literal)
        .otherwise(fuzzy_ratio(token, term))
    )


def match_terms(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best similarity of ``token`` to any ``term`` of each key: keys..., score. Short terms need a
    literal hit. Only pairs whose upper bound beats what is certain for their key are compared."""
    token, term = F.col("token"), F.col("term")
    empty = (F.length(token) == 0) | (F.length(term) == 0)
    literal = F.when(F.contains(token, term), F.lit(1.0)).otherwise(F.lit(0.0))
    fixed = empty | (F.length(term) <= SHORT_TERM)
    sure = F.when(empty, F.lit(0.0)).otherwise(literal)
    least, most = fuzzy_bounds(token, term)
    bounded = pairs.withColumns(
        {"_least": F.when(fixed, sure).otherwise(least), "_most": F.when(fixed, sure).otherwise(most)}
    )
    certain = F.max("_least").over(Window.partitionBy(*keys))
    opened = bounded.withColumn("_open", F.col("_most") > certain)
    asked = opened.withColumn("_ratio", fuzzy_ratio(F.when(F.col("_open"), token), term))
    return asked.groupBy(*keys).agg(F.max(F.coalesce("_ratio", "_least")).alias("score"))


def fold_letters(composed: Column) -> Column:
    """Comparable form of already composed text: letters and digits only, lower case."""
    text = F.translate(composed, ARABIC_LETTERS, PERSIAN_LETTERS)
    text = F.regexp_replace(text, f"{ZERO_WIDTH_NON_JOINER}|{DIACRITICS}", "")
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def normalise(text: Column) -> Column:
    return fold_letters(nfkc(text))


def _ascii_base(text: Column) -> Column:
    composed = nfkc(F.coalesce(text.cast("string"), F.lit("")))
    return F.lower(F.trim(F.translate(composed, EASTERN_DIGITS, ASCII_DIGITS)))


def _if_latin(text: Column, body) -> Column:
    """``body`` of the folded text, '' when any Arabic-script letter occurs."""
    return let(
        _ascii_base(text),
        lambda t: F.when(F.rlike(t, F.lit(ARABIC_BLOCK)), F.lit("")).otherwise(body(t)),
    )


def compact_token(text: Column) -> Column:
    """Lower-case ASCII letters and digits; '' when any Arabic-script letter occurs."""
    return _if_latin(text, lambda t: F.regexp_replace(t, "[^a-z0-9]+", ""))


def clean_words(text: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; '' for Arabic script."""
    return _if_latin(text, lambda t: F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")))


# Spellings of the volume units, longest first.
UNIT_SPELLINGS = (
    ("millilit(?:er|re)s?", "ml"),
    ("میلی[ ‌]?لیتری?", "ml"),
    ("lit(?:er|re)s?", "l"),
    ("لیتری?", "l"),
    ("سی[ ‌]?سی", "cc"),
)


def normalise_size(text: Column) -> Column:
    """First volume as ``Nml`` below a litre, else litres with up to three decimals and ``L``.

    A comma before exactly three digits groups thousands; any other comma is a decimal point.
    """
    t = _ascii_base(text)
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, ",", ".")
    for spelling, unit in UNIT_SPELLINGS:
        t = F.regexp_replace(t, spelling, unit)
    t = F.regexp_replace(t, r"\s+", "")
    found = r"(\d+(?:\.\d+)?)(ml|cc|cl|l)\b"

    def millilitres(text: Column) -> Column:
        unit = F.regexp_extract(text, found, 2)
        factor = (
            F.when(unit == "l", F.lit(1000.0)).when(unit == "cl", F.lit(10.0)).otherwise(F.lit(1.0))
        )
        amount = F.regexp_extract(text, found, 1).try_cast("double")
        return F.bround(amount * factor).cast("long")

    def shown(ml: Column) -> Column:
        litres = F.regexp_replace((ml / 1000).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
        return (
            F.when(ml.isNull() | (ml <= 0), F.lit(""))
            .when(ml < 1000, F.concat(ml.cast("string"), F.lit("ml")))
            .otherwise(F.concat(litres, F.lit("L")))
        )

    return let(let(t, millilitres), shown)
