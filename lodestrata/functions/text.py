"""Text cleaning and tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def clean_text(col: Column) -> Column:
    """NFKC, every control or unassigned character a blank, blanks collapsed and trimmed; null gives ``""``."""
    plain = F.regexp_replace(F.regexp_replace(_nfkc(F.coalesce(col, F.lit(""))), r"\p{C}", " "), r"(?U)\s+", " ")
    return F.trim(plain)


def combine_text(*cols: Column) -> Column:
    """Non-empty fields joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols])


# Fixed value: words are runs of letters, digits and +#.- or pairs of Han characters.
WORD = "[a-z0-9+#.-]+|[一-鿿]{2}"


def words(col: Column) -> Column:
    """Words of a text in order; a dictionary segmenter may be put in its place by passing its column."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def char_ngrams(col: Column, low: int = 2, high: int = 4) -> Column:
    """All overlapping n-grams of ``low`` to ``high`` characters; an empty array for null and short texts.

    For long texts cut the characters into a column of their own and use ``ngrams_of`` on it.
    """
    return F.when(F.length(col) >= low, ngrams_of(F.split(col, ""), low, high)).otherwise(F.array().cast("array<string>"))


def ngrams_of(chars: Column, low: int = 2, high: int = 4) -> Column:
    """The same over an array of characters."""

    def of(n: int) -> Column:
        return F.transform(chars, lambda x, i: F.concat(x, *[F.get(chars, i + k) for k in range(1, n)]))

    # n-grams running over the end are null
    return F.array_compact(F.concat(*[of(n) for n in range(low, high + 1)]))


def distinct_chars(col: Column) -> Column:
    """Number of different characters; 0 for null and empty text."""
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, 0).otherwise(F.size(F.array_distinct(F.split(col, ""))))


def token_bucket(token: Column, buckets: int) -> Column:
    """Bucket of a token under feature hashing: the first 32 bits of its MD5, so that any engine gives the same."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
