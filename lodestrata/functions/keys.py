"""Keys and small metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import trim_spaces


def applicant_key(applicant: Column, address: Column) -> Column:
    """Lower-case letters, digits and Han characters of name and address, ``name||address``.

    A leading six-digit postcode of the address does not count; an empty name gives ``""``.
    """
    keep = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z一-鿿]", "")
    name = keep(applicant)
    return F.when(name == "", F.lit("")).otherwise(F.concat(name, F.lit("||"), F.regexp_replace(keep(address), "^[0-9]{6}", "")))


def pair_id(a: Column, b: Column) -> Column:
    """``a|b``."""
    return F.concat_ws("|", a, b)


def relatedness(n_pair: Column, n_a: Column, n_b: Column) -> Column:
    """Co-occurrences over the geometric mean of occurrences; 0 where either is 0."""
    return F.coalesce(F.try_divide(n_pair, F.sqrt(F.coalesce(n_a, F.lit(0)) * F.coalesce(n_b, F.lit(0)))), F.lit(0.0))


def distance(related: Column) -> Column:
    """1 - relatedness, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - related))


def smoothed_probability(n_pair: Column, n_total: Column, alpha: float, codes: int) -> Column:
    """Additively smoothed share of a pair among all pairs of a taxonomy of ``codes`` codes."""
    pairs = codes * (codes - 1) // 2
    return (n_pair + F.lit(float(alpha))) / (n_total + F.lit(float(alpha) * pairs))


def bidf(n_docs: Column, df: Column) -> Column:
    """ln(N / (1 + df)); null where N is 0."""
    return F.when(n_docs > 0, F.log(n_docs / (df + 1)))


def joined_values(col: Column, sep: str = "; ") -> Column:
    """Aggregate: sorted distinct non-empty values joined by ``sep``."""
    text = trim_spaces(col)
    return F.array_join(F.array_sort(F.collect_set(F.when(text != "", text))), sep)
