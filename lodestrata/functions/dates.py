"""Calendar dates in mixed notations, quarters and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import half_width, strip

_TIME = r"(?:[T\s]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?\s*(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})?)?$"
_YMD = r"^([0-9]{4})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})\s*日?" + _TIME
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})" + _TIME
_DMY = r"(?i)^([0-9]{1,2})[-\s]+([a-z]{3})[a-z]*\.?,?[-\s]+([0-9]{4})" + _TIME
_MDY = r"(?i)^([a-z]{3})[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})" + _TIME


def _try_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def full_date(col: Column) -> Column:
    """DATE where ``col`` names a full, existing calendar day in any notation; else null.

    ``2020-01-02``, ``2020/1/2``, ``2020.01.02``, ``20200102``, ``2020年1月2日``, ``2 Jan 2020`` and
    ``Jan 2, 2020``, each with or without a time of day and in full-width digits. A month alone, a
    day that does not exist, and stray letters give null; so does null.
    """
    text = strip(half_width(col))
    iso = F.regexp_replace(F.regexp_replace(text, _COMPACT, "$1-$2-$3"), _YMD, "$1-$2-$3")
    named = F.initcap(F.regexp_replace(F.regexp_replace(text, _DMY, "$3-$2-$1"), _MDY, "$3-$1-$2"))
    return F.coalesce(
        F.try_to_date(iso, "yyyy-M-d"), F.when(text.rlike("[A-Za-z]{3}"), F.try_to_date(named, "yyyy-MMM-d"))
    )


def lenient_date(col: Column) -> Column:
    """DATE under the lenient rule of the ingest stage.

    Accepts ISO, slashed, dotted and compact forms, a time suffix, month-first ``01/02/2020`` and
    ``1/2/20``, ``Jan 2 2020``, and the partial forms ``2020-01``, ``2020`` and ``2020Q1`` (first day).
    Rejects ``2020年1月2日``, month 13, day serials, blanks, and years outside 1678..2261.
    """
    text = F.trim(col)
    us = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})$"
    year = F.regexp_extract(text, us, 3)
    century = F.when(F.length(year) == 4, year).when(year.cast("int") < 69, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    quarter = F.regexp_extract(text, r"^([0-9]{4})-?[Qq]([1-4])$", 2)
    parsed = (
        F.when(text.contains("年"), F.lit(None).cast("date"))
        .when(text.rlike(us), _try_date(century, F.regexp_extract(text, us, 1), F.regexp_extract(text, us, 2)))
        .when(text.rlike(r"^[0-9]{4}[-/][0-9]{1,2}$"), _try_date(F.substring(text, 1, 4), F.regexp_extract(text, r"[-/]([0-9]{1,2})$", 1), F.lit("1")))
        .when(text.rlike(r"^[0-9]{4}$"), _try_date(text, F.lit("1"), F.lit("1")))
        .when(quarter != "", _try_date(F.substring(text, 1, 4), (quarter.cast("int") * 3 - 2).cast("string"), F.lit("1")))
        .otherwise(full_date(text))
    )
    return F.when(F.year(parsed).between(1678, 2261), parsed)


def quarter_label(date: Column) -> Column:
    """``2020Q1``; null for null."""
    return F.concat(F.date_format(date, "yyyy"), F.lit("Q"), F.quarter(date).cast("string"))


def quarter_ordinal(date: Column) -> Column:
    """Quarters since year 0, the unit of every frame over quarters."""
    return F.year(date) * 4 + F.quarter(date) - 1


def ordinal_label(ordinal: Column) -> Column:
    """The label of a quarter ordinal."""
    return F.concat(F.floor(ordinal / 4).cast("string"), F.lit("Q"), (F.pmod(ordinal, F.lit(4)) + 1).cast("string"))


def label_ordinal(label: Column) -> Column:
    """The ordinal of ``YYYYQn``; null for anything else."""
    return F.when(label.rlike("^[0-9]{4}Q[1-4]$"), F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int") - 1)


# Bounds of the reporting periods.
PERIODS = [(1994, 1999), (2000, 2009), (2010, 2019), (2020, 2026)]


def period_of_year(year: Column, dash: str = "-", periods: list[tuple[int, int]] | None = None) -> Column:
    """The reporting period that holds ``year``; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high in periods or PERIODS:
        out = F.when(year.between(low, high), F.lit(f"{low}{dash}{high}")).otherwise(out)
    return out
