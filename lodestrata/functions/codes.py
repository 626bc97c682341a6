"""Classification codes, stock codes and record labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PADDED = r"^([A-H][0-9]{2}[A-Z])([0-9]{4})([0-9]{6})$"
_DISPLAY = r"^([A-H][0-9]{2}[A-Z])([0-9]{1,4})/([0-9]{1,6})$"

# Labels of record types, and relations that count as the listed firm itself.
INVENTION_LABELS = ["发明申请", "发明授权", "发明公布"]
UTILITY_LABEL, DESIGN_LABEL = "实用新型", "外观设计"
BASELINE_RELATIONS = ["上市公司本身", "上市公司的子公司"]
BASELINE_TYPES = ["invention", "utility_model"]


def stock_code(raw: Column) -> Column:
    """Six digits, leading zeros kept.

    ``="001283"`` and ``1283`` give ``001283``; ``1283.0`` loses its fraction; otherwise the first run
    of one to six digits counts, so a longer number gives its first six. Null where there is no digit.
    """
    text = F.regexp_replace(F.trim(raw), "[=\"']", "")
    run = F.regexp_extract(F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1"), "[0-9]{1,6}", 0)
    return F.when(run != "", F.lpad(run, 6, "0"))


def patent_type_group(label: Column) -> Column:
    """Type of a record by its exact label; anything unknown, also null, is ``other``."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (
        F.when(text.isin(INVENTION_LABELS), "invention").when(text == UTILITY_LABEL, "utility_model").when(text == DESIGN_LABEL, "design").otherwise("other")
    )


def patent_type_by_prefix(label: Column) -> Column:
    """Type of a record where any label beginning with the word for invention counts as one."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text.startswith("发明"), "invention").when(text == UTILITY_LABEL, "utility_model").when(text == DESIGN_LABEL, "design").otherwise("other")


def eligible_relation(relation: Column) -> Column:
    """1 for the listed firm itself and its subsidiaries, else 0."""
    return F.coalesce(F.trim(relation).isin(BASELINE_RELATIONS), F.lit(False)).cast("int")


def granted_invention(type_group: Column, grant_no: Column, grant_date: Column) -> Column:
    """1 for an invention with a grant number or date."""
    has = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    return ((type_group == "invention") & (has(grant_no) | has(grant_date))).cast("int")


def normalize_code(raw: Column, compat: bool = False) -> Column:
    """One display form of a classification code, or null.

    Accepts a section, class, subclass, full code and the 14-character zero-padded form; drops a
    version in square brackets, blanks and full-width slashes. Main groups lose leading zeros,
    subgroups have two digits at least. ``compat`` keeps the historic reading of padded subgroups,
    which fills a subgroup such as 10 to ``01``.
    """
    return _form(_flat(raw), compat)


def _flat(raw: Column) -> Column:
    """Upper case, without version, blanks and full-width slashes."""
    plain = F.upper(F.regexp_replace(raw, r"\[[0-9]{4}\.[0-9]{2}\]", ""))
    return F.regexp_replace(F.replace(plain, F.lit("／"), F.lit("/")), r"\s+", "")


def _form(text: Column, compat: bool = False) -> Column:
    """The display form of a flattened code."""
    tail = F.regexp_replace(F.regexp_extract(text, _PADDED, 3), "0+$", "")
    if compat:
        sub = F.when(tail == "", F.lit("00")).otherwise(_two(tail.try_cast("bigint").cast("string")))
    else:
        sub = F.rpad(tail, 2, "0")
        sub = F.when(F.length(tail) > 2, tail).otherwise(sub)
    padded = F.concat(F.regexp_extract(text, _PADDED, 1), F.regexp_extract(text, _PADDED, 2).try_cast("int").cast("string"), F.lit("/"), sub)
    display = F.concat(
        F.regexp_extract(text, _DISPLAY, 1),
        F.regexp_extract(text, _DISPLAY, 2).try_cast("int").cast("string"),
        F.lit("/"),
        _two(F.regexp_extract(text, _DISPLAY, 3).try_cast("int").cast("string")),
    )
    return F.when(text.rlike("^[A-H]([0-9]{2}[A-Z]?)?$"), text).when(text.rlike(_PADDED), padded).when(text.rlike(_DISPLAY), display)


def _two(digits: Column) -> Column:
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def code_level(code: Column) -> Column:
    """Level of a normalised code in the hierarchy; null for null."""
    n = F.length(code)
    return (
        F.when(n == 1, "section").when(n == 3, "class").when(n == 4, "subclass").when(code.endswith("/00"), "main_group").when(n > 4, "subgroup")
    )


def parent_code(code: Column) -> Column:
    """The code one level up; null for a section."""
    level = code_level(code)
    return (
        F.when(level == "class", F.substring(code, 1, 1))
        .when(level == "subclass", F.substring(code, 1, 3))
        .when(level == "main_group", F.substring(code, 1, 4))
        .when(level == "subgroup", F.concat(F.substring_index(code, "/", 1), F.lit("/00")))
    )


def main_group(code: Column) -> Column:
    """Text before the slash; null without one."""
    return F.when(code.contains("/"), F.substring_index(code, "/", 1))


def prefix_code(raw: Column) -> Column:
    """The code a cleaned text begins with, leading zeros kept; null if it begins with none."""
    found = F.regexp_extract(F.upper(F.regexp_replace(raw, r"\s+", "")), r"^[A-H][0-9]{2}[A-Z](?:[0-9]{1,4}/[0-9]{1,6})?", 0)
    return F.when(found != "", found)


def split_codes(raw: Column) -> Column:
    """Trimmed, non-empty parts between half- or full-width semicolons; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[;；]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def code_tokens(raw: Column) -> Column:
    """Distinct tokens of a code field in order, as ``struct(raw_ipc, code, subclass, status)``.

    A token that does not normalise is tried again without one trailing flag letter
    (``suffix_stripped``); one that fails both ways is ``unmatched``.
    """
    flag = r"(?i)([A-H]\s*[0-9]{2}\s*[A-Z]\s*[0-9]{1,4}\s*/\s*[0-9]{1,6})[IN]$"

    # one step per array pass: inside a lambda nothing computed twice is shared
    flat = F.transform(
        split_codes(raw), lambda p: F.struct(p.alias("raw"), _flat(p).alias("a"), _flat(F.regexp_replace(p, flag, "$1")).alias("b"))
    )
    forms = F.transform(flat, lambda f: F.struct(f["raw"].alias("raw"), _form(f["a"]).alias("a"), _form(f["b"]).alias("b")))

    def token(f: Column) -> Column:
        code = F.coalesce(f["a"], f["b"])
        return F.struct(
            f["raw"].alias("raw_ipc"),
            code.alias("code"),
            F.when(F.length(code) >= 4, F.substring(code, 1, 4)).alias("subclass"),
            F.when(f["a"].isNotNull(), "normalized").when(f["b"].isNotNull(), "suffix_stripped").otherwise("unmatched").alias("status"),
        )

    return F.array_distinct(F.transform(forms, token))


def code_subclasses(raw: Column) -> Column:
    """Sorted distinct subclasses of a code field."""
    return subclasses_of(code_tokens(raw))


def subclasses_of(tokens: Column) -> Column:
    """Sorted distinct subclasses of an array of tokens."""
    found = F.transform(tokens, lambda t: t["subclass"])
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: s.isNotNull())))
