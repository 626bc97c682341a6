"""What counts as "no value", and character forms that need no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that stand for nothing, in upper case.
NO_VALUE_MARKS = [
    "-", "--", "---", "—", "——", "–", "/", "\\", "N/A", "NA", "N.A.", "#N/A", "NULL", "NONE", "NAN", "NIL",
    "\\N", "(NULL)", "UNKNOWN", "TBD", "?", "*", ".", "无", "不详", "待定", "未知", "暂无", "空", "缺失", "未填",
]

#: Java class of everything that renders as white space at the end of a field.
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def half_width(col: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as their half-width forms."""
    return F.translate(col, _FULL, _HALF)


def strip(col: Column) -> Column:
    """Trim any Unicode white space and byte-order marks from both ends."""
    return F.regexp_replace(col, rf"^(?:{SPACES}|﻿)+|(?:{SPACES}|﻿)+$", "")


def trim_spaces(col: Column) -> Column:
    """Trim any Unicode white space from both ends, nothing else."""
    return F.regexp_replace(col, rf"^{SPACES}+|{SPACES}+$", "")


def is_no_value(col: Column) -> Column:
    """True for null, blank, and marks that stand for nothing; never null."""
    bare = F.upper(strip(half_width(col)))
    return F.coalesce((bare == "") | bare.isin([m for m in NO_VALUE_MARKS]), F.lit(True))


def value_or_null(col: Column) -> Column:
    """The column where it holds a value, else null."""
    return F.when(~is_no_value(col), col)
