"""Visually identical text with different characters: one consistent form per text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_no_value
from ..session import materialize

# Letters of other scripts that look like a Latin letter of the same case.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ӏ": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O",
    # other forms
    "ɡ": "g", "ɑ": "a", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮯ": "C",
}

# Signs that look the same, and radicals without a decomposition.
SIGNS = {
    "º": "°", "˚": "°", "‐": "-", "‑": "-", "µ": "μ", "∙": "·", "・": "·", "⋅": "·",
    "⺟": "母", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻚": "页", "⻛": "风", "⻜": "飞",
    "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙",
    "⻄": "西", "⻙": "韦", "⻳": "龟", "⺠": "民", "⺩": "王", "⺼": "月", "⻁": "虎", "⻑": "長", "⻒": "長",
}

#: Decompositions that change how a character looks are left alone.
_VISIBLE = ("<super>", "<sub>", "<circle>", "<fraction>", "<font>")

_SPACES = "".join(chr(c) for c in [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_INVISIBLE = "".join(
    chr(c)
    for c in [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F),
              *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
)
_MARKS = "".join(chr(c) for r in ((0x300, 0x370), (0x483, 0x488), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x20F1), (0xFE20, 0xFE30)) for c in range(*r)).replace("͏", "")


def _decompose(ch: str) -> str:
    """Full decomposition, except where it would change the look."""
    form = unicodedata.decomposition(ch)
    if not form or form.startswith(_VISIBLE) or " 0020" in form:  # the last: spacing accents
        return ch
    codes = form.split()
    if codes[0].startswith("<"):
        codes = codes[1:]
    return "".join(_decompose(chr(int(c, 16))) for c in codes)


def _ranges(chars) -> str:
    """The body of a character class, neighbours as ranges: lone characters beyond the BMP are slow to test."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code <= out[-1][1] + 1 + 8 * (code > 0xFFFF):
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Transducer:
    """A longest-match rewriting of grapheme clusters, compiled from the mappings and checked.

    ``table`` maps single characters. The check rejects a mapping whose target holds a character
    that is itself mapped, one that rewrites a plain letter, digit or Han ideograph, and two case
    forms of a letter with one target, so that one pass gives a fixed point.
    """

    def __init__(self, look_alikes: dict[str, str] = LOOK_ALIKES, signs: dict[str, str] = SIGNS) -> None:
        self._direct = {**look_alikes, **signs}
        self.table: dict[str, str] = {}
        skip = {*_SPACES, *_INVISIBLE, *_MARKS}
        for code in range(0x80, 0x30000):
            ch = chr(code)
            if (ch not in self._direct and not unicodedata.decomposition(ch)) or ch in skip:
                continue
            target = self._cluster(ch)
            if target != ch:
                self.table[ch] = target
        self._check(look_alikes)
        keys = _ranges(self.table)
        spaces, hidden, marks = re.escape(_SPACES), re.escape(_INVISIBLE), re.escape(_MARKS)
        # alternatives in order of length: runs of blanks and invisibles, clusters, single characters
        self._pattern = re.compile(
            f"[{hidden}]*[{spaces}][{spaces}{hidden}]*|[{hidden}]+|[^{spaces}{hidden}][{marks}{hidden}]*[{marks}][{marks}{hidden}]*|[{keys}]"
        )
        odd = re.escape(_SPACES.replace(" ", ""))
        # most texts hold no combining mark; without one no cluster is longer than its character
        self._marked = re.compile(f"[{marks}]")
        self._plain = re.compile(f"[{hidden}{spaces}]{{2,}}|[{hidden}{odd}{keys}]")
        self._memo: dict[str, str] = dict(self.table)

    def _cluster(self, cluster: str) -> str:
        parts = []
        for ch in cluster:
            if ch in _INVISIBLE:
                continue
            for d in _decompose(self._direct.get(ch, ch)):
                parts.append(self._direct.get(d, d))
        out = unicodedata.normalize("NFC", "".join(parts))
        # canonical composition may yield a character that is mapped in turn (a sign, a radical)
        return "".join(self._direct.get(c, c) for c in out)

    def _check(self, look_alikes: dict[str, str]) -> None:
        for key, target in self.table.items():
            if key.isascii() or 0x4E00 <= ord(key) <= 0x9FFF:
                raise ValueError(f"plain character mapped: {key!r}")
            if any(c in self.table for c in target):
                raise ValueError(f"mapping of {key!r} is no fixed point")
        for key, target in look_alikes.items():
            if key.isupper() != target.isupper() and key.lower() != key.upper():
                raise ValueError(f"mapping of {key!r} changes the case")

    def _replace(self, match: re.Match) -> str:
        cluster = match.group()
        found = self._memo.get(cluster)
        if found is None:
            if any(c in _SPACES for c in cluster) and not any(c not in _SPACES and c not in _INVISIBLE for c in cluster):
                found = " "
            else:
                found = self._cluster(cluster)
            if len(self._memo) < 1_000_000:
                self._memo[cluster] = found
        return found

    def __call__(self, text: str) -> str:
        if text.isascii():
            return " ".join(text.split()) if not text.isprintable() or "  " in text else text.strip(" ")
        pattern = self._pattern if self._marked.search(text) else self._plain
        return pattern.sub(self._replace, text).strip(" ")


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The transducer of this process, compiled once."""
    return Transducer()


@F.pandas_udf(T.StringType())
def _unify(texts: pd.Series) -> pd.Series:
    run = transducer()
    return texts.map(lambda t: None if t is None else run(t))


def unified(text: Column) -> Column:
    """One form for all texts that look the same.

    Widths, compatibility ideographs and radicals, look-alike letters, composed and decomposed
    accents and unit signs get one spelling; invisible characters vanish; any run of blanks is one
    blank, none at the ends. Case, accents and digits stay. Null gives null, blank gives ``""``.
    """
    return _unify(text)


def form_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """``__id``, ``__raw`` and ``__form``, the digests of text and form, of every row with a value; written once."""
    return materialize(
        df.where(~is_no_value(F.col(text))).select(
            F.col(key).alias("__id"), F.unhex(F.md5(F.col(text))).alias("__raw"), F.unhex(F.md5(unified(F.col(text)))).alias("__form")
        )
    )


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row with a value: ``id``, ``class_id`` (smallest id of its form), ``spelling_id`` (smallest id of its string), ``n_rows``, ``n_spellings``.

    What ``look_alike_pairs`` lists pair by pair, in one row each: rows of one class and different
    spelling are its pairs. Counts are combined per spelling before they meet, so a form held by most
    rows is one state per task.
    """
    forms = form_digests(df, key, text)
    spellings = forms.groupBy("__form", "__raw").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("spelling_id"))
    classes = spellings.groupBy("__form").agg(F.min("spelling_id").alias("class_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"))
    heads = spellings.select("__form", "__raw", "spelling_id").join(classes, "__form").drop("__form")
    return forms.select(F.col("__id").alias("id"), "__raw").join(heads, "__raw").select("id", "class_id", "spelling_id", "n_rows", "n_spellings")


def spelling_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``spelling_a < spelling_b`` of the smallest ids of strings that look the same: the links between classes of equal strings."""
    classes = look_alike_classes(df, key, text).where("n_spellings > 1").select("class_id", "spelling_id").distinct()
    return classes.alias("a").join(classes.alias("b"), "class_id").where("a.spelling_id < b.spelling_id").select(F.col("a.spelling_id").alias("spelling_a"), F.col("b.spelling_id").alias("spelling_b"))


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows whose texts look the same but are different strings.

    Rows with no value are left out; rows repeating one string are each paired with every row of
    another spelling, never with each other. Spellings are compared once per distinct string, by
    digest, so that a form held by most rows costs no more than its spellings; only then are the
    rows of each spelling looked up; tasks with many rows of one spelling are split at run time. An
    empty table gives no rows. ``look_alike_classes`` says the same in one row per row.
    """
    forms = form_digests(df, key, text)
    spellings = forms.groupBy("__form", "__raw").agg(F.count(F.lit(1)).alias("__n"))
    several = spellings.groupBy("__form").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__form")
    rows = forms.join(several, "__form", "left_semi")
    odd = spellings.drop("__n").join(several, "__form", "left_semi")
    pairs = odd.alias("a").join(odd.alias("b"), "__form").where("a.__raw < b.__raw").select("__form", F.col("a.__raw").alias("__a"), F.col("b.__raw").alias("__b"))
    left = pairs.join(rows.select(F.col("__form").alias("__fa"), F.col("__raw").alias("__a"), F.col("__id").alias("__ia")), "__a").where("__fa = __form")
    both = left.join(rows.select(F.col("__raw").alias("__b"), F.col("__id").alias("__ib")), "__b")
    return both.select(F.least("__ia", "__ib").alias("id_a"), F.greatest("__ia", "__ib").alias("id_b"))


def form_sql(text: str, key: str, source: str, name: str) -> str:
    """CTEs of DuckDB that end in ``name`` (``id``, ``raw``, ``form``): the mapping as a table joined by character, then composition."""
    run = transducer()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    codes = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    pairs = ", ".join(f"({ord(k)}, {quoted(v)})" for k, v in sorted(run.table.items()) if k not in _INVISIBLE)
    odd = ", ".join(f"({ord(k)}, {quoted(v)})" for k, v in sorted({**SIGNS, **LOOK_ALIKES}.items()))
    chars = f"unnest(regexp_extract_all({{0}}, '(?s).')) AS c, generate_subscripts(regexp_extract_all({{0}}, '(?s).'), 1) AS pos"
    again = "string_agg(coalesce(t, c), '' ORDER BY pos)"
    return f"""{name}_m(u, t) AS (VALUES {pairs}), {name}_o(u, t) AS (VALUES {odd}),
{name}_r AS (SELECT {key} AS id, {text} AS raw, regexp_replace({text}, '[{codes(_INVISIBLE)}]+', '', 'g') AS v FROM {source} WHERE {text} IS NOT NULL),
{name}_c AS (SELECT id, {chars.format('v')} FROM {name}_r), {name}_1 AS (SELECT id, nfc_normalize({again}) AS v FROM {name}_c LEFT JOIN {name}_m ON unicode(c) = u GROUP BY id),
{name}_d AS (SELECT id, {chars.format('v')} FROM {name}_1), {name}_2 AS (SELECT id, {again} AS v FROM {name}_d LEFT JOIN {name}_o ON unicode(c) = u GROUP BY id),
{name} AS (SELECT r.id, r.raw, trim(regexp_replace(coalesce(x.v, ''), '[{codes(_SPACES)}]+', ' ', 'g')) AS form FROM {name}_r r LEFT JOIN {name}_2 x ON r.id = x.id)"""
