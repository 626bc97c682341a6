"""Rows that fail to parse: sound rows as columns, the others with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import full_date
from ..functions.values import is_no_value
from .barrier import where_computed

N_FIELDS = 31

# Positions of the fields of the export that have a name.
POSITIONS = {
    0: "stkcd_raw", 2: "company_name", 4: "relation", 6: "industry", 8: "title", 9: "patent_type", 10: "applicant",
    11: "applicant_type", 12: "applicant_address", 16: "application_no", 17: "application_date", 19: "publication_no",
    20: "publication_date", 22: "grant_no", 23: "grant_date", 25: "ipc_all_raw", 26: "ipc_main_raw", 28: "abstract", 29: "claim",
}

COLUMNS = [POSITIONS.get(i, f"field_{i}") for i in range(N_FIELDS)]
CORRUPT = "__corrupt_record"

# Stand-ins for line breaks while the CSV parser runs, which ends a record at a bare line break.
_LF, _CR = "\ue00a", "\ue00d"
_ESCAPE = "\ue00e"
_WHOLE = r"(^|,)\"[^\"]*+(?:\"\"[^\"]*+)*+\"(?=,|$)"


def _hide_breaks(text: Column) -> Column:
    """Line breaks, and a byte-order mark at the start, which the parser drops from its first input, as stand-ins."""
    hidden = F.replace(F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_LF), F.lit(_ESCAPE + "b")), F.lit(_CR), F.lit(_ESCAPE + "c"))
    hidden = F.regexp_replace(F.translate(hidden, "\n\r", _LF + _CR), "^\ufeff", _ESCAPE + "d")
    return F.when(text.rlike(f"^\ufeff|[\\n\\r{_LF}{_CR}{_ESCAPE}]"), hidden).otherwise(text)


def _show_breaks(text: Column) -> Column:
    plain = F.translate(text, _LF + _CR, "\n\r")
    back = F.replace(F.replace(F.replace(plain, F.lit(_ESCAPE + "d"), F.lit("\ufeff")), F.lit(_ESCAPE + "c"), F.lit(_CR)), F.lit(_ESCAPE + "b"), F.lit(_LF))
    return F.when(text.contains(_ESCAPE), F.replace(back, F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))).otherwise(plain)


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _marked(text: Column) -> Column:
    """Sound quoted fields become a bare mark; a quote still opening a field is unsound, and the commas left count the fields."""
    return F.when(text.contains('"'), F.regexp_replace(text, _WHOLE, "$1Q")).otherwise(text)


def _permissive(text: Column) -> Column:
    """One row read under the explicit schema; rows of another width keep their text in CORRUPT."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*COLUMNS, CORRUPT]])
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "sep": ",", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000\u0000",
        "maxCharsPerColumn": "-1", "maxColumns": "20480", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "false",
    }
    # more fields than maxColumns would end the parser; such a row is corrupt without being read
    wide = (_commas(text) >= 20_000) & (_commas(_marked(text)) >= 20_000)
    return F.from_csv(F.when(~wide, _hide_breaks(text)), schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)


def parse_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Columns of ``df`` plus the 31 fields, ``fail_reason``, ``n_fields`` (null where quoting leaves it open) and ``corrupt_text``.

    Every row is first read permissively under an explicit all-string schema that keeps the corrupt
    text. Then rows the parser found corrupt, and those with a quote at the start of a field, about
    which it is lenient, are classified by quoting and field count, and what was read by casts.
    ``fail_reason`` is null for a sound row; otherwise it is the first of ``quoting`` (a field
    beginning with a double quote is not closed or not followed by a comma; null text counts as
    ``column_count``), ``column_count``, ``stock_code`` (no digit), ``application_no`` (no value),
    ``application_date`` (not a full calendar date) and ``abstract`` (replacement or control character
    other than tab and line break). ``corrupt_text`` is the text of a row with a reason, else null.
    The fields of rows failing the first two are null. A field that is empty is an empty string. Line
    breaks and byte-order marks stay in the field they stand in. Columns of ``df`` that clash with a
    new name are kept under ``in_<name>``.
    """
    clash = {c: f"in_{c}" for c in df.columns if c in {*COLUMNS, "fail_reason", "n_fields", "corrupt_text"}}
    text = clash.get(text, text)
    body = F.col(text)
    base = df.withColumnsRenamed(clash).withColumn("__row", _permissive(body))
    # the parser passes over an empty text without a word
    corrupt = F.col("__row").isNull() | F.col(f"__row.`{CORRUPT}`").isNotNull()
    base = base.withColumn("__doubtful", F.coalesce(corrupt | ~body.contains(",") | body.rlike('(^|,)"'), F.lit(True)))
    base = base.withColumn("__marked", F.when(F.col("__doubtful"), _marked(body)))
    unclosed = F.coalesce(F.col("__marked").rlike('(^|,)"'), F.lit(False))
    base = base.withColumn("n_fields", F.when(body.isNotNull() & ~unclosed, F.coalesce(_commas(F.col("__marked")) + 1, F.lit(N_FIELDS))))
    structural = F.when(unclosed, F.lit("quoting")).when(body.isNull() | (F.col("n_fields") != N_FIELDS), F.lit("column_count"))
    parsed = base.withColumn("__structural", structural)
    raw = {c: F.coalesce(F.col(f"__row.`{c}`"), F.lit("")) for c in COLUMNS}
    # the checks below read fields whose line breaks are still hidden, which none of them minds
    reason = (
        F.when(F.col("__structural").isNotNull(), F.col("__structural"))
        .when(~raw["stkcd_raw"].rlike(r"\p{Nd}"), F.lit("stock_code"))
        .when(is_no_value(raw["application_no"]), F.lit("application_no"))
        .when(full_date(raw["application_date"]).isNull(), F.lit("application_date"))
        .when(raw["abstract"].rlike("[�\\p{Cc}&&[^\\t\\n\\r]]"), F.lit("abstract"))
    )
    shown = F.when(F.col("__structural").isNull(), F.transform(F.array(*raw.values()), _show_breaks))
    parsed = parsed.withColumn("fail_reason", reason).withColumn("__fields", shown)
    parsed = parsed.withColumns({c: F.col("__fields")[i] for i, c in enumerate(COLUMNS)})
    return parsed.withColumn("corrupt_text", F.when(F.col("fail_reason").isNotNull(), body)).drop("__marked", "__structural", "__row", "__fields", "__doubtful")


def failures(df: DataFrame, key: str, text: str = "raw_text") -> DataFrame:
    """``key`` and ``fail_reason`` of the rows that are not sound."""
    return where_computed(parse_lines(df, text).select(key, "fail_reason"), F.col("fail_reason").isNotNull())


def quarantined(df: DataFrame, key: str, text: str = "raw_text") -> DataFrame:
    """``key``, ``fail_reason``, ``n_fields`` and the corrupt text of the rows that are not sound."""
    return where_computed(parse_lines(df, text).select(key, "fail_reason", "n_fields", "corrupt_text"), F.col("fail_reason").isNotNull())


def sound_rows(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """The sound rows as columns beside those of ``df``."""
    return where_computed(parse_lines(df, text), F.col("fail_reason").isNull()).drop("fail_reason", "n_fields", "corrupt_text")
