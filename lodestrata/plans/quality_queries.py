"""Queries for packed fields, failing rows and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed, parse_lines, skew
from ..functions.dates import full_date
from ..functions.values import NO_VALUE_MARKS
from ..session import table


def _packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both packed fields of raw_records, one row each."""
    df = table(spark, sf_dir, "raw_records").select("rec_id", "feed_code", "ipc_all_raw", "ipc_main_raw")
    return df.select(
        "rec_id",
        "feed_code",
        F.explode(
            F.array(
                *[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("packed")) for f in ("ipc_all_raw", "ipc_main_raw")]
            )
        ).alias("f"),
    ).select("rec_id", "feed_code", "f.field_name", "f.packed")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of fields that hold two or more."""
    out = packed.split_packed(_packed_fields(spark, sf_dir), ["feed_code", "field_name"], "packed")
    return packed.explode_pieces(out, ["rec_id", "field_name"], minimum=2)


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single code with its record, field and position."""
    out = packed.split_packed(_packed_fields(spark, sf_dir), ["feed_code", "field_name"], "packed")
    return packed.explode_pieces(out, ["rec_id", "field_name"])


def p1_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores behind the choice of separators, per source."""
    scored = packed.score_delimiters(_packed_fields(spark, sf_dir), ["feed_code", "field_name"], "packed")
    return scored.select("feed_code", "field_name", "candidate", "n_values", *[F.round(c, 6).alias(c) for c in ("regular", "consistent", "score")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows with the first reason that holds."""
    return parse_lines.failures(table(spark, sf_dir, "raw_lines"), "row_id")


def p3_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound rows as the 31 columns."""
    return parse_lines.sound_rows(table(spark, sf_dir, "raw_lines").select("row_id", "raw_text")).drop("raw_text")


def p3_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows with the reason, the number of fields and the text as it came."""
    return parse_lines.quarantined(table(spark, sf_dir, "raw_lines"), "row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm keys holding at least 2 % of the rows."""
    out = None
    for name, key in (("raw_records", "stkcd"), ("text_records", "listed_parent")):
        heavy = skew.heavy_keys(table(spark, sf_dir, name).select(key), key, 0.02)
        part = heavy.select(F.lit(key).alias("field_name"), "key_value")
        out = part if out is None else out.unionAll(part)
    return out


def p6_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per stock code of raw_records: rows, dates, distinct applications."""
    df = table(spark, sf_dir, "raw_records").select("stkcd", "application_no", "application_date", "loaded_at", "ipc_all_raw")
    df = df.withColumn("application_date", full_date(F.col("application_date")))
    one = F.lit(1).cast("bigint")
    rows = skew.tree_aggregate(
        df,
        ["stkcd"],
        [
            skew.Measure("n_rows", one),
            skew.Measure("n_dated", F.when(F.col("application_date").isNotNull(), one).otherwise(F.lit(0).cast("bigint"))),
            skew.Measure("first_date", F.col("application_date"), "min"),
            skew.Measure("last_date", F.col("application_date"), "max"),
            skew.Measure("last_loaded", F.col("loaded_at"), "max"),
        ],
    )
    apps = skew.distinct_counts(df, ["stkcd"], "application_no", "n_applications").withColumnRenamed("stkcd", "__k")
    return (
        rows.join(apps, F.col("stkcd").eqNullSafe(F.col("__k")), "left")
        .select("stkcd", "n_rows", "n_dated", "first_date", "last_date", F.unix_micros(F.col("last_loaded").cast("timestamp")).alias("last_loaded_us"), F.coalesce("n_applications", F.lit(0).cast("bigint")).alias("n_applications"))
    )


def _logical_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_lines written as one export and scanned in every mode: records and fields found."""
    import uuid

    from ..session import shared_dir
    from ..sources.logical_csv import MODES, read_logical

    path = f"{shared_dir(spark)}/lodestrata-export-{uuid.uuid4().hex}"
    table(spark, sf_dir, "raw_lines").select("raw_text").where("raw_text is not null").write.text(path)
    out = None
    for mode in MODES:
        size = F.size("fields")
        part = read_logical(spark, path, mode, split_bytes=1 << 20).select(F.lit(mode).alias("mode"), size.alias("n_fields"), (F.length(F.coalesce(F.get("fields", F.lit(28)), F.lit(""))) > 0).alias("has_abstract"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("mode", "n_fields").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("has_abstract").alias("n_abstracts"))


def logical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four scanners over one export."""
    return _logical_modes(spark, sf_dir)


def scanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_records written as an export whose abstracts run over two lines, and read back in every mode."""
    import uuid

    from ..session import shared_dir
    from ..sources.logical_csv import MODES, read_logical

    path = f"{shared_dir(spark)}/lodestrata-export-{uuid.uuid4().hex}"
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    flat = F.regexp_replace(F.coalesce("abstract_clean", F.lit("")), r"[\r\n]+", " ")
    at = {0: F.concat(F.lit('="'), F.lpad(F.pmod("text_id", F.lit(1_000_000)).cast("string"), 6, "0"), F.lit('"')), 2: quoted(F.col("company_name")), 16: quoted(F.col("application_no")), 28: quoted(F.concat(flat, F.lit("\n2. "))), 30: F.col("text_id").cast("string")}
    line = F.concat_ws(",", *[at.get(i, F.lit("")) for i in range(parse_lines.N_FIELDS)])
    table(spark, sf_dir, "text_records").select(line).write.text(path)
    out = None
    for mode in MODES:
        field = lambda i: F.get("fields", F.lit(i))
        part = read_logical(spark, path, mode, split_bytes=1 << 20).select(
            F.lit(mode).alias("mode"), field(0).alias("stkcd_raw"), field(2).alias("company_name"), field(16).alias("application_no"), field(28).alias("abstract"), field(30).alias("last_field"), F.size("fields").alias("n_fields")
        )
        out = part if out is None else out.unionAll(part)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p1_delimiters, p3_found, p3_sound, p3_quarantine, p6_found, p6_firms, logical_records, scanned_records)}

# ---- the same in DuckDB -------------------------------------------------------------------------

_NONE = "('', " + ", ".join("'" + m.replace("'", "''") + "'" for m in NO_VALUE_MARKS) + ")"
_HALF = "translate(@@, '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "\u3000', '" + "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " ')"


def half(c: str) -> str:
    return _HALF.replace("@@", c)


def no_value(c: str) -> str:
    return f"(coalesce(upper(trim({half(c)})), '') IN {_NONE})"


def full_date_sql(c: str) -> str:
    return f"try_strptime(trim({half(c)}), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d', '%Y年%m月%d日'])::date"


_CLEAN = r"""regexp_replace(regexp_replace(x, '[\s\x01\x{a0}\x{3000}]+', '', 'g'), '^["''“”‘’]+|["''“”‘’]+$', '', 'g')"""
_PIECES = rf"""f AS (SELECT rec_id, 'ipc_all_raw' AS field_name, ipc_all_raw AS v FROM raw_records UNION ALL SELECT rec_id, 'ipc_main_raw', ipc_main_raw FROM raw_records),
b AS (SELECT rec_id, field_name, regexp_replace(v, '^\s*\[((?s).*)\]\s*$', '\1') AS v FROM f WHERE NOT {no_value('v')}),
c AS (SELECT rec_id, field_name, regexp_replace(regexp_replace(v, '([0-9)\]INin])([ \x{{a0}}]+)([A-Za-z][0-9?])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), '([;；,，、|｜\r\n\t\x{{3000}}]+)', chr(1) || '\1' || chr(1), 'g') AS v FROM b),
d AS (SELECT rec_id, field_name, regexp_extract_all(v, '[\s\[\x01]*(?:"[^"]*"|''[^'']*''|“[^”]*”)[^\x01]*|[^\x01]+') AS l FROM c),
e AS (SELECT rec_id, field_name, list_transform(l, lambda x: upper({half(_CLEAN)})) AS l FROM d),
g AS (SELECT rec_id, field_name, list_filter(l, lambda x: NOT regexp_full_match(x, '[;,、|.&+#]*') AND x NOT IN {_NONE}) AS l FROM e),
p AS (SELECT rec_id, field_name, len(l) AS n, unnest(range(1, len(l) + 1))::int AS pos, unnest(l) AS ipc_value FROM g)"""

_FIELD = r'"(?:[^"]|"")*"|[^",][^,]*|'
_PARSED = rf"""q AS (SELECT row_id, raw_text, regexp_full_match(raw_text, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS ok FROM raw_lines),
w AS (SELECT row_id, raw_text, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || raw_text, '(?s),({_FIELD})', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) END AS l FROM q),
r AS (SELECT row_id, raw_text, l, CASE WHEN ok IS NULL THEN 'column_count' WHEN NOT ok THEN 'quoting' WHEN len(l) <> 31 THEN 'column_count' WHEN NOT regexp_matches(l[1], '\p{{Nd}}') THEN 'stock_code' WHEN {no_value('l[17]')} THEN 'application_no'
 WHEN {full_date_sql('l[18]')} IS NULL THEN 'application_date' WHEN regexp_matches(l[29], '[\x{{fffd}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'abstract' END AS fail_reason FROM w)"""

_FLAT = "regexp_replace(coalesce(abstract_clean, ''), '[\\r\\n]+', ' ', 'g')"
SQL: dict[str, str] = {
    # prefix keeps the first line only, so what follows it is missing; joined has no break between the lines
    "scanned_records": f"""SELECT mode, '="' || lpad((text_id % 1000000)::varchar, 6, '0') || '"' AS stkcd_raw, coalesce(company_name, '') AS company_name, coalesce(application_no, '') AS application_no,
 CASE mode WHEN 'prefix' THEN {_FLAT} WHEN 'joined' THEN {_FLAT} || '2. ' ELSE {_FLAT} || chr(10) || '2. ' END AS abstract, CASE WHEN mode = 'prefix' THEN '' ELSE text_id::varchar END AS last_field, 31 AS n_fields
 FROM text_records, (SELECT unnest(['prefix', 'full', 'buffered', 'joined']) AS mode)""",
    "p1_found": f"WITH {_PIECES} SELECT rec_id, field_name, pos, ipc_value FROM p WHERE n >= 2",
    "p1_values": f"WITH {_PIECES} SELECT rec_id, field_name, pos, ipc_value FROM p",
    "p3_found": f"WITH {_PARSED} SELECT row_id, fail_reason FROM r WHERE fail_reason IS NOT NULL",
    "p3_quarantine": f"WITH {_PARSED} SELECT row_id, fail_reason, len(l)::int AS n_fields, raw_text AS corrupt_text FROM r WHERE fail_reason IS NOT NULL",
    "p3_sound": f"WITH {_PARSED} SELECT row_id, {', '.join(f'l[{i + 1}] AS {c}' for i, c in enumerate(parse_lines.COLUMNS))} FROM r WHERE fail_reason IS NULL",
    "p6_found": "SELECT 'stkcd' AS field_name, stkcd AS key_value FROM raw_records WHERE stkcd IS NOT NULL GROUP BY stkcd HAVING count(*) >= 0.02 * (SELECT count(stkcd) FROM raw_records)"
    " UNION ALL SELECT 'listed_parent', listed_parent FROM text_records WHERE listed_parent IS NOT NULL GROUP BY listed_parent HAVING count(*) >= 0.02 * (SELECT count(listed_parent) FROM text_records)",
    "p6_firms": f"SELECT stkcd, count(*) AS n_rows, count(d) AS n_dated, min(d) AS first_date, max(d) AS last_date, epoch_us(max(loaded_at)) AS last_loaded_us, count(DISTINCT application_no) AS n_applications FROM (SELECT *, {full_date_sql('application_date')} AS d FROM raw_records) GROUP BY stkcd",
}
