"""Audits: observed codes, coverage by dimension, dictionary merging and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.dates import quarter_label
from . import records

COVERAGE_DIMENSIONS = ["patent_type_group", "industry", "relation", "applicant_type"]
MISSING, MULTI = "__MISSING__", "__MULTI__"
CURRENT, HISTORICAL = "2026.01", "2025.01"


def observed_codes(records: DataFrame, key: str, all_field: str, main_field: str) -> DataFrame:
    """Every token of both fields: ``key``, ``raw_code``, ``code`` (null: malformed), ``is_main``."""
    tagged = F.array(
        F.struct(codes.split_codes(F.col(all_field)).alias("t"), F.lit(0).alias("is_main")), F.struct(codes.split_codes(F.col(main_field)).alias("t"), F.lit(1).alias("is_main"))
    )
    rows = records.select(key, F.explode(tagged).alias("f")).select(key, "f.is_main", F.explode("f.t").alias("raw_code"))
    return rows.select(key, "raw_code", codes.normalize_code(F.col("raw_code")).alias("code"), "is_main")


def observed_status(observed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Occurrences of every code, in all and in either field, with its standing in the dictionary."""
    counts = observed.where("code is not null").groupBy("code").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.count_if(F.col("is_main") == 0).alias("all_field_occurrences"), F.count_if(F.col("is_main") == 1).alias("main_field_occurrences")
    )
    versions = dictionary.groupBy(F.col("ipc_code").alias("code")).agg(
        F.max(F.when(F.col("scheme_version") == CURRENT, F.col("is_valid"))).alias("now"), F.max(F.when(F.col("scheme_version") == HISTORICAL, F.col("is_valid"))).alias("then"),
        F.min("ipc_level").alias("ipc_level"),
    )
    status = (
        F.when(F.col("now"), "valid_in_2026").when(F.col("then"), "valid_in_2025_only").when(F.col("now").isNotNull(), "present_but_not_valid_in_2026").otherwise("unmatched")
    )
    used = F.when(F.col("now"), CURRENT).when(F.col("then"), HISTORICAL).when(F.col("now").isNotNull(), CURRENT)
    return counts.join(versions, "code", "left").select(
        F.col("code").alias("ipc_code"), "occurrence_count", "all_field_occurrences", "main_field_occurrences", status.alias("status"), used.alias("dictionary_version_used"),
        F.when(used.isNotNull(), F.col("ipc_level")).alias("ipc_level"), F.when(used.isNotNull(), codes.parent_code(F.col("code"))).alias("parent_code"),
    )


def top_malformed(observed: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent malformed tokens, ties by token."""
    return observed.where("code is null").groupBy("raw_code").agg(F.count(F.lit(1)).alias("occurrence_count")).orderBy(F.desc("occurrence_count"), "raw_code").limit(n)


def collapse(values):
    """The only value of a set; a mark for none and one for several."""
    n = F.size(values)
    return F.when(n == 0, MISSING).when(n > 1, MULTI).otherwise(F.get(values, F.lit(0)))


def coverage_apps(core: DataFrame, edges: DataFrame, industries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every dated application of an eligible firm, of any type, with ``has_ipc`` and the dimensions.

    ``industries`` has ``application_no`` and ``industry``, several rows per application where they differ.
    """
    valid = dictionary.where("is_valid and ipc_level = 'subclass'").select(F.col("ipc_code").alias("s")).distinct()
    one = lambda c: collapse(F.collect_set(F.nullif(F.trim(c), F.lit("")))).alias(c)
    held = edges.where("baseline_eligible = 1").groupBy("application_no").agg(one("relation"), one("applicant_type"))
    apps = records.with_firm_counts(core, edges).where("eligible_firm_count > 0 and application_date is not null")
    coded = apps.select("application_no", F.explode("ipc_subclasses").alias("s")).join(valid, "s", "left_semi").select("application_no").distinct().withColumn("has_ipc", F.lit(True))
    named = industries.groupBy("application_no").agg(one("industry"))
    joined = apps.select("application_no", "application_date", "patent_type_group").join(held, "application_no").join(named, "application_no", "left").join(coded, "application_no", "left")
    return joined.select(
        "application_no", F.year("application_date").alias("year"), quarter_label(F.col("application_date")).alias("quarter"), F.coalesce("has_ipc", F.lit(False)).alias("has_ipc"), *COVERAGE_DIMENSIONS
    )


def coverage_by_dimension(apps: DataFrame, dimensions: list[str]) -> DataFrame:
    """Coded and missing applications by year, quarter and category of each dimension, and overall.

    ``apps`` has ``year``, ``quarter``, ``has_ipc`` and the dimension columns, one row per application.
    One pass of grouping sets serves all dimensions.
    """
    sets = [["year", "quarter"], *[["year", "quarter", d] for d in dimensions]]
    known = apps.withColumns({d: F.coalesce(d, F.lit(MISSING)) for d in dimensions})
    out = known.groupingSets(sets, "year", "quarter", *dimensions).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("patent_count"), F.count_if(F.col("has_ipc")).alias("ipc_coded_patent_count")
    )
    name, category = F.lit("overall"), F.lit("all")
    for d in dimensions:
        name, category = F.when(F.col(d).isNotNull(), F.lit(d)).otherwise(name), F.when(F.col(d).isNotNull(), F.col(d)).otherwise(category)
    return with_rates(out.select("year", "quarter", name.alias("dimension"), category.alias("category"), "patent_count", "ipc_coded_patent_count"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Missing count and both rates."""
    missing = F.col("patent_count") - F.col("ipc_coded_patent_count")
    return counts.withColumns(
        {"ipc_missing_patent_count": missing, "ipc_coding_rate": F.try_divide("ipc_coded_patent_count", "patent_count"), "ipc_missing_rate": F.try_divide(missing, F.col("patent_count"))}
    )


def coverage_annual(coverage: DataFrame) -> DataFrame:
    """Yearly roll-up of the quarterly coverage."""
    return with_rates(coverage.groupBy("year", "dimension", "category").agg(F.sum("patent_count").alias("patent_count"), F.sum("ipc_coded_patent_count").alias("ipc_coded_patent_count")))


#: What merging reads of a scheme and of a list of titles.
SCHEME = "file string, row_no int, sha256 string, ipc_code string, ipc_level string, parent_code string, title_en string, source_symbol string, source_kind string"
TITLES = "file string, row_no int, sha256 string, ipc_code string, title string"


def merge_dictionary(scheme: DataFrame, valid: DataFrame, titles: DataFrame, titles_zh: DataFrame, version: str) -> DataFrame:
    """One version of the dictionary: scheme entries with validity, titles and where each came from.

    The scheme's own title stands; a title list fills in where it has none, its last row of a code. Of
    several Chinese titles the first stands, in order of file and row.
    """
    place = F.struct("file", "row_no")
    en = titles.groupBy(F.col("ipc_code").alias("__e")).agg(F.max_by("title", place).alias("title_list"))
    zh = titles_zh.groupBy(F.col("ipc_code").alias("__z")).agg(F.min_by(F.struct(F.nullif("title", F.lit("")).alias("title"), "file", "sha256"), place).alias("zh"))
    ok = valid.select(F.col("ipc_code").alias("__v")).distinct()
    j = scheme.join(en, F.col("ipc_code") == F.col("__e"), "left").join(zh, F.col("ipc_code") == F.col("__z"), "left").join(ok, F.col("ipc_code") == F.col("__v"), "left")
    return decorate(
        j.select(
            "ipc_code", "ipc_level", "parent_code", F.coalesce(F.nullif("title_en", F.lit("")), "title_list").alias("title_en"), F.col("zh.title").alias("title_zh"), F.col("__v").isNotNull().alias("is_valid"),
            F.lit(version).alias("scheme_version"), F.col("file").alias("source_en"), F.col("zh.file").alias("source_zh"), F.col("sha256").alias("source_sha256_en"), F.col("zh.sha256").alias("source_sha256_zh"),
            "source_symbol", "source_kind",
        )
    )


def decorate(dictionary: DataFrame) -> DataFrame:
    """Main group, title status with a note, and ``code`` and ``level`` as short names of code and level."""
    named = F.col("title_zh").isNotNull()
    return dictionary.withColumns(
        {
            "code": F.col("ipc_code"),
            "level": F.col("ipc_level"),
            "main_group_code": F.when(F.col("ipc_code").contains("/"), F.concat(F.substring_index("ipc_code", "/", 1), F.lit("/00"))),
            "title_zh_status": F.when(named, "matched").otherwise("missing_source"),
            "parse_note": F.when(named, "scheme joined to the Chinese title of its section").otherwise("no Chinese title found for the code"),
        }
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dictionary_summary(dictionary: DataFrame) -> DataFrame:
    """Entries by version, level and validity."""
    return dictionary.groupBy("scheme_version", "ipc_level", "is_valid").agg(F.count(F.lit(1)).alias("n_codes"))
