"""Records to applications: canonical rows, firm edges, the baseline universe and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.dates import lenient_date
from ..functions.keys import joined_values
from ..functions.values import trim_spaces


def normalize_records(raw: DataFrame, ordinal: str) -> DataFrame:
    """The normalised record columns, ``ord`` being the order in which "first" is decided.

    Text fields are trimmed, null becomes ``""``; dates that do not parse are null.
    """
    plain = ["stkcd_raw", "company_name", "relation", "applicant", "applicant_type", "application_no", "publication_no", "grant_no", "patent_type", "ipc_all_raw", "ipc_main_raw"]
    dates = ["application_date", "publication_date", "grant_date"]
    return raw.select(
        F.col(ordinal).alias("ord"),
        *[trim_spaces(F.coalesce(c, F.lit(""))).alias(c) for c in plain],
        *[lenient_date(F.col(c)).alias(c) for c in dates],
        codes.stock_code(F.col("stkcd_raw")).alias("stkcd"),
        codes.patent_type_group(F.col("patent_type")).alias("patent_type_group"),
    )


def record_failures(records: DataFrame) -> DataFrame:
    """One row per failure of a normalised record: ``ord``, ``failure_type``, ``count``.

    A missing application number rejects the record and is its only failure; an invalid date and
    unmatched code tokens are reported and the record kept.
    """
    bad = F.size(F.filter(codes.code_tokens(F.col("ipc_all_raw")), lambda t: t["status"] == "unmatched"))
    return (
        records.select("ord", "application_no", "application_date", bad.alias("bad"))
        .select(
            "ord",
            F.explode(
                F.filter(
                    F.array(
                        F.when(F.col("application_no") == "", F.struct(F.lit("missing_application_no").alias("t"), F.lit(1).alias("n"))),
                        F.when((F.col("application_no") != "") & F.col("application_date").isNull(), F.struct(F.lit("invalid_application_date").alias("t"), F.lit(1).alias("n"))),
                        F.when((F.col("application_no") != "") & (F.col("bad") > 0), F.struct(F.lit("unmatched_ipc_token").alias("t"), F.col("bad").alias("n"))),
                    ),
                    lambda f: f.isNotNull(),
                )
            ).alias("f"),
        )
        .select("ord", F.col("f.t").alias("failure_type"), F.col("f.n").cast("bigint").alias("count"))
    )


def first_rows(rows: DataFrame, order: list[str], n: int = 10_000) -> DataFrame:
    """The first ``n`` rows in ``order``: the sample of failures or examples kept for reading.

    Taken per task before the final merge, so a table of any size costs ``n`` rows per task.
    """
    return rows.orderBy(*order).limit(n)


def canonical_core(records: DataFrame) -> DataFrame:
    """One row per application.

    A date survives if all records that have one agree, else it is null and its conflict flag is 1;
    of several numbers the smallest is taken; labels and codes are sorted distinct joins; an
    application is an invention if any record is, else of the first record's type.
    """
    date = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    conflict = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)).cast("int").alias(f"{c}_conflict")
    several = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit(""))) != F.max(F.nullif(F.col(c), F.lit(""))), F.lit(False))
    tokens = records.where(F.col("application_no") != "").withColumn("subs", codes.code_subclasses(F.col("ipc_all_raw"))).withColumn(
        "mains", codes.code_subclasses(F.col("ipc_main_raw"))
    )
    grouped = tokens.groupBy("application_no").agg(
        *[date(c) for c in ("application_date", "publication_date", "grant_date")],
        *[F.min(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("publication_no", "grant_no")],
        joined_values(F.col("patent_type")).alias("patent_type"),
        F.max(F.col("patent_type_group") == "invention").alias("__inv"),
        F.min_by("patent_type_group", "ord").alias("__first"),
        joined_values(F.col("ipc_all_raw")).alias("raw_ipc_values"),
        F.collect_set("subs").alias("__sets"),
        F.min(F.get("mains", F.lit(0))).alias("ipc_main_subclass"),
        F.count(F.lit(1)).alias("source_record_count"),
        *[conflict(c) for c in ("application_date", "publication_date", "grant_date")],
        (several("publication_no") | several("grant_no") | several("patent_type")).cast("int").alias("metadata_conflict_flag"),
    )
    return grouped.select(
        "application_no", "application_date", "publication_date", "grant_date", "publication_no", "grant_no", "patent_type",
        F.when(F.col("__inv"), "invention").otherwise(F.col("__first")).alias("patent_type_group"),
        "raw_ipc_values", F.array_sort(F.array_distinct(F.flatten("__sets"))).alias("ipc_subclasses"), "ipc_main_subclass", "source_record_count",
        "application_date_conflict", "publication_date_conflict", "grant_date_conflict", (F.size("__sets") > 1).cast("int").alias("ipc_conflict_flag"), "metadata_conflict_flag",
    )


def firm_edges(records: DataFrame) -> DataFrame:
    """One row per firm and application: first values in record order, joined relations, eligibility."""
    rows = records.where((F.col("application_no") != "") & F.col("stkcd").isNotNull())
    first = lambda c: F.min_by(c, "ord").alias(c)
    return rows.groupBy("stkcd", "application_no").agg(
        F.min("stkcd").alias("listed_parent"),
        *[first(c) for c in ("stkcd_raw", "company_name")],
        joined_values(F.col("relation")).alias("relation"),
        joined_values(F.col("relation")).alias("relation_type"),
        F.max(codes.eligible_relation(F.col("relation"))).alias("baseline_eligible"),
        *[first(c) for c in ("applicant", "applicant_type")],
    )


def firm_counts(edges: DataFrame) -> DataFrame:
    """Eligible and all firms per application; edges are unique per firm, so rows are counted."""
    return edges.groupBy("application_no").agg(
        F.sum(F.col("baseline_eligible").cast("bigint")).alias("eligible_firm_count"), F.count(F.lit(1)).alias("all_firm_count")
    )


def with_firm_counts(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Core rows with their firm counts, 0 where there is no edge."""
    zero = F.lit(0).cast("bigint")
    return core.join(firm_counts(edges), "application_no", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("eligible_firm_count", "all_firm_count")}
    )


def in_universe():
    """The predicate of the baseline universe."""
    return (
        (F.col("eligible_firm_count") > 0) & F.col("patent_type_group").isin(codes.BASELINE_TYPES) & F.col("application_date").isNotNull() & (F.col("application_date_conflict") == 0)
    )


def baseline_universe(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Applications of an eligible firm, of a baseline type, with one known date."""
    return with_firm_counts(core, edges).where(in_universe())


def exclusion_reasons(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Applications left out of the universe with all reasons, joined by ``;``."""
    counted = with_firm_counts(core, edges)
    reasons = F.concat_ws(
        ";",
        F.when(F.col("eligible_firm_count") == 0, "no_baseline_relation").when(~in_universe(), "excluded_from_ipc_universe"),
        F.when(F.col("application_date").isNull(), "invalid_application_date"),
        F.when(F.col("application_date_conflict") == 1, "application_date_conflict"),
    )
    return counted.select("application_no", reasons.alias("exclusion_reason")).where("exclusion_reason <> ''")


def type_counts(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Eligible applications by quarter and type, as columns, with their total."""
    from ..functions.dates import quarter_label

    counted = with_firm_counts(core, edges).where((F.col("eligible_firm_count") > 0) & F.col("application_date").isNotNull())
    kinds = ["invention", "utility_model", "design", "other"]
    return counted.groupBy(quarter_label(F.col("application_date")).alias("quarter")).agg(
        *[F.count_if(F.col("patent_type_group") == k).alias(f"{k}_count") for k in kinds], F.count(F.lit(1)).alias("eligible_all_count")
    )


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges per single relation."""
    return edges.select(F.explode(F.split("relation_type", "; ")).alias("relation")).where("relation <> ''").groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"))
