"""Text records to applications, by mode and by longest text; n-gram novelty against earlier texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import lenient_date, period_of_year, quarter_label
from ..functions.keys import joined_values
from ..functions.values import trim_spaces
from .barrier import broadcast_if_small
from .gram_history import BLOCK, ROUND, SLICE, blocks_of, centroid_scores, cuts_of, part_of
from ..functions.text import distinct_chars, ngrams_of, token_bucket

META = ["stkcd_raw", "stkcd", "company_name", "relation", "relation_type", "listed_parent", "applicant", "applicant_type"]
#: Dates up to which a table of one row per date is broadcast.
DATES = 50_000


def prepared(raw: DataFrame, ordinal: str) -> DataFrame:
    """Text records with trimmed key, parsed date, null texts as ``""`` and ``ord``; no key, no row."""
    return raw.select(
        F.col(ordinal).alias("ord"), trim_spaces(F.col("application_no")).alias("application_no"), *META, lenient_date(F.col("application_date")).alias("application_date"), "patent_type_group",
        F.coalesce("baseline_eligible", F.lit(0)).alias("baseline_eligible"), F.coalesce("claim_present_flag", F.lit(0)).alias("claim_present_flag"),
        F.coalesce("claim_length_chars", F.lit(0)).alias("claim_length_chars"), F.coalesce("abstract_clean", F.lit("")).alias("abstract_clean"),
    ).where("application_no <> ''")


def text_core(rows: DataFrame, meta: list[str] = META) -> DataFrame:
    """One row per application: the longest text, the first eligible record's metadata, the earliest date.

    Only the ``meta`` named are made: columns inside structs are exchanged whether they are used or not.
    """
    eligible = F.col("baseline_eligible") == 1
    best = F.struct(F.length("abstract_clean").alias("len"), (-F.col("ord")).alias("o"), F.struct("abstract_clean", "patent_type_group", *meta).alias("r"))
    grouped = rows.groupBy("application_no").agg(
        F.max(best).alias("best"),
        *([F.min_by(F.struct(*meta), F.when(eligible, F.col("ord"))).alias("rep")] if meta else []),
        F.min("application_date").alias("application_date"),
        F.coalesce(F.min("application_date") != F.max("application_date"), F.lit(False)).cast("int").alias("application_date_conflict"),
        F.max(eligible).alias("any_eligible"),
        # a set of digests: counting distinct texts would exchange all texts once more
        F.size(F.collect_set(F.unhex(F.md5(F.nullif(F.col("abstract_clean"), F.lit("")))))).cast("bigint").alias("abstract_version_count"),
        F.count(F.lit(1)).alias("abstract_source_record_count"),
        *[joined_values(F.col(c), " | ").alias(f"{n}_values") for c, n in (("relation_type", "relation_type"), ("listed_parent", "listed_parent"), ("applicant", "applicant"))],
        F.max("claim_present_flag").alias("claim_present_flag"),
        F.max("claim_length_chars").alias("claim_length_chars"),
    )
    text = F.col("best.r.abstract_clean")
    return grouped.select(
        "application_no", "application_date", quarter_label(F.col("application_date")).alias("quarter"), F.col("best.r.patent_type_group").alias("patent_type_group"),
        *[F.coalesce(F.col(f"rep.{c}"), F.col(f"best.r.{c}")).alias(c) for c in meta],
        text.alias("abstract_clean"), F.length(text).alias("abstract_length_chars"), distinct_chars(text).alias("abstract_unique_char_count"),
        "abstract_source_record_count", "abstract_version_count", (F.col("abstract_version_count") > 1).cast("int").alias("abstract_conflict_flag"),
        "relation_type_values", "listed_parent_values", "applicant_values", (F.col("any_eligible") & (F.col("application_date_conflict") == 0)).cast("int").alias("baseline_eligible"),
        "claim_present_flag", "claim_length_chars", "application_date_conflict",
    )


def text_firm_edges(rows: DataFrame, core: DataFrame) -> DataFrame:
    """First eligible record per listed parent and application without a date conflict, with joined values."""
    eligible = rows.where("baseline_eligible = 1")
    grouped = eligible.groupBy("listed_parent", "application_no").agg(
        F.min_by(F.struct("relation_type", "applicant", "applicant_type", "abstract_clean"), "ord").alias("r"),
        joined_values(F.col("relation_type"), " | ").alias("relation_type_values"),
        joined_values(F.col("applicant"), " | ").alias("applicant_values"),
    )
    derived = core.where("application_date_conflict = 0").select(
        "application_no", "application_date", "quarter", "abstract_length_chars", "abstract_unique_char_count", "abstract_source_record_count", "abstract_version_count", "abstract_conflict_flag"
    )
    return grouped.join(derived, "application_no").select("listed_parent", "application_no", "application_date", "quarter", "r.*", "relation_type_values", "applicant_values", *derived.columns[3:])


def pick_mode(rows: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """Most frequent non-empty value per key; ties by the longer string, then the first seen."""
    counted = rows.where(F.col(value) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("o"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", F.length(value), -F.col("o"))).alias(value))


def pick_longest(rows: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """Longest value per key, first seen wins."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), -F.col(ordinal))).alias(value))


def canonical_patents(rows: DataFrame) -> DataFrame:
    """One row per application by the mode rule; a date stands only if all agree."""
    picked = None
    for c in ("company_name", "applicant", "applicant_type", "patent_type_group"):
        one = pick_mode(rows, ["application_no"], c, "ord")
        picked = one if picked is None else picked.join(one, "application_no", "full")
    rest = rows.groupBy("application_no").agg(
        F.when(F.min("application_date") == F.max("application_date"), F.min("application_date")).alias("application_date"),
        F.max_by("abstract_clean", F.struct(F.length("abstract_clean"), -F.col("ord"))).alias("abstract_clean"), F.max("baseline_eligible").alias("baseline_firm"), F.count(F.lit(1)).alias("source_record_count"),
    )
    return rest.join(picked, "application_no", "left").withColumn("application_quarter", F.coalesce(quarter_label(F.col("application_date")), F.lit("unknown")))


def ngram_frequencies(docs: DataFrame, low: int = 2, high: int = 4, buckets: int | None = None) -> DataFrame:
    """``app``, ``date``, ``g``, ``tf``: n-gram counts, summed per document before anything else.

    ``docs`` has ``app``, ``date``, ``text``. With ``buckets`` n-grams are hashed.
    """
    # characters are cut once per text; cutting substrings by position would be quadratic in its length
    cut = docs.select("app", "date", F.split("text", "").alias("c"))
    grams = cut.select("app", "date", F.explode(ngrams_of(F.col("c"), low, high)).alias("g"))
    if buckets:
        grams = grams.withColumn("g", token_bucket(F.col("g"), buckets))
    return grams.groupBy("app", "date", "g").agg(F.count(F.lit(1)).alias("tf"))


def pit_novelty(docs: DataFrame, buckets: int | None = None, count_empty_grams: bool = True, low: int = 2, high: int = 4, block: int = BLOCK, rounds: int = 1, least: int = ROUND) -> DataFrame:
    """Novelty of every text against the centroid of all texts of strictly earlier dates.

    ``docs`` has one row per ``app`` with ``date`` and ``text`` (null or empty texts get counts, no
    scores). A document's weights depend on its own date only, so the centroid is a running sum of
    daily sums of unit vectors, and its squared norm a running sum of 2 S d + d^2; both are made in
    blocks of dates of about ``block`` characters, in up to ``rounds`` rounds of ``least`` characters or more (``gram_history``):
    more rounds need less disk and more reading. History counts all non-empty texts, or those with an n-gram
    only if ``count_empty_grams`` is false. N-grams are of ``low`` to ``high`` characters. ``docs`` is
    read twice and three times a round, so it should be a table and not a plan: no copy of the texts is written here.
    """
    from ..session import materialize

    size = F.coalesce(F.length("text"), F.lit(0))
    counted = size >= (1 if count_empty_grams else low)
    per_day = docs.where("date is not null").groupBy("date").agg(F.count_if(counted).alias("n"), F.sum(size).alias("chars"))
    days = W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    per_day = materialize(blocks_of(per_day.withColumn("history", F.coalesce(F.sum("n").over(days), F.lit(0))), block), remove_exchanged=True)
    chars = per_day.agg(F.sum("chars")).first()[0] or 0
    dated = docs.where(size > 0).join(broadcast_if_small(per_day.select("date", "history", "grp", "parts"), DATES), "date")
    placed = dated.select("app", "date", "text", "history", "grp", part_of(F.col("app"), F.col("parts")).alias("part"))
    scored = centroid_scores(placed, low, high, buckets, max(8, chars // SLICE), cuts_of(chars, block, rounds, least))
    out = docs.select("app", "date").join(broadcast_if_small(per_day.select("date", "history"), DATES), "date", "left").join(scored, "app", "left")
    known = (F.col("history") > 0) & (F.col("norm2") > 1e-12) & F.col("num").isNotNull()
    similarity = F.when(known, F.col("num") / F.sqrt("norm2"))
    return out.select(
        "app", "date", F.col("history").alias("history_document_count"), F.col("unseen").alias("unseen_ngram_share"), similarity.alias("prior_centroid_similarity"),
        (F.lit(1.0) - similarity).alias("prior_centroid_novelty"), (F.col("history") == 0).cast("int").alias("history_cold_start_flag"),
    )


def _measures(metrics: list[str]) -> list:
    valid = F.col("abstract_length_chars") > 0
    out = []
    for m in metrics:
        v = F.when(valid, F.col(m))
        out += [F.avg(v).alias(f"{m}_mean"), F.median(v).alias(f"{m}_median"), F.percentile(v, 0.9).alias(f"{m}_p90")]
    return out


def text_by_quarter(rows: DataFrame, keys: list[str], metrics: list[str], min_group: int | None = None) -> DataFrame:
    """Counts, coverage and mean/median/p90 of each metric over non-empty texts, per group of ``keys``.

    Edges repeated for one application and group count once. With ``min_group`` a flag marks smaller groups.
    """
    unique = rows.dropDuplicates([*keys, "application_no"])
    out = unique.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patent_count"), F.count_if(F.col("abstract_length_chars") > 0).alias("valid_abstract_count"), *_measures(metrics)
    ).withColumn("abstract_coverage", F.try_divide("valid_abstract_count", "patent_count"))
    if min_group is not None:
        out = out.withColumn("low_sample_flag", (F.col("valid_abstract_count") < min_group).cast("int"))
    return out


def text_period_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """The same by reporting period, with the cold-start share and number of quarters."""
    keyed = rows.withColumn("period", period_of_year(F.year("application_date"))).where("period is not null")
    return keyed.groupBy("period").agg(
        F.count(F.lit(1)).alias("patent_count"), F.count_if(F.col("abstract_length_chars") > 0).alias("valid_abstract_count"), *_measures(metrics),
        F.avg(F.when(F.col("abstract_length_chars") > 0, F.col("history_cold_start_flag"))).alias("cold_start_share"), F.count_distinct("quarter").alias("quarter_count"),
    ).withColumn("abstract_coverage", F.try_divide("valid_abstract_count", "patent_count"))


def history_audit(rows: DataFrame) -> DataFrame:
    """One row: structural checks of scored texts.

    The history count of a date must be the number of valid texts of earlier dates, keys must be
    unique, scores within bounds.
    """
    daily = rows.groupBy("application_date").agg(F.count_if(F.col("abstract_length_chars") > 0).alias("n"), F.max("history_document_count").alias("h1"), F.min("history_document_count").alias("h0"))
    w = W.partitionBy(F.lit(1)).orderBy("application_date").rowsBetween(W.unboundedPreceding, -1)
    checked = daily.withColumn("want", F.coalesce(F.sum("n").over(w), F.lit(0)))
    history = checked.agg(F.count_if((F.col("h1") != F.col("want")) | (F.col("h0") != F.col("want"))).alias("history_mismatch_dates"), F.count(F.lit(1)).alias("date_count"))
    keys = rows.groupBy("application_no").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("application_count"), F.count_if(F.col("k") > 1).alias("duplicate_keys"))
    bounds = rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if((F.col("unseen_ngram_share") < 0) | (F.col("unseen_ngram_share") > 1)).alias("share_out_of_bounds"),
        F.count_if((F.col("prior_centroid_novelty") < -1e-9) | (F.col("prior_centroid_novelty") > 1 + 1e-9)).alias("novelty_out_of_bounds"),
        F.count_if(F.col("abstract_length_chars") > 0).alias("valid_count"), F.count_if(F.col("history_cold_start_flag") == 1).alias("cold_start_count"),
    )
    one = lambda df: df.select(F.struct("*")).scalar()
    both = bounds.withColumn("h", one(history)).withColumn("k", one(keys))
    return both.select(*bounds.columns, "h.*", "k.*")


def group_diagnostics(groups: DataFrame) -> DataFrame:
    """Per quarter: number of groups, share of small ones and applications, from the group table."""
    return groups.groupBy("quarter").agg(F.count_distinct("listed_parent").alias("group_count"), F.avg("low_sample_flag").alias("low_sample_share"), F.sum("patent_count").alias("group_patent_count"))


def quality_audit(scored: DataFrame, market: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: keys, baseline rows, history, ranges and coverage of scored texts and of both tables made from them.

    A date whose history is not one value counts as a mismatch once, one whose smallest differs from the
    number of valid texts before it once more.
    """
    baseline, valid = F.coalesce("baseline_eligible", F.lit(0)) == 1, F.col("abstract_length_chars") > 0
    daily = scored.groupBy("application_date").agg(
        F.count_if(valid).alias("n"), F.min("history_document_count").alias("h0"), F.max("history_document_count").alias("h1"), F.count_distinct("history_document_count").alias("k")
    )
    w = W.partitionBy(F.lit(1)).orderBy("application_date").rowsBetween(W.unboundedPreceding, -1)
    dates = daily.withColumn("want", F.coalesce(F.sum("n").over(w), F.lit(0))).agg(
        F.max("k").alias("same_day_history_max_unique_values"), F.sum((F.col("h0") != F.col("h1")).cast("bigint") + (F.col("h0") != F.col("want")).cast("bigint")).alias("pit_history_mismatch_dates")
    )
    rows = scored.agg(
        F.count(F.lit(1)).alias("metric_rows"), (F.count(F.lit(1)) - F.count_distinct("application_no")).alias("metric_duplicate_application_nos"),
        F.count_if(baseline & ~F.coalesce(F.col("patent_type_group").isin("invention", "utility_model"), F.lit(False))).alias("baseline_type_bad_rows"),
        F.count_if(baseline & ~F.coalesce(F.trim("relation").isin("上市公司本身", "上市公司的子公司"), F.lit(False))).alias("baseline_relation_bad_rows"),
        F.count_if(F.col("application_date_conflict") == 1).alias("application_date_conflict_rows"), F.count_if(valid).alias("abstract_valid_count"),
        F.try_divide(F.count_if(valid), F.count(F.lit(1))).alias("abstract_coverage_rate"),
        F.min("history_document_count").alias("history_count_min"), F.max("history_document_count").alias("history_count_max"),
        F.min("unseen_ngram_share").alias("unseen_ngram_min"), F.max("unseen_ngram_share").alias("unseen_ngram_max"),
        F.min("prior_centroid_novelty").alias("novelty_min"), F.max("prior_centroid_novelty").alias("novelty_max"),
    )
    want = F.try_divide("valid_abstract_count", "patent_count")
    quarters = market.agg(
        F.count(F.lit(1)).alias("market_quarter_rows"), (F.count(F.lit(1)) - F.count_distinct("quarter")).alias("market_duplicate_quarters"),
        F.count_if(F.col("valid_abstract_count") > F.col("patent_count")).alias("coverage_bad_quarters"), F.count_if(F.abs(F.col("abstract_coverage") - want) > 1e-12).alias("coverage_rate_mismatch_quarters"),
    )
    keyed = groups.agg(
        F.count(F.lit(1)).alias("group_rows"), (F.count(F.lit(1)) - F.count_distinct(F.struct("listed_parent", "quarter"))).alias("group_duplicate_keys"), F.avg("low_sample_flag").alias("group_low_sample_share_mean")
    )
    return rows.crossJoin(dates).crossJoin(quarters).crossJoin(keyed)
