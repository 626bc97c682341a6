"""Queries of the record, code, text and similarity stages over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, keys
from ..functions.dates import lenient_date, period_of_year, quarter_label, quarter_ordinal
from ..functions.text import words
from ..operators import audits, code_metrics, records, similarity, text_records
from ..operators.barrier import not_sent
from ..session import materialize, table
from . import reference_sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
TEXT_METRICS = ["prior_centroid_novelty", "unseen_ngram_share", "abstract_length_chars"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero removed, so that the order of summation does not show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a query and its SQL, of which the columns ``doubles`` are rounded."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            replace = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
            with_part, _, tail = sql.rpartition("\n#")
            SQL[f.__name__] = f"{'WITH ' + with_part if with_part else ''} SELECT * {'REPLACE (' + replace + ')' if replace else ''} FROM ({tail}) AS result"
        return run

    return register


# ---- stages shared by queries -------------------------------------------------------------------


def _records(spark, d):
    return records.normalize_records(table(spark, d, "raw_records"), "rec_id")


def _core_edges(spark, d):
    recs = _records(spark, d)
    return records.canonical_core(recs), records.firm_edges(recs)


def _universe(spark, d):
    core, edges = _core_edges(spark, d)
    return records.baseline_universe(core, edges)


def _code_edges(spark, d):
    return code_metrics.code_edges(_universe(spark, d), table(spark, d, "ipc_dictionary"))


def _events(spark, d):
    return code_metrics.pair_events(materialize(_code_edges(spark, d)))


# ---- scalar functions -----------------------------------------------------------------------------


@query(f"\n#SELECT stkcd_raw, {S.STOCK.format(c='stkcd_raw')} AS stkcd, count(*) AS n FROM raw_records GROUP BY ALL")
def stock_codes(spark, d):
    """Normalised stock codes by raw form."""
    return table(spark, d, "raw_records").groupBy("stkcd_raw", codes.stock_code(F.col("stkcd_raw")).alias("stkcd")).agg(F.count(F.lit(1)).alias("n"))


@query(f"\n#SELECT rec_id, {S.date('application_date')} AS application_date, {S.quarter(S.date('application_date'))} AS quarter, {S.date('publication_date')} AS publication_date FROM raw_records")
def dates_and_quarters(spark, d):
    """Dates under the lenient rule, and their quarter."""
    a = lenient_date(F.col("application_date"))
    return table(spark, d, "raw_records").select("rec_id", a.alias("application_date"), quarter_label(a).alias("quarter"), lenient_date(F.col("publication_date")).alias("publication_date"))


@query(
    """\n#SELECT patent_type, CASE WHEN trim(patent_type) IN ('发明申请', '发明授权', '发明公布') THEN 'invention' WHEN trim(patent_type) = '实用新型' THEN 'utility_model' WHEN trim(patent_type) = '外观设计' THEN 'design' ELSE 'other' END AS exact,
 CASE WHEN starts_with(trim(patent_type), '发明') THEN 'invention' WHEN trim(patent_type) = '实用新型' THEN 'utility_model' WHEN trim(patent_type) = '外观设计' THEN 'design' ELSE 'other' END AS by_prefix,
 count(*) FILTER (trim(relation) IN ('上市公司本身', '上市公司的子公司')) AS n_eligible, count(*) AS n FROM raw_records GROUP BY ALL"""
)
def type_labels(spark, d):
    """Types by exact label and by prefix, with eligible relations."""
    t = F.col("patent_type")
    return table(spark, d, "raw_records").groupBy("patent_type", codes.patent_type_group(t).alias("exact"), codes.patent_type_by_prefix(t).alias("by_prefix")).agg(
        F.sum(codes.eligible_relation(F.col("relation")).cast("bigint")).alias("n_eligible"), F.count(F.lit(1)).alias("n")
    )


@query(f"{S.tokens('tk', 'raw_records', 'rec_id', 'ipc_all_raw')}\n#SELECT rec_id, raw AS raw_ipc, code, sub AS subclass, status FROM tk GROUP BY ALL")
def code_tokens(spark, d):
    """Distinct tokens of every code field with their normal form."""
    return table(spark, d, "raw_records").select("rec_id", F.explode(codes.code_tokens(F.col("ipc_all_raw"))).alias("t")).select("rec_id", "t.*")


@query(
    """\n#SELECT ipc_code, CASE length(ipc_code) WHEN 1 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'subclass' ELSE CASE WHEN ends_with(ipc_code, '/00') THEN 'main_group' ELSE 'subgroup' END END AS level,
 CASE WHEN length(ipc_code) = 1 THEN NULL WHEN length(ipc_code) = 3 THEN left(ipc_code, 1) WHEN length(ipc_code) = 4 THEN left(ipc_code, 3) WHEN ends_with(ipc_code, '/00') THEN left(ipc_code, 4)
 ELSE split_part(ipc_code, '/', 1) || '/00' END AS parent, CASE WHEN contains(ipc_code, '/') THEN split_part(ipc_code, '/', 1) END AS main_group FROM ipc_dictionary"""
)
def hierarchy_parents(spark, d):
    """Level, parent and main group of every dictionary code."""
    c = F.col("ipc_code")
    return table(spark, d, "ipc_dictionary").select("ipc_code", codes.code_level(c).alias("level"), codes.parent_code(c).alias("parent"), codes.main_group(c).alias("main_group"))


@query(
    """\n#SELECT name_id, CASE WHEN k = '' THEN '' ELSE k || '||' END AS applicant_key FROM (SELECT name_id, regexp_replace(lower(coalesce(applicant, '')), '[^0-9a-z一-鿿]', '', 'g') AS k FROM applicant_names)"""
)
def applicant_keys(spark, d):
    """Applicant keys without an address."""
    return table(spark, d, "applicant_names").select("name_id", keys.applicant_key(F.col("applicant"), F.lit("")).alias("applicant_key"))


# ---- canonical stage ------------------------------------------------------------------------------


@query(
    f"{S.tokens('tk', 'rec', 'ord', 'ipc_all_raw').join([S.REC + ', ', ''])}, bad AS (SELECT ord, count(DISTINCT raw) AS n FROM tk WHERE status = 'unmatched' GROUP BY 1)\n#"
    "SELECT ord, 'missing_application_no' AS failure_type, 1::bigint AS count FROM rec WHERE application_no = '' UNION ALL SELECT ord, 'invalid_application_date', 1 FROM rec WHERE application_no <> '' AND application_date IS NULL"
    " UNION ALL SELECT rec.ord, 'unmatched_ipc_token', n FROM rec JOIN bad USING (ord) WHERE application_no <> ''"
)
def record_failures(spark, d):
    """Failures of the record stage."""
    return records.record_failures(_records(spark, d))


_CORE_COLUMNS = (
    "application_no, application_date, publication_date, grant_date, publication_no, grant_no, patent_type, patent_type_group, raw_ipc_values, ipc_subclasses, ipc_main_subclass, source_record_count,"
    " application_date_conflict, publication_date_conflict, grant_date_conflict, ipc_conflict_flag, metadata_conflict_flag"
)


@query(f"{S.CORE}\n#SELECT {_CORE_COLUMNS} FROM core")
def canonical_core(spark, d):
    """One row per application; the subclass array as text."""
    return records.canonical_core(_records(spark, d)).withColumn("ipc_subclasses", F.array_join("ipc_subclasses", "|"))


@query(f"{S.REC}, {S.EDGES}\n#SELECT * FROM edge")
def firm_edges(spark, d):
    """One row per firm and application."""
    return records.firm_edges(_records(spark, d))


@query(f"{S.UNIVERSE}\n#SELECT application_no, application_date, patent_type_group, raw_ipc_values, ipc_main_subclass, eligible_firm_count, all_firm_count FROM universe")
def baseline_universe(spark, d):
    """Applications in the universe."""
    return _universe(spark, d).select("application_no", "application_date", "patent_type_group", "raw_ipc_values", "ipc_main_subclass", "eligible_firm_count", "all_firm_count")


@query(
    f"{S.UNIVERSE}\n#SELECT * FROM (SELECT application_no, concat_ws(';', CASE WHEN eligible_firm_count = 0 THEN 'no_baseline_relation' WHEN application_no NOT IN (SELECT application_no FROM universe) THEN 'excluded_from_ipc_universe' END,"
    " CASE WHEN application_date IS NULL THEN 'invalid_application_date' END, CASE WHEN application_date_conflict = 1 THEN 'application_date_conflict' END) AS exclusion_reason FROM counted) WHERE exclusion_reason <> ''"
)
def exclusion_reasons(spark, d):
    """Why applications are left out."""
    return records.exclusion_reasons(*_core_edges(spark, d))


@query(f"{S.UNIVERSE}, {S.KINDS}\n#SELECT * FROM kinds")
def type_pivot(spark, d):
    """Eligible applications by quarter and type."""
    return records.type_counts(*_core_edges(spark, d))


@query(f"{S.REC}, {S.EDGES}\n#SELECT relation, count(*) AS n_edges FROM (SELECT unnest(string_split(relation_type, '; ')) AS relation FROM edge) WHERE relation <> '' GROUP BY 1")
def relation_counts(spark, d):
    """Edges per relation."""
    return records.relation_counts(records.firm_edges(_records(spark, d)))


# ---- codes ----------------------------------------------------------------------------------------


@query(f"{S.CODE_EDGES}\n#SELECT * FROM ce", ("fractional_weight",))
def code_edges(spark, d):
    """Fractional code edges of the universe."""
    return _code_edges(spark, d)


@query(f"{S.CODE_EDGES}\n#SELECT mapping_status, taxonomy_version, count(*) AS n_tokens, count(DISTINCT application_no) AS n_applications FROM (SELECT DISTINCT application_no, raw, mapping_status, taxonomy_version FROM mapped) GROUP BY ALL")
def mapping_status(spark, d):
    """Tokens by mapping status and scheme version."""
    m = code_metrics.token_mappings(_universe(spark, d), table(spark, d, "ipc_dictionary"))
    return m.groupBy("mapping_status", "taxonomy_version").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("application_no").alias("n_applications"))


@query(f"{S.MASS}\n#SELECT * FROM mass", ("mass",))
def code_mass(spark, d):
    """Code mass per quarter."""
    return code_metrics.code_mass(_code_edges(spark, d))


@query(f"{S.MASS}\n#SELECT quarter, unique_ipc_subclass_count, ipc_entropy, ipc_hhi, ipc_one_minus_hhi FROM ({S.diversity()})", ("ipc_entropy", "ipc_hhi", "ipc_one_minus_hhi"))
def quarterly_diversity(spark, d):
    """Entropy and concentration per quarter."""
    return code_metrics.diversity(code_metrics.code_mass(_code_edges(spark, d))).select("quarter", "unique_ipc_subclass_count", "ipc_entropy", "ipc_hhi", "ipc_one_minus_hhi")


@query(f"{S.MASS}\n#SELECT quarter, related_variety, unrelated_variety FROM ({S.diversity()})", ("related_variety", "unrelated_variety"))
def variety_decomposition(spark, d):
    """Related and unrelated variety per quarter."""
    return code_metrics.diversity(code_metrics.code_mass(_code_edges(spark, d))).select("quarter", "related_variety", "unrelated_variety")


@query(f"{S.PAIRS}\n#SELECT * FROM ev", ("smoothed_pair_probability", "pair_rarity", "technological_relatedness", "technological_distance"))
def code_pairs_pit(spark, d):
    """Pairs against the state before their date."""
    return _events(spark, d)


@query(
    f"""{S.PAIRS}, cc AS (SELECT ipc_subclass, count(*) AS n FROM ce GROUP BY 1), pc AS (SELECT ipc_a, ipc_b, count(*) AS n FROM prs GROUP BY ALL),
g AS (SELECT a.ipc_subclass AS ipc_a, b.ipc_subclass AS ipc_b, a.n AS n_a, b.n AS n_b, CASE WHEN a.ipc_subclass = b.ipc_subclass THEN a.n ELSE coalesce(pc.n, 0) END AS n_pair FROM cc a JOIN cc b ON a.ipc_subclass <= b.ipc_subclass
 LEFT JOIN pc ON pc.ipc_a = a.ipc_subclass AND pc.ipc_b = b.ipc_subclass), h AS (SELECT *, CASE WHEN ipc_a = ipc_b THEN 1.0 ELSE n_pair / sqrt(n_a::double * n_b::double) END AS relatedness FROM g)
\n#SELECT *, greatest(0.0, least(1.0, 1 - relatedness)) AS distance FROM h""",
    ("relatedness", "distance"),
)
def relatedness_matrix(spark, d):
    """Final relatedness of all pairs of codes seen."""
    return code_metrics.relatedness_matrix(materialize(_code_edges(spark, d)))


@query(f"{S.PAIRS}, {S.RAO}\n#SELECT * FROM rao", ("rao_stirling_diversity",))
def rao_stirling(spark, d):
    """Rao-Stirling diversity at quarter start."""
    return code_metrics.rao_stirling(materialize(_code_edges(spark, d)))


_RATIOS = (
    "average_patent_scope", "median_patent_scope", "pair_rarity_mean", "pair_rarity_pair_weighted_mean", "average_technological_distance", "median_technological_distance", "ipc_entropy", "ipc_hhi", "ipc_one_minus_hhi",
    "related_variety", "unrelated_variety", "rao_stirling_diversity", "design_patent_share", "ipc_coding_rate", "ipc_missing_rate", "multi_ipc_patent_share", "novel_patent_share", "novel_pair_share",
)


def _metrics(spark, d):
    recs = materialize(_records(spark, d))
    core, firm = materialize(records.canonical_core(recs)), materialize(records.firm_edges(recs))
    universe = materialize(records.baseline_universe(core, firm))
    edges = materialize(code_metrics.code_edges(universe, table(spark, d, "ipc_dictionary")))
    events = materialize(code_metrics.pair_events(edges))
    return materialize(code_metrics.quarterly_metrics(core, firm, universe, edges, events)), edges, events


@query(f"{S.METRICS}\n#SELECT * FROM metrics", _RATIOS)
def quarterly_metrics(spark, d):
    """The full quarterly row with gaps filled."""
    return _metrics(spark, d)[0]


_R4 = ["multi_ipc_patent_share_4q", "novel_patent_share_4q", "novel_pair_share_4q", "ipc_entropy_4q", "ipc_hhi_4q", "ipc_one_minus_hhi_4q"]
_W4 = "OVER (ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query(
    f"""{S.METRICS}, sh AS (SELECT {S.qlabel("left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1 + s")} AS quarter, ipc_subclass, mass FROM mass, (SELECT unnest([0, 1, 2, 3]) AS s)),
pm AS (SELECT quarter, ipc_subclass, {S.ordered_sum('list(mass ORDER BY mass)')} AS mass FROM sh GROUP BY ALL), pdv AS ({S.diversity(src='pm')}),
r AS (SELECT quarter, count(*) {_W4} AS k, {', '.join(f'sum({c}) {_W4} AS {c}_s' for c in [*code_metrics.ROLLING_SUMS, 'multi_ipc_patent_count', 'ipc_coded_patent_count'])} FROM metrics)
\n#SELECT quarter, {', '.join(f'CASE WHEN k = 4 THEN {c}_s::bigint END AS {c}_4q' for c in code_metrics.ROLLING_SUMS)}, CASE WHEN k = 4 THEN multi_ipc_patent_count_s / nullif(ipc_coded_patent_count_s, 0)::double END AS multi_ipc_patent_share_4q,
 CASE WHEN k = 4 THEN novel_patent_count_s / nullif(multi_ipc_patent_count_s, 0)::double END AS novel_patent_share_4q, CASE WHEN k = 4 THEN novel_ipc_pair_count_s / nullif(all_ipc_pair_count_s, 0)::double END AS novel_pair_share_4q,
 CASE WHEN k = 4 THEN ipc_entropy END AS ipc_entropy_4q, CASE WHEN k = 4 THEN ipc_hhi END AS ipc_hhi_4q, CASE WHEN k = 4 THEN ipc_one_minus_hhi END AS ipc_one_minus_hhi_4q FROM r LEFT JOIN pdv USING (quarter)""",
    tuple(_R4),
)
def rolling_4q(spark, d):
    """Four-quarter rolling metrics."""
    metrics, edges, _ = _metrics(spark, d)
    return code_metrics.rolling_4q(metrics, code_metrics.code_mass(edges))


_SUMMED = ["patent_count", "ipc_coding_rate", "ipc_entropy", "ipc_hhi", "novel_pair_share", "pair_rarity_mean", "rao_stirling_diversity"]
_PERIOD = "CASE " + " ".join(f"WHEN {{y}} BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in ((1994, 1999), (2000, 2009), (2010, 2019), (2020, 2026))) + " END"


@query(
    f"""{S.METRICS}, lg AS ({' UNION ALL '.join(f"SELECT quarter, '{c}' AS metric, {c}::double AS value FROM metrics" for c in _SUMMED)}), kp AS (SELECT *, {_PERIOD.format(y='left(quarter, 4)::int')} AS period FROM lg)
\n#SELECT period, metric, count(*) AS quarter_count, count(value) AS non_null_count, sum(value) AS sum, avg(value) AS mean, median(value) AS median, arg_min(value, quarter) FILTER (value IS NOT NULL) AS first,
 arg_max(value, quarter) FILTER (value IS NOT NULL) AS last, min(value) AS min, max(value) AS max FROM kp WHERE period IS NOT NULL GROUP BY ALL""",
    ("sum", "mean", "median", "first", "last", "min", "max"),
)
def period_summary(spark, d):
    """Seven quarterly metrics summarised by period; ``period_summary_full`` has all 21."""
    return code_metrics.period_summary(_metrics(spark, d)[0], _SUMMED)


@query(
    f"""{S.METRICS}, lg AS ({' UNION ALL '.join(f"SELECT quarter, '{c}' AS metric, {c}::double AS value FROM metrics" for c in code_metrics.PERIOD_METRICS)}), kp AS (SELECT *, {_PERIOD.format(y='left(quarter, 4)::int')} AS period FROM lg)
\n#SELECT period, metric, count(*) AS quarter_count, count(value) AS non_null_count, sum(value) AS sum, avg(value) AS mean, median(value) AS median, arg_min(value, quarter) FILTER (value IS NOT NULL) AS first,
 arg_max(value, quarter) FILTER (value IS NOT NULL) AS last, min(value) AS min, max(value) AS max FROM kp WHERE period IS NOT NULL GROUP BY ALL""",
    ("sum", "mean", "median", "first", "last", "min", "max"),
)
def period_summary_full(spark, d):
    """The 21 quarterly metrics summarised by period."""
    return code_metrics.period_summary(_metrics(spark, d)[0], code_metrics.PERIOD_METRICS)


@query(
    f"""{S.PAIRS}, fi AS (SELECT quarter, count(*) AS n FROM (SELECT pair_id, min(quarter) AS quarter FROM ev GROUP BY 1) GROUP BY 1), oc AS (SELECT quarter, count(*) AS n FROM ev GROUP BY 1)
\n#SELECT quarter, oc.n AS pair_occurrences, coalesce(fi.n, 0) AS new_pairs, (sum(oc.n) OVER (ORDER BY quarter))::bigint AS cumulative_occurrences, (sum(coalesce(fi.n, 0)) OVER (ORDER BY quarter))::bigint AS cumulative_pairs FROM oc LEFT JOIN fi USING (quarter)"""
)
def pair_history(spark, d):
    """Pairs seen so far, per quarter."""
    return code_metrics.pair_history(_events(spark, d))


@query(
    f"""{S.PAIRS}, yr AS (SELECT year(application_date) AS year, count(*) AS record_count FROM universe WHERE year(application_date) <= 1993 GROUP BY 1)
\n#SELECT year, record_count, (SELECT count(DISTINCT pair_id) FROM ev WHERE year(ev.application_date) <= yr.year) AS seen_pair_count, (SELECT count(*) FROM ev WHERE year(ev.application_date) <= yr.year) AS pair_occurrence_count FROM yr"""
)
def pre_sample_counts(spark, d):
    """Applications and pairs before the formal sample, per year."""
    universe = materialize(_universe(spark, d))
    edges = materialize(code_metrics.code_edges(universe, table(spark, d, "ipc_dictionary")))
    return code_metrics.pre_sample_counts(universe, materialize(code_metrics.pair_events(edges)))


@query(
    f"""{S.CORE}, a AS (SELECT year(application_date) AS year, count(*) AS ours FROM core WHERE application_date IS NOT NULL GROUP BY 1), b AS (SELECT year({S.date('grant_date')}) AS year, count(*) AS theirs FROM raw_records WHERE {S.date('grant_date')} IS NOT NULL GROUP BY 1)
\n#SELECT year, ours, theirs, ours - theirs AS difference, CASE WHEN ours IS NULL THEN 'missing_ours' WHEN theirs IS NULL THEN 'missing_theirs' WHEN ours = theirs THEN 'equal' WHEN ours > theirs THEN 'higher' ELSE 'lower' END AS status FROM a FULL JOIN b USING (year)"""
)
def annual_reconciliation(spark, d):
    """Applications per year against grants per year."""
    recs = _records(spark, d)
    core = records.canonical_core(recs)
    ours = core.where("application_date is not null").groupBy(F.year("application_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    theirs = recs.where("grant_date is not null").groupBy(F.year("grant_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return code_metrics.annual_reconciliation(ours, theirs)


_PANEL = f"""pl AS (SELECT year({S.date('grant_date')}) AS year, stkcd, count(*) AS n, count(*) FILTER (starts_with(trim(patent_type), '发明')) AS ni, count(*) FILTER (trim(patent_type) = '实用新型') AS nu,
 count(*) FILTER (trim(patent_type) = '外观设计') AS nd FROM raw_records WHERE {S.date('grant_date')} IS NOT NULL GROUP BY ALL),
py AS (SELECT year, sum(n)::bigint AS existing_panel_patent_count, sum(ni)::bigint AS existing_panel_invention_count, sum(nu)::bigint AS existing_panel_utility_model_count, sum(nd)::bigint AS existing_panel_design_count FROM pl GROUP BY 1),
dy AS (SELECT left(quarter, 4)::int AS year, {', '.join(f'sum({c})::bigint AS detail_{c}' for c in code_metrics.COMPARED)} FROM metrics GROUP BY 1)"""


@query(
    f"""{S.METRICS}, {_PANEL}\n#SELECT coalesce(dy.year, py.year) AS year, {', '.join(f'detail_{c}' for c in code_metrics.COMPARED)}, existing_panel_patent_count, existing_panel_invention_count,
 existing_panel_utility_model_count, existing_panel_design_count, detail_patent_count - existing_panel_patent_count AS detail_minus_existing_patent_count, 'directional_not_like_for_like' AS comparison_status
 FROM dy FULL JOIN py ON dy.year = py.year"""
)
def annual_comparison(spark, d):
    """Five yearly counts of the quarterly table beside a firm-year panel of grants made of the records."""
    granted = table(spark, d, "raw_records").withColumn("year", F.year(lenient_date(F.col("grant_date")))).where("year is not null")
    kind = codes.patent_type_by_prefix(F.col("patent_type"))
    panel = granted.groupBy("stkcd", "year").agg(
        F.count(F.lit(1)).alias("patents_independent_annual"),
        *[F.count_if(kind == k).alias(f"patents_{k}_independent_annual") for k in ("invention", "utility_model", "design")],
    )
    return code_metrics.annual_comparison(_metrics(spark, d)[0], panel)


@query(f"{S.tokens('tk', 'rec', 'ord', 'ipc_all_raw').join([S.REC + ', ', ''])}, bad AS (SELECT ord, count(DISTINCT raw) AS n FROM tk WHERE status = 'unmatched' GROUP BY 1)\n#"
    "SELECT * FROM (SELECT ord, 'missing_application_no' AS failure_type, 1::bigint AS count FROM rec WHERE application_no = '' UNION ALL SELECT ord, 'invalid_application_date', 1 FROM rec WHERE application_no <> '' AND application_date IS NULL"
    " UNION ALL SELECT rec.ord, 'unmatched_ipc_token', n FROM rec JOIN bad USING (ord) WHERE application_no <> '') ORDER BY ord, failure_type LIMIT 1000")
def failure_sample(spark, d):
    """The first thousand failures of the record stage in order of the records."""
    return records.first_rows(records.record_failures(_records(spark, d)), ["ord", "failure_type"], 1000)


@query(
    f"""{S.CODE_EDGES}, um AS (SELECT {S.quarter('application_date')} AS quarter, application_no, (pos - 1)::int AS pos, raw AS raw_ipc, mapping_status, row_number() OVER (PARTITION BY application_no, raw ORDER BY pos) AS k FROM mapped WHERE mapping_status = 'unmatched')
\n#SELECT quarter, application_no, raw_ipc, mapping_status FROM um WHERE k = 1 ORDER BY quarter, application_no, pos LIMIT 1000"""
)
def unmatched_sample(spark, d):
    """The first thousand tokens outside the taxonomy, by quarter, application and position."""
    return code_metrics.unmatched_sample(_universe(spark, d), table(spark, d, "ipc_dictionary"), 1000).drop("pos")


@query(
    f"""{S.CORE}\n#SELECT 'year' AS kind, year(application_date)::varchar AS part, count(*) AS n, count(publication_no) AS named FROM core WHERE application_date IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'quarter', coalesce({S.quarter('application_date')}, 'unknown'), count(*), count(publication_no) FROM core GROUP BY ALL UNION ALL SELECT 'csv', 'all', count(*), count(publication_no) FROM core"""
)
def written_and_read(spark, d):
    """Applications written by year, by quarter and as CSV, and read back: rows and publication numbers per part."""
    import uuid

    from ..session import shared_dir
    from ..sources import sinks

    base = f"{shared_dir(spark)}/lodestrata-sinks-{uuid.uuid4().hex}"
    core = materialize(records.canonical_core(_records(spark, d)).select("application_no", "application_date", "publication_no"))
    sinks.write_by_year(core, f"{base}/year")
    sinks.write_by_quarter(core.withColumn("quarter", quarter_label(F.col("application_date"))), f"{base}/quarter")
    sinks.write_csv(core, f"{base}/csv")
    named = [F.count(F.lit(1)).alias("n"), F.count("publication_no").alias("named")]
    years = sinks.read_known(spark, f"{base}/year").groupBy(F.lit("year").alias("kind"), F.col("application_year").cast("string").alias("part")).agg(*named)
    quarters = spark.read.parquet(f"{base}/quarter").groupBy(F.lit("quarter").alias("kind"), F.col("application_quarter").alias("part")).agg(*named)
    text = spark.read.option("header", True).csv(f"{base}/csv").groupBy(F.lit("csv").alias("kind"), F.lit("all").alias("part")).agg(*named)
    return years.unionAll(quarters).unionAll(text)


# ---- audits -------------------------------------------------------------------------------------


_OBS = f"""{S.tokens('oa', 'raw_records', 'rec_id', 'ipc_all_raw')}, {S.tokens('om', 'raw_records', 'rec_id', 'ipc_main_raw')}, ob0 AS (SELECT rec_id, raw, t1, c1, 0 AS is_main FROM oa_c UNION ALL SELECT rec_id, raw, t1, c1, 1 FROM om_c),
ob AS (SELECT rec_id, raw AS raw_code, c1 AS code, is_main FROM ob0)"""


@query(
    f"""{_OBS}, cn AS (SELECT code, count(*) AS occurrence_count, count(*) FILTER (is_main = 0) AS all_field_occurrences, count(*) FILTER (is_main = 1) AS main_field_occurrences FROM ob WHERE code IS NOT NULL GROUP BY 1),
vs AS (SELECT ipc_code AS code, bool_or(is_valid) FILTER (scheme_version = '2026.01') AS now, bool_or(is_valid) FILTER (scheme_version = '2025.01') AS then_, min(ipc_level) AS ipc_level FROM ipc_dictionary GROUP BY 1),
st AS (SELECT cn.*, ipc_level, CASE WHEN now THEN 'valid_in_2026' WHEN then_ THEN 'valid_in_2025_only' WHEN now IS NOT NULL THEN 'present_but_not_valid_in_2026' ELSE 'unmatched' END AS status,
 CASE WHEN now THEN '2026.01' WHEN then_ THEN '2025.01' WHEN now IS NOT NULL THEN '2026.01' END AS dictionary_version_used FROM cn LEFT JOIN vs USING (code))
\n#SELECT code AS ipc_code, occurrence_count, all_field_occurrences, main_field_occurrences, status, dictionary_version_used, CASE WHEN dictionary_version_used IS NOT NULL THEN ipc_level END AS ipc_level,
 CASE WHEN dictionary_version_used IS NULL OR length(code) = 1 THEN NULL WHEN length(code) = 3 THEN left(code, 1) WHEN length(code) = 4 THEN left(code, 3) WHEN ends_with(code, '/00') THEN left(code, 4) ELSE split_part(code, '/', 1) || '/00' END AS parent_code FROM st"""
)
def observed_code_status(spark, d):
    """Observed codes against the dictionary."""
    return audits.observed_status(audits.observed_codes(table(spark, d, "raw_records"), "rec_id", "ipc_all_raw", "ipc_main_raw"), table(spark, d, "ipc_dictionary"))


@query(f"{_OBS}\n#SELECT raw_code, count(*) AS occurrence_count FROM ob WHERE code IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def malformed_codes_top(spark, d):
    """The 100 most frequent malformed tokens."""
    return audits.top_malformed(audits.observed_codes(table(spark, d, "raw_records"), "rec_id", "ipc_all_raw", "ipc_main_raw"))


def _coverage(spark, d):
    recs = _records(spark, d)
    universe = records.baseline_universe(records.canonical_core(recs), records.firm_edges(recs))
    valid = table(spark, d, "ipc_dictionary").where("is_valid and ipc_level = 'subclass'").select(F.col("ipc_code").alias("s")).distinct()
    coded = universe.select("application_no", F.explode("ipc_subclasses").alias("s")).join(valid, "s", "left_semi").select("application_no").distinct().withColumn("has_ipc", F.lit(True))
    firms = table(spark, d, "firms").select("stkcd", "industry")
    held = records.firm_edges(recs).where("baseline_eligible = 1").join(firms, "stkcd", "left").groupBy("application_no").agg(
        audits.collapse(F.collect_set("industry")).alias("industry"), audits.collapse(F.collect_set("stkcd")).alias("firm"), audits.collapse(F.collect_set(F.nullif(F.col("applicant_type"), F.lit("")))).alias("applicant_type")
    )
    apps = universe.select("application_no", "application_date", "patent_type_group").join(coded, "application_no", "left").join(held, "application_no", "left")
    apps = apps.select(F.year("application_date").alias("year"), quarter_label(F.col("application_date")).alias("quarter"), "patent_type_group", "industry", "applicant_type", F.coalesce("has_ipc", F.lit(False)).alias("has_ipc"))
    return audits.coverage_by_dimension(apps, ["patent_type_group", "industry", "applicant_type"])


def _collapse_sql(c: str) -> str:
    return f"CASE WHEN count(DISTINCT {c}) = 0 THEN '__MISSING__' WHEN count(DISTINCT {c}) > 1 THEN '__MULTI__' ELSE min({c}) END"


_COVERAGE = f"""{S.UNIVERSE}, vsub AS (SELECT DISTINCT ipc_code FROM ipc_dictionary WHERE is_valid AND ipc_level = 'subclass'), cd AS (SELECT DISTINCT application_no FROM (SELECT application_no, unnest(string_split(ipc_subclasses, '|')) AS s FROM universe) WHERE s IN (SELECT ipc_code FROM vsub)),
held AS (SELECT application_no, {_collapse_sql('industry')} AS industry, {_collapse_sql("nullif(applicant_type, '')")} AS applicant_type FROM edge LEFT JOIN firms USING (stkcd) WHERE baseline_eligible = 1 GROUP BY 1),
ap AS (SELECT year(application_date) AS year, {S.quarter('application_date')} AS quarter, patent_type_group, coalesce(industry, '__MISSING__') AS industry, coalesce(applicant_type, '__MISSING__') AS applicant_type, application_no IN (SELECT application_no FROM cd) AS has_ipc
 FROM universe LEFT JOIN held USING (application_no)), cov0 AS ({' UNION ALL '.join(f"SELECT year, quarter, '{n}' AS dimension, {c} AS category, count(*) AS patent_count, count(*) FILTER (has_ipc) AS ipc_coded_patent_count FROM ap GROUP BY ALL" for n, c in (("overall", "'all'"), ("patent_type_group", "patent_type_group"), ("industry", "industry"), ("applicant_type", "applicant_type")))}),
cov AS (SELECT *, patent_count - ipc_coded_patent_count AS ipc_missing_patent_count, ipc_coded_patent_count / patent_count::double AS ipc_coding_rate, (patent_count - ipc_coded_patent_count) / patent_count::double AS ipc_missing_rate FROM cov0)"""


@query(f"{_COVERAGE}\n#SELECT * FROM cov", ("ipc_coding_rate", "ipc_missing_rate"))
def coverage_by_dimension(spark, d):
    """Coding coverage of the baseline universe by quarter and dimension; ``coverage_eligible_by_dimension`` has all eligible applications."""
    return _coverage(spark, d)


@query(
    f"""{_COVERAGE}, ann AS (SELECT year, dimension, category, sum(patent_count)::bigint AS patent_count, sum(ipc_coded_patent_count)::bigint AS ipc_coded_patent_count FROM cov GROUP BY ALL)
\n#SELECT *, patent_count - ipc_coded_patent_count AS ipc_missing_patent_count, ipc_coded_patent_count / patent_count::double AS ipc_coding_rate, (patent_count - ipc_coded_patent_count) / patent_count::double AS ipc_missing_rate FROM ann""",
    ("ipc_coding_rate", "ipc_missing_rate"),
)
def coverage_annual(spark, d):
    """Coding coverage of the baseline universe by year and dimension; ``coverage_eligible_annual`` has all eligible applications."""
    return audits.coverage_annual(_coverage(spark, d))


def _coverage_eligible(spark, d):
    core, edges = _core_edges(spark, d)
    industries = edges.where("baseline_eligible = 1").join(table(spark, d, "firms").select("stkcd", "industry"), "stkcd").select("application_no", "industry")
    return audits.coverage_by_dimension(audits.coverage_apps(core, edges, industries, table(spark, d, "ipc_dictionary")), audits.COVERAGE_DIMENSIONS)


_COVERAGE_ELIGIBLE = f"""{S.UNIVERSE}, el AS (SELECT * FROM counted WHERE eligible_firm_count > 0 AND application_date IS NOT NULL),
cd AS (SELECT DISTINCT application_no FROM (SELECT application_no, unnest(string_split(ipc_subclasses, '|')) AS s FROM el) WHERE s IN (SELECT ipc_code FROM ipc_dictionary WHERE is_valid AND ipc_level = 'subclass')),
held AS (SELECT application_no, {', '.join(f"{_collapse_sql(f'nullif(trim({c}), {chr(39) * 2})')} AS {c}" for c in audits.COVERAGE_DIMENSIONS[1:])} FROM edge LEFT JOIN firms USING (stkcd) WHERE baseline_eligible = 1 GROUP BY 1),
ap AS (SELECT year(application_date) AS year, {S.quarter('application_date')} AS quarter, patent_type_group, industry, relation, applicant_type, application_no IN (SELECT application_no FROM cd) AS has_ipc FROM el JOIN held USING (application_no)),
cov0 AS ({' UNION ALL '.join(f"SELECT year, quarter, '{n}' AS dimension, {c} AS category, count(*) AS patent_count, count(*) FILTER (has_ipc) AS ipc_coded_patent_count FROM ap GROUP BY ALL" for n, c in (("overall", "'all'"), *((x, x) for x in audits.COVERAGE_DIMENSIONS)))})"""
_COVERAGE_RATES = "patent_count - ipc_coded_patent_count AS ipc_missing_patent_count, ipc_coded_patent_count / patent_count::double AS ipc_coding_rate, (patent_count - ipc_coded_patent_count) / patent_count::double AS ipc_missing_rate"


@query(f"{_COVERAGE_ELIGIBLE}\n#SELECT *, {_COVERAGE_RATES} FROM cov0", ("ipc_coding_rate", "ipc_missing_rate"))
def coverage_eligible_by_dimension(spark, d):
    """Coding coverage of all dated applications of eligible firms, by quarter and dimension."""
    return _coverage_eligible(spark, d)


@query(
    f"""{_COVERAGE_ELIGIBLE}, ann AS (SELECT year, dimension, category, sum(patent_count)::bigint AS patent_count, sum(ipc_coded_patent_count)::bigint AS ipc_coded_patent_count FROM cov0 GROUP BY ALL)
\n#SELECT *, {_COVERAGE_RATES} FROM ann""",
    ("ipc_coding_rate", "ipc_missing_rate"),
)
def coverage_eligible_annual(spark, d):
    """Coding coverage of all dated applications of eligible firms, by year and dimension."""
    return audits.coverage_annual(_coverage_eligible(spark, d))


@query("\n#SELECT scheme_version, ipc_level, is_valid, count(*) AS n_codes FROM ipc_dictionary GROUP BY ALL")
def dictionary_summary(spark, d):
    """Dictionary entries by version, level and validity."""
    return audits.dictionary_summary(table(spark, d, "ipc_dictionary"))


@query("\n#SELECT scheme_version, ipc_code, count(*) AS n FROM ipc_dictionary GROUP BY ALL HAVING count(*) > 1")
def dictionary_duplicates(spark, d):
    """Keys of the dictionary held twice."""
    return audits.duplicate_keys(table(spark, d, "ipc_dictionary"), ["scheme_version", "ipc_code"])


# ---- text records -------------------------------------------------------------------------------


def _text(spark, d):
    return text_records.prepared(table(spark, d, "text_records"), "text_id")


@query(f"{S.TEXT}\n#SELECT * FROM tc")
def text_core(spark, d):
    """One text row per application."""
    return text_records.text_core(_text(spark, d))


@query(
    f"""{S.TEXT}, te AS (SELECT listed_parent, application_no, arg_min_null(relation_type, ord) AS relation_type, arg_min_null(applicant, ord) AS applicant, arg_min_null(abstract_clean, ord) AS abstract_clean, {S.joined('relation_type', ' | ')} AS relation_type_values,
 {S.joined('applicant', ' | ')} AS applicant_values FROM tr WHERE baseline_eligible = 1 GROUP BY ALL)
\n#SELECT te.listed_parent, application_no, application_date, quarter, te.relation_type, te.applicant, te.abstract_clean, te.relation_type_values, te.applicant_values, abstract_length_chars, abstract_version_count
 FROM te JOIN tc USING (application_no) WHERE application_date_conflict = 0"""
)
def text_firm_edges(spark, d):
    """Text edges of listed parents."""
    rows = _text(spark, d)
    return text_records.text_firm_edges(rows, text_records.text_core(rows)).select(
        "listed_parent", "application_no", "application_date", "quarter", "relation_type", "applicant", "abstract_clean", "relation_type_values", "applicant_values", "abstract_length_chars", "abstract_version_count"
    )


@query(
    f"""{S.TEXT}, cnt AS (SELECT application_no, applicant, count(*) AS n, min(ord) AS o FROM tr WHERE applicant <> '' GROUP BY ALL), md AS (SELECT application_no, applicant FROM (SELECT *, row_number() OVER (PARTITION BY application_no ORDER BY n DESC, length(applicant) DESC, o) AS r FROM cnt) WHERE r = 1),
lg AS (SELECT application_no, abstract_clean FROM (SELECT *, row_number() OVER (PARTITION BY application_no ORDER BY length(abstract_clean) DESC, ord) AS r FROM tr) WHERE r = 1),
dt AS (SELECT application_no, CASE WHEN min(application_date) = max(application_date) THEN min(application_date) END AS application_date, max(baseline_eligible) AS baseline_firm, count(*) AS source_record_count FROM tr GROUP BY 1)
\n#SELECT application_no, application_date, coalesce({S.quarter('application_date')}, 'unknown') AS application_quarter, abstract_clean, applicant, baseline_firm, source_record_count FROM dt LEFT JOIN md USING (application_no) LEFT JOIN lg USING (application_no)"""
)
def canonical_patents(spark, d):
    """Applications by the mode and longest rules."""
    return text_records.canonical_patents(_text(spark, d)).select("application_no", "application_date", "application_quarter", "abstract_clean", "applicant", "baseline_firm", "source_record_count")


def _docs(spark, d, meta=()):
    core = text_records.text_core(_text(spark, d), list(meta)).where("application_date is not null")
    return core, core.select(F.col("application_no").alias("app"), F.col("application_date").alias("date"), F.col("abstract_clean").alias("text"))


_GRAMS = f"""{S.TEXT}, dc AS (SELECT application_no AS app, application_date AS date, abstract_clean AS text FROM tc WHERE application_date IS NOT NULL),
gr AS ({' UNION ALL '.join(f'SELECT app, date, unnest(list_transform(range(1, length(text) - {n} + 2), lambda i: substring(text, i, {n}))) AS g FROM dc' for n in (2, 3, 4))}), tfq AS (SELECT app, date, g, count(*) AS tf FROM gr GROUP BY ALL)"""


@query(f"{_GRAMS}\n#SELECT app, count(*) AS distinct_grams, sum(tf)::bigint AS grams, max(tf) AS most FROM tfq GROUP BY 1")
def ngram_counts(spark, d):
    """Character n-grams per application."""
    tf = text_records.ngram_frequencies(_docs(spark, d)[1])
    return tf.groupBy("app").agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("tf").alias("grams"), F.max("tf").alias("most"))


_BODY = """ds AS (SELECT DISTINCT date FROM dc), nd AS (SELECT date, count(*) AS n FROM dc WHERE text <> '' GROUP BY 1), hs AS (SELECT ds.date, coalesce(sum(n) OVER (ORDER BY ds.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM ds LEFT JOIN nd USING (date)),
dg AS (SELECT g, date, count(*) AS n FROM tfq GROUP BY ALL), dfq AS (SELECT g, date, coalesce(sum(n) OVER (PARTITION BY g ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS df FROM dg),
wq AS (SELECT tfq.*, df, tf * (ln((h + 1)::double / (df + 1)) + 1) AS w FROM tfq JOIN dfq USING (g, date) JOIN hs USING (date)), uq AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY app)) AS u FROM wq),
sd AS (SELECT g, date, sum(u) AS dd FROM uq GROUP BY ALL), ss AS (SELECT g, date, dd, coalesce(sum(dd) OVER (PARTITION BY g ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sd),
ni AS (SELECT date, sum(2 * s * dd + dd * dd) AS inc FROM ss GROUP BY 1), nn AS (SELECT ds.date, coalesce(sum(inc) OVER (ORDER BY ds.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS norm2 FROM ds LEFT JOIN ni USING (date)),
sq AS (SELECT app, sum(u * s) AS num, sum(CASE WHEN df = 0 THEN tf ELSE 0 END) / sum(tf)::double AS unseen FROM uq JOIN ss USING (g, date) GROUP BY 1),
nov AS (SELECT app, date, h::bigint AS history_document_count, unseen AS unseen_ngram_share, CASE WHEN h > 0 AND norm2 > 1e-12 THEN num / sqrt(norm2) END AS prior_centroid_similarity,
 1 - CASE WHEN h > 0 AND norm2 > 1e-12 THEN num / sqrt(norm2) END AS prior_centroid_novelty, (h = 0)::int AS history_cold_start_flag FROM dc JOIN hs USING (date) JOIN nn USING (date) LEFT JOIN sq USING (app))"""
_NOVELTY = f"{_GRAMS}, {_BODY}"
_BUCKET = "('0x' || left(md5(g), 8))::ubigint % 65536"



@query(f"{_NOVELTY}\n#SELECT * FROM nov", ("unseen_ngram_share", "prior_centroid_similarity", "prior_centroid_novelty"))
def pit_text_exact(spark, d):
    """Novelty against earlier texts over exact n-grams."""
    return text_records.pit_novelty(materialize(_docs(spark, d)[1], remove_exchanged=True))


@query(
    f"{_GRAMS.replace('tfq AS (', 'gh AS (SELECT app, date, ' + _BUCKET + ' AS g FROM gr), tfq AS (').replace('FROM gr GROUP', 'FROM gh GROUP')}, {_BODY}\n#SELECT * FROM nov",
    ("unseen_ngram_share", "prior_centroid_similarity", "prior_centroid_novelty"),
)
def pit_text_hashed(spark, d):
    """Novelty against earlier texts over 65,536 hashed buckets."""
    return text_records.pit_novelty(materialize(_docs(spark, d)[1], remove_exchanged=True), buckets=65_536)


#: What the queries of scored texts read of an application.
_SCORED_COLUMNS = ["application_no", "application_date", "quarter", "patent_type_group", "relation", "abstract_length_chars", "application_date_conflict", "baseline_eligible"]


def _scored(spark, d, rounds=1):
    """Applications with their scores; the texts, most of the bytes, end with the scoring."""
    core = materialize(_docs(spark, d, ["relation"])[0].select(*_SCORED_COLUMNS, "abstract_clean"), remove_exchanged=True)
    docs = core.select(F.col("application_no").alias("app"), F.col("application_date").alias("date"), F.col("abstract_clean").alias("text"))
    scores = text_records.pit_novelty(docs, rounds=rounds).drop("date")
    return core.drop("abstract_clean").join(scores, F.col("application_no") == F.col("app")).drop("app")


_SCORED = f"{_NOVELTY}, scd AS (SELECT tc.*, nov.* EXCLUDE (app, date) FROM tc JOIN nov ON app = application_no)"
_AGG = ", ".join(f"avg({v}) AS {m}_mean, median({v}) AS {m}_median, quantile_cont({v}, 0.9) AS {m}_p90" for m in TEXT_METRICS for v in [f"CASE WHEN abstract_length_chars > 0 THEN {m}::double END"])
_AGG_NAMES = tuple(f"{m}_{a}" for m in TEXT_METRICS for a in ("mean", "median", "p90"))
_COUNTS = "count(*) AS patent_count, count(*) FILTER (abstract_length_chars > 0) AS valid_abstract_count"


@query(f"{_SCORED}\n#SELECT quarter, {_COUNTS}, {_AGG}, count(*) FILTER (abstract_length_chars > 0) / count(*)::double AS abstract_coverage FROM scd GROUP BY 1", (*_AGG_NAMES, "abstract_coverage"))
def text_market_quarter(spark, d):
    """Text metrics per quarter."""
    return text_records.text_by_quarter(_scored(spark, d), ["quarter"], TEXT_METRICS)


@query(
    f"""{_SCORED}, sedge AS (SELECT DISTINCT tr.listed_parent, tr.application_no FROM tr JOIN tc USING (application_no) WHERE tr.baseline_eligible = 1 AND application_date_conflict = 0),
sj AS (SELECT sedge.listed_parent, scd.* EXCLUDE (listed_parent) FROM sedge JOIN scd USING (application_no))
\n#SELECT listed_parent, quarter, {_COUNTS}, {_AGG}, count(*) FILTER (abstract_length_chars > 0) / count(*)::double AS abstract_coverage, (count(*) FILTER (abstract_length_chars > 0) < 10)::int AS low_sample_flag FROM sj GROUP BY ALL""",
    (*_AGG_NAMES, "abstract_coverage"),
)
def text_group_quarter(spark, d):
    """Text metrics per listed parent and quarter."""
    return _text_groups(spark, d, materialize(_scored(spark, d), remove_exchanged=True))


def _text_groups(spark, d, scored):
    # only the keys of the edges are used
    edges = _text(spark, d).where("baseline_eligible = 1").select("listed_parent", F.col("application_no").alias("a")).distinct()
    held = scored.where("application_date_conflict = 0").join(edges, F.col("application_no") == F.col("a"))
    return text_records.text_by_quarter(held, ["listed_parent", "quarter"], TEXT_METRICS, min_group=10)


@query(
    f"""{_SCORED}, sp AS (SELECT *, {_PERIOD.format(y='year(application_date)')} AS period FROM scd)
\n#SELECT period, {_COUNTS}, {_AGG}, avg(CASE WHEN abstract_length_chars > 0 THEN history_cold_start_flag END) AS cold_start_share, count(DISTINCT quarter) AS quarter_count, count(*) FILTER (abstract_length_chars > 0) / count(*)::double AS abstract_coverage
 FROM sp WHERE period IS NOT NULL GROUP BY 1""",
    (*_AGG_NAMES, "cold_start_share", "abstract_coverage"),
)
def text_period_summary(spark, d):
    """Text metrics per period."""
    return text_records.text_period_summary(_scored(spark, d, rounds=3), TEXT_METRICS)


@query(
    f"""{_SCORED}, dq AS (SELECT application_date, count(*) FILTER (abstract_length_chars > 0) AS n, max(history_document_count) AS h1, min(history_document_count) AS h0 FROM scd GROUP BY 1),
dw AS (SELECT *, coalesce(sum(n) OVER (ORDER BY application_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want FROM dq)
\n#SELECT (SELECT count(*) FROM scd) AS row_count, (SELECT count(*) FROM scd WHERE unseen_ngram_share < 0 OR unseen_ngram_share > 1) AS share_out_of_bounds, (SELECT count(*) FROM scd WHERE prior_centroid_novelty < -1e-9 OR prior_centroid_novelty > 1 + 1e-9) AS novelty_out_of_bounds,
 (SELECT count(*) FROM scd WHERE abstract_length_chars > 0) AS valid_count, (SELECT count(*) FROM scd WHERE history_cold_start_flag = 1) AS cold_start_count, (SELECT count(*) FROM dw WHERE h1 <> want OR h0 <> want) AS history_mismatch_dates,
 (SELECT count(*) FROM dw) AS date_count, (SELECT count(DISTINCT application_no) FROM scd) AS application_count, 0::bigint AS duplicate_keys"""
)
def pit_history_audit(spark, d):
    """Structural audit of scored texts."""
    return text_records.history_audit(materialize(_scored(spark, d), remove_exchanged=True))


_GROUPS = f"""{_SCORED}, sedge AS (SELECT DISTINCT tr.listed_parent, tr.application_no FROM tr JOIN tc USING (application_no) WHERE tr.baseline_eligible = 1 AND application_date_conflict = 0),
gq AS (SELECT sedge.listed_parent, quarter, count(*) AS patent_count, (count(*) FILTER (abstract_length_chars > 0) < 10)::int AS low_sample_flag FROM sedge JOIN scd USING (application_no) GROUP BY ALL)"""


@query(f"{_GROUPS}\n#SELECT quarter, count(DISTINCT listed_parent) AS group_count, avg(low_sample_flag) AS low_sample_share, sum(patent_count)::bigint AS group_patent_count FROM gq GROUP BY 1", ("low_sample_share",))
def text_group_diagnostics(spark, d):
    """Groups, share of small groups and applications per quarter."""
    return text_records.group_diagnostics(_text_groups(spark, d, materialize(_scored(spark, d), remove_exchanged=True)))


@query(
    f"""{_GROUPS}, dq AS (SELECT application_date, count(*) FILTER (abstract_length_chars > 0) AS n, max(history_document_count) AS h1, min(history_document_count) AS h0, count(DISTINCT history_document_count) AS k FROM scd GROUP BY 1),
dw AS (SELECT *, coalesce(sum(n) OVER (ORDER BY application_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want FROM dq),
mq AS (SELECT quarter, count(*) AS patent_count, count(*) FILTER (abstract_length_chars > 0) AS valid FROM scd GROUP BY 1),
a AS (SELECT count(*) AS metric_rows, count(*) - count(DISTINCT application_no) AS metric_duplicate_application_nos, count(*) FILTER (baseline_eligible = 1 AND patent_type_group NOT IN ('invention', 'utility_model')) AS baseline_type_bad_rows,
 count(*) FILTER (baseline_eligible = 1 AND coalesce(trim(relation), '') NOT IN ('上市公司本身', '上市公司的子公司')) AS baseline_relation_bad_rows, count(*) FILTER (application_date_conflict = 1) AS application_date_conflict_rows,
 count(*) FILTER (abstract_length_chars > 0) AS abstract_valid_count, count(*) FILTER (abstract_length_chars > 0) / count(*)::double AS abstract_coverage_rate, min(history_document_count) AS history_count_min, max(history_document_count) AS history_count_max,
 min(unseen_ngram_share) AS unseen_ngram_min, max(unseen_ngram_share) AS unseen_ngram_max, min(prior_centroid_novelty) AS novelty_min, max(prior_centroid_novelty) AS novelty_max FROM scd),
b AS (SELECT max(k) AS same_day_history_max_unique_values, sum((h0 <> h1)::int + (h0 <> want)::int)::bigint AS pit_history_mismatch_dates FROM dw),
c AS (SELECT count(*) AS market_quarter_rows, count(*) - count(DISTINCT quarter) AS market_duplicate_quarters, count(*) FILTER (valid > patent_count) AS coverage_bad_quarters, 0::bigint AS coverage_rate_mismatch_quarters FROM mq),
e AS (SELECT count(*) AS group_rows, count(*) - count(DISTINCT (listed_parent, quarter)) AS group_duplicate_keys, avg(low_sample_flag) AS group_low_sample_share_mean FROM gq)
\n#SELECT * FROM a, b, c, e""",
    ("abstract_coverage_rate", "unseen_ngram_min", "unseen_ngram_max", "novelty_min", "novelty_max", "group_low_sample_share_mean"),
)
def text_quality_audit(spark, d):
    """The 22 structural, history and range checks of the text outputs."""
    scored = materialize(_scored(spark, d), remove_exchanged=True)
    market = materialize(text_records.text_by_quarter(scored, ["quarter"], TEXT_METRICS), remove_exchanged=True)
    return text_records.quality_audit(scored, market, materialize(_text_groups(spark, d, scored), remove_exchanged=True))


# ---- similarity ---------------------------------------------------------------------------------


def _similarity_docs(spark, d):
    recs = _records(spark, d)
    core = records.canonical_core(recs)
    granted = core.where((codes.granted_invention(F.col("patent_type_group"), F.col("grant_no"), F.col("grant_date")) == 1) & F.col("application_date").isNotNull())
    granted = granted.select("application_no", quarter_ordinal(F.col("application_date")).alias("q"), F.coalesce("ipc_main_subclass", F.lit("")).alias("field"))
    texts = text_records.text_core(_text(spark, d)).select(F.col("application_no").alias("a"), "abstract_clean", keys.applicant_key(F.col("applicant"), F.lit("")).alias("applicant"), "baseline_eligible")
    docs = granted.join(not_sent(texts), F.col("application_no") == F.col("a")).select(F.col("application_no").alias("app"), "q", "field", "applicant", words(F.col("abstract_clean")).alias("tokens"), "baseline_eligible")
    counts = granted.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return materialize(docs.where(F.size("tokens") > 0)), counts


_SIM = f"""{S.CORE}, {S.TEXT}, gt AS (SELECT application_no, {S.qord('application_date')} AS q, coalesce(ipc_main_subclass, '') AS field FROM core WHERE patent_type_group = 'invention' AND (coalesce(grant_no, '') <> '' OR grant_date IS NOT NULL) AND application_date IS NOT NULL),
gc AS (SELECT q, count(*) AS n FROM gt GROUP BY 1), kd0 AS (SELECT gt.application_no AS app, q, field, regexp_replace(lower(coalesce(applicant, '')), '[^0-9a-z一-鿿]', '', 'g') AS ak, regexp_extract_all(lower(abstract_clean), '[a-z0-9+#.-]+|[一-鿿]{{2}}') AS tokens, baseline_eligible FROM gt JOIN tc USING (application_no)),
kd AS (SELECT app, q, field, CASE WHEN ak = '' THEN '' ELSE ak || '||' END AS applicant, tokens, baseline_eligible FROM kd0 WHERE len(tokens) > 0),
kt AS (SELECT app, q, word, count(*) / any_value(sz)::double AS tf FROM (SELECT app, q, len(tokens) AS sz, unnest(tokens) AS word FROM kd) GROUP BY ALL),
kf AS (SELECT word, q, coalesce(sum(count(*)) OVER (PARTITION BY word ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS df FROM kt GROUP BY word, q),
kn AS (SELECT q, coalesce(sum(count(*)) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM kd GROUP BY q),
kw AS (SELECT * FROM (SELECT app, kt.q, word, tf * CASE WHEN n > 0 THEN ln(n / (df + 1)::double) END AS w FROM kt JOIN kf USING (word, q) JOIN kn ON kn.q = kt.q) WHERE w IS NOT NULL AND w <> 0),
kv AS (SELECT app, q, word, w / sqrt(sum(w * w) OVER (PARTITION BY app)) AS x FROM kw)"""


@query(f"{_SIM}\n#SELECT app, q, count(*) AS n_words, sum(x) AS sum_x, max(x) AS max_x FROM kv GROUP BY ALL", ("sum_x", "max_x"))
def similarity_vectors(spark, d):
    """Word vectors, summarised per document."""
    return similarity.word_vectors(_similarity_docs(spark, d)[0]).groupBy("app", "q").agg(F.count(F.lit(1)).alias("n_words"), F.sum("x").alias("sum_x"), F.max("x").alias("max_x"))


def _similarity(spark, d):
    docs, granted = _similarity_docs(spark, d)
    return docs, similarity.field_adjusted(materialize(similarity.scores(docs, granted)))


_SIMS = f"""{_SIM}, kx AS (SELECT kv.*, nullif(field, '') AS field, nullif(applicant, '') AS applicant FROM kv JOIN kd USING (app)),
s1 AS (SELECT field, word, q, sum(x) AS s FROM kx WHERE field IS NOT NULL GROUP BY ALL), s2 AS (SELECT applicant, field, word, q, sum(x) AS s FROM kx WHERE field IS NOT NULL AND applicant IS NOT NULL GROUP BY ALL),
s3 AS (SELECT word, q, sum(x) AS s FROM kx GROUP BY ALL), s4 AS (SELECT applicant, word, q, sum(x) AS s FROM kx WHERE applicant IS NOT NULL GROUP BY ALL),
w1 AS (SELECT field, word, q, sum(s) OVER (PARTITION BY field, word ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS s FROM s1), w2 AS (SELECT applicant, field, word, q, sum(s) OVER (PARTITION BY applicant, field, word ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS s FROM s2),
w3 AS (SELECT word, q, sum(s) OVER (PARTITION BY word ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS s FROM s3), w4 AS (SELECT applicant, word, q, sum(s) OVER (PARTITION BY applicant, word ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS s FROM s4),
sb AS (SELECT app, sum(x * (coalesce(w1.s, 0) - coalesce(w2.s, 0))) AS b, sum(x * (coalesce(w3.s, 0) - coalesce(w4.s, 0))) AS f FROM kx LEFT JOIN w1 ON w1.field = kx.field AND w1.word = kx.word AND w1.q = kx.q
 LEFT JOIN w2 ON w2.applicant = kx.applicant AND w2.field = kx.field AND w2.word = kx.word AND w2.q = kx.q LEFT JOIN w3 ON w3.word = kx.word AND w3.q = kx.q LEFT JOIN w4 ON w4.applicant = kx.applicant AND w4.word = kx.word AND w4.q = kx.q GROUP BY 1),
sp AS (SELECT min(q) AS q0, max(q) AS q1 FROM kd), kc AS (SELECT unnest(range(q0, q1 + 1)) AS q, q0, q1 FROM sp), kg AS (SELECT kc.*, coalesce(n, 0) AS n FROM kc LEFT JOIN gc USING (q)),
kb AS (SELECT q, sum(n) OVER (ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS nb, sum(n) OVER (ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS nf, (q - 8 >= q0 AND q + 8 <= q1)::int AS window_complete FROM kg),
sr AS (SELECT app, kd.q, nullif(field, '') AS field, nullif(applicant, '') AS applicant, CASE WHEN field <> '' AND nb > 0 THEN CASE WHEN abs(coalesce(b, 0)) < 1e-12 THEN 0 ELSE b END / nb END AS bs,
 CASE WHEN nf > 0 THEN CASE WHEN abs(coalesce(f, 0)) < 1e-12 THEN 0 ELSE f END / nf END AS fs, window_complete FROM kd LEFT JOIN sb USING (app) LEFT JOIN kb ON kb.q = kd.q),
sa AS (SELECT *, count(*) OVER (PARTITION BY q)::double / count(*) OVER (PARTITION BY q, field) * (sum(bs) OVER (PARTITION BY q, field) / nullif(sum(bs) OVER (PARTITION BY q), 0)) AS field_adjustment FROM sr),
sf AS (SELECT *, field_adjustment * fs / nullif(bs, 0) AS quality FROM sa)"""


@query(f"{_SIMS}\n#SELECT app, q, field, applicant, round(bs, 9) AS bs, round(fs, 9) AS fs, window_complete, field_adjustment, quality FROM sf", ("bs", "fs", "field_adjustment", "quality"))
def similarity_quality(spark, d):
    """BS, FS, field adjustment and quality per document."""
    return _similarity(spark, d)[1]


@query(
    f"""{_SIMS}, fs0 AS (SELECT sf.* FROM sf JOIN kd USING (app) WHERE baseline_eligible = 1) \n#SELECT {S.qlabel('q')} AS quarter, count(DISTINCT app) AS patent_count, avg(quality) AS quality_mean, median(quality) AS quality_median, avg(bs) AS bs_mean, avg(fs) AS fs_mean FROM fs0 GROUP BY q""",
    ("quality_mean", "quality_median", "bs_mean", "fs_mean"),
)
def similarity_market(spark, d):
    """Quality of baseline documents per quarter."""
    from ..functions.dates import ordinal_label

    docs, scored = _similarity(spark, d)
    base = scored.join(not_sent(docs.where("baseline_eligible = 1").select("app")), "app", "left_semi")
    return similarity.quality_summary(base, ["q"]).select(ordinal_label(F.col("q")).alias("quarter"), "patent_count", "quality_mean", "quality_median", "bs_mean", "fs_mean")


@query(
    f"""{_SIMS}, {S.EDGES.replace('edge AS', 'fedge AS')} \n#SELECT stkcd AS listed_parent, {S.qlabel('q')} AS quarter, count(DISTINCT app) AS patent_count, avg(quality) AS quality_mean, median(quality) AS quality_median, avg(bs) AS bs_mean, avg(fs) AS fs_mean
 FROM sf JOIN fedge ON fedge.application_no = app WHERE fedge.baseline_eligible = 1 GROUP BY stkcd, q""",
    ("quality_mean", "quality_median", "bs_mean", "fs_mean"),
)
def similarity_firm(spark, d):
    """Quality per listed firm and quarter."""
    from ..functions.dates import ordinal_label

    _, scored = _similarity(spark, d)
    edges = records.firm_edges(_records(spark, d)).where("baseline_eligible = 1").select("listed_parent", F.col("application_no").alias("app"))
    return similarity.quality_summary(scored.join(not_sent(edges), "app"), ["listed_parent", "q"]).select("listed_parent", ordinal_label(F.col("q")).alias("quarter"), "patent_count", "quality_mean", "quality_median", "bs_mean", "fs_mean")


# ---- remaining counts, sources and streams ----------------------------------------------------------


@query(
    f"{S.CORE}\n#SELECT {S.quarter('application_date')} AS quarter, count(*) AS granted_count FROM core WHERE patent_type_group = 'invention' AND (coalesce(grant_no, '') <> '' OR grant_date IS NOT NULL) AND application_date IS NOT NULL GROUP BY 1"
)
def granted_counts(spark, d):
    """Granted inventions per quarter."""
    core = records.canonical_core(_records(spark, d)).where("application_date is not null")
    granted = core.where(codes.granted_invention(F.col("patent_type_group"), F.col("grant_no"), F.col("grant_date")) == 1)
    return granted.groupBy(quarter_label(F.col("application_date")).alias("quarter")).agg(F.count(F.lit(1)).alias("granted_count"))


@query(
    f"{S.PAIRS}\n#SELECT year(application_date) AS year, count(DISTINCT application_no) AS n_applications, count(*) AS n_pairs, sum(historical_first)::bigint AS n_first, max(historical_total_pair_count) AS max_history FROM ev GROUP BY 1"
)
def yearly_history(spark, d):
    """Pair history by year: sums and maxima."""
    return _events(spark, d).groupBy(F.year("application_date").alias("year")).agg(
        F.count_distinct("application_no").alias("n_applications"), F.count(F.lit(1)).alias("n_pairs"), F.sum("historical_first").alias("n_first"), F.max("historical_total_pair_count").alias("max_history")
    )


@query(f"{S.CORE}\n#SELECT source_record_count, count(*) AS n_applications, sum(application_date_conflict)::bigint AS n_date_conflicts, sum(ipc_conflict_flag)::bigint AS n_code_conflicts, sum(metadata_conflict_flag)::bigint AS n_metadata_conflicts FROM core GROUP BY 1")
def deduplication_audit(spark, d):
    """Applications by their number of source records, with conflicts."""
    core = records.canonical_core(_records(spark, d))
    return core.groupBy("source_record_count").agg(
        F.count(F.lit(1)).alias("n_applications"), F.sum("application_date_conflict").alias("n_date_conflicts"), F.sum("ipc_conflict_flag").alias("n_code_conflicts"), F.sum("metadata_conflict_flag").alias("n_metadata_conflicts")
    )


@query(
    f"{S.TEXT}\n#SELECT {_PERIOD.format(y='year(application_date)')} AS period, count(*) AS n_applications, count(*) FILTER (abstract_conflict_flag = 1) AS n_conflicts, max(abstract_version_count) AS most_versions FROM tc WHERE application_date IS NOT NULL GROUP BY 1"
)
def text_version_periods(spark, d):
    """Text versions by period; null where no period holds the year."""
    core = text_records.text_core(_text(spark, d)).where("application_date is not null")
    return core.groupBy(period_of_year(F.year("application_date")).alias("period")).agg(
        F.count(F.lit(1)).alias("n_applications"), F.count_if(F.col("abstract_conflict_flag") == 1).alias("n_conflicts"), F.max("abstract_version_count").alias("most_versions")
    )


_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    f"""{S.mapped_characters('kc', 'text_records', 'text_id', 'abstract_clean', S.compatibility_forms())}
\n#SELECT text_id, trim(regexp_replace(regexp_replace(coalesce(v, ''), '\\p{{C}}', ' ', 'g'), '{_BLANKS}', ' ', 'g')) AS abstract FROM text_records LEFT JOIN kc ON id = text_id"""
)
def clean_texts(spark, d):
    """Texts in NFKC form without control characters."""
    from ..functions.text import clean_text

    return table(spark, d, "text_records").select("text_id", clean_text(F.col("abstract_clean")).alias("abstract"))


@query(
    r"""\n#SELECT ipc_code, ipc_level, is_valid, scheme_version, CASE WHEN contains(ipc_code, '/') THEN split_part(ipc_code, '/', 1) || '/00' END AS main_group_code,
 CASE WHEN ipc_level = 'main_group' THEN 'listed ' || ipc_code ELSE ipc_code END AS title_en, CASE WHEN ipc_level = 'subclass' THEN '首题' || ipc_code END AS title_zh,
 CASE WHEN ipc_level = 'subclass' THEN 'matched' ELSE 'missing_source' END AS title_zh_status, 'scheme.zip' AS source_en, CASE WHEN ipc_level = 'subclass' THEN 'a.txt' END AS source_zh,
 ipc_code AS source_symbol, ipc_level AS source_kind, ipc_code AS code, ipc_level AS level, true AS hashed FROM ipc_dictionary WHERE scheme_version = '2026.01'""".replace("\\n#", "\n#")
)
def dictionary_from_sources(spark, d):
    """The current dictionary written as an XML scheme and symbol list in ZIP files, and read back and merged.

    The dictionary is a fixed few thousand codes, so its files are made on the driver.
    """
    import io
    import uuid
    import zipfile

    from pyarrow import fs

    from ..session import shared_dir
    from ..sources.dictionary import read_dictionary_source

    rows = table(spark, d, "ipc_dictionary").where(F.col("scheme_version") == audits.CURRENT).select("ipc_code", "ipc_level", "is_valid").collect()
    # main groups have no title in the scheme, the list titles them and every subclass; subclasses have two Chinese titles
    items = "".join(f'<classification-item level="{r[1]}" symbol="{r[0]}"><title lang="en">{"" if r[1] == "main_group" else r[0]}</title></classification-item>' for r in rows)
    listed = "".join(f"{r[0]}\t{word} {r[0]}\n" for word in ("early", "listed") for r in rows if r[1] in ("main_group", "subclass"))
    chinese = {part: "".join(f"{r[0]}  {word}{r[0]}\n" for r in rows if r[1] == "subclass") for part, word in (("a", "首题"), ("b", "另一个题目"))}
    symbols = "".join(f'<IPCSymbol symbol="{r[0]}"/>' for r in rows if r[2])
    base = f"{shared_dir(spark)}/lodestrata-sources-{uuid.uuid4().hex}"
    system, inner = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
    for kind, name, body in (("scheme", "EN_ipc_scheme_x.xml", f"<c>{items}</c>"), ("valid_symbols", "valid_symbols.xml", f"<c>{symbols}</c>"), ("title_list", "titles.txt", listed)):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, body)
        system.create_dir(f"{inner}/{kind}", recursive=True)
        with system.open_output_stream(f"{inner}/{kind}/{kind}.zip") as out:
            out.write(buffer.getvalue())
    for part, body in chinese.items():
        system.create_dir(f"{inner}/wrapped_text", recursive=True)
        with system.open_output_stream(f"{inner}/wrapped_text/{part}.txt") as out:
            out.write(body.encode())
    read = lambda kind: read_dictionary_source(spark, f"{base}/{kind}", kind)
    merged = audits.merge_dictionary(read("scheme"), read("valid_symbols"), read("title_list"), read("wrapped_text"), audits.CURRENT)
    return merged.select(
        "ipc_code", "ipc_level", "is_valid", "scheme_version", "main_group_code", "title_en", "title_zh", "title_zh_status", "source_en", "source_zh", "source_symbol", "source_kind", "code", "level",
        (F.length("source_sha256_en") == 64).alias("hashed"),
    )


@query("\n#SELECT event_type, ts::date AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    """Daily counts per event type, computed by a stream run to its end."""
    import uuid

    from ..session import shared_dir
    from ..streaming.ingest import windowed_counts

    name = f"lodestrata_{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d, "events"))
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    run = windowed_counts(source, "ts", "event_type").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", F.to_date("window_start").alias("day"), "n")


def _stream_folder(spark, d: str, name: str) -> str:
    """A folder holding the table: the table itself if it is a folder, else a copy, as streams read folders."""
    import os
    import uuid

    from ..session import shared_dir

    path = f"{d}/{name}.parquet"
    if os.path.isdir(path):
        return path
    copy = f"{shared_dir(spark)}/lodestrata-stream-{uuid.uuid4().hex}"
    table(spark, d, name).write.parquet(copy)
    return copy
