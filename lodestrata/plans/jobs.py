"""Jobs from files to files: code metrics, text metrics, similarity, dictionary and audits.

``python -m lodestrata.plans.jobs codes|coverage|text|similarity|dictionary|audit --config FILE``
"""

from __future__ import annotations

import argparse
import json
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..functions import codes, keys
from ..functions.dates import lenient_date, ordinal_label, quarter_label, quarter_ordinal
from ..functions.text import clean_text, combine_text, words
from ..operators import audits, code_metrics, records, similarity, text_records
from ..operators.parse_lines import POSITIONS
from ..session import build_session, drop_materialized, read_bytes, ship_package
from ..sources import dictionary as dict_sources
from ..sources import sinks
from ..sources.logical_csv import read_logical


def fields_of(logical: DataFrame) -> DataFrame:
    """Named string columns of logical records, ``ord`` being their place; a missing position is empty."""
    get = lambda i: F.trim(F.coalesce(F.get("fields", F.lit(i)), F.lit("")))
    return logical.select(F.col("byte_offset").alias("ord"), F.size("fields").alias("n_fields"), *[get(i).alias(n) for i, n in POSITIONS.items()])


def _done(spark: SparkSession, config: Config, stage: str, mark: dict) -> bool:
    """Whether a stage has finished over the same input; its mark lies beside its output, on whatever file system."""
    body = read_bytes(spark, f"{config.output}/{stage}.json")
    return body is not None and json.loads(body).get("fingerprint") == _plain(mark)


def _plain(mark: dict) -> dict:
    return {k: v if isinstance(v, int | str) or v is None else str(v) for k, v in mark.items()}


def run_codes(spark: SparkSession, config: Config) -> dict:
    """Records to quarterly code metrics; finished stages over the same input are not run again."""
    out, mark = config.output, sinks.fingerprint(spark, config.input)
    if not _done(spark, config, "01_records", mark):
        raw = fields_of(read_logical(spark, config.input, "prefix"))
        good = raw.where("n_fields = 31")
        recs = records.normalize_records(good, "ord")
        sinks.write_parquet(recs.where("application_no <> ''"), f"{out}/records")
        rejected = raw.where("n_fields <> 31").select("ord", F.lit("field_count").alias("failure_type"), F.col("n_fields").cast("bigint").alias("count"))
        sinks.write_parquet(rejected.unionByName(records.record_failures(recs)), f"{out}/failures")
        sinks.write_parquet(records.first_rows(spark.read.parquet(f"{out}/failures"), ["ord", "failure_type"]), f"{out}/failure_sample")
        sinks.write_json(spark, f"{out}/01_records.json", {"fingerprint": _plain(mark), "records": spark.read.parquet(f"{out}/records").count()})
    recs = spark.read.parquet(f"{out}/records")
    if not _done(spark, config, "02_canonical", mark):
        sinks.write_by_year(records.canonical_core(recs), f"{out}/patent_core")
        edges = records.firm_edges(recs)
        core = spark.read.parquet(f"{out}/patent_core")
        sinks.write_by_year(edges.join(core.select("application_no", "application_date"), "application_no", "left"), f"{out}/patent_firm_edge")
        edges = spark.read.parquet(f"{out}/patent_firm_edge")
        sinks.write_by_year(records.baseline_universe(core, edges), f"{out}/patent_universe")
        sinks.write_parquet(records.exclusion_reasons(core, edges), f"{out}/excluded")
        sinks.write_json(spark, f"{out}/02_canonical.json", {"fingerprint": _plain(mark)})
    core, edges, universe = (spark.read.parquet(f"{out}/{t}") for t in ("patent_core", "patent_firm_edge", "patent_universe"))
    dictionary = dict_sources.read_dictionary(spark, config.dictionary) if config.dictionary else None
    sinks.write_by_quarter(code_metrics.code_edges(universe, dictionary), f"{out}/patent_ipc_edge")
    code_edges = spark.read.parquet(f"{out}/patent_ipc_edge")
    sinks.write_parquet(code_metrics.unmatched_sample(universe, dictionary), f"{out}/unmatched_sample")
    sinks.write_by_quarter(code_metrics.pair_events(code_edges, config.alpha, config.taxonomy_size), f"{out}/patent_ipc_pair")
    events = spark.read.parquet(f"{out}/patent_ipc_pair")
    metrics = code_metrics.quarterly_metrics(core, edges, universe, code_edges, events, config.history_start)
    sinks.write_parquet(metrics, f"{out}/quarterly_base")
    metrics = spark.read.parquet(f"{out}/quarterly_base")
    full = metrics.join(code_metrics.rolling_4q(metrics, code_metrics.code_mass(code_edges)), "quarter")
    sinks.write_parquet(full, f"{out}/quarterly_metrics")
    formal = spark.read.parquet(f"{out}/quarterly_metrics").where(F.col("quarter") >= config.formal_start)
    sinks.write_csv(formal.coalesce(1).orderBy("quarter"), f"{out}/quarterly_metrics_csv")
    sinks.write_parquet(code_metrics.relatedness_matrix(code_edges), f"{out}/relatedness_matrix")
    measured = ["patent_count", "ipc_coding_rate", "ipc_entropy", "ipc_hhi", "novel_pair_share", "rao_stirling_diversity"]
    summary = code_metrics.period_summary(formal, code_metrics.PERIOD_METRICS)
    sinks.write_parquet(summary, f"{out}/period_summary")
    sinks.write_parquet(code_metrics.pair_history(events), f"{out}/pair_history")
    if config.annual_panel:
        panel = spark.read.parquet(config.annual_panel)
        reconciled = code_metrics.annual_comparison(spark.read.parquet(f"{out}/quarterly_metrics"), panel)
        sinks.write_parquet(reconciled, f"{out}/annual_reconciliation")
        sinks.write_csv(reconciled.coalesce(1).orderBy("year"), f"{out}/annual_reconciliation_csv")
    early = code_metrics.pre_sample_counts(universe, events).orderBy("year").collect()
    facts = {
        "applications": core.count(), "universe": universe.count(), "pairs": events.count(), "settings": config.as_dict(),
        "pre_sample_record_count": sum(r.record_count for r in early), "pre_sample_year_counts": {str(r.year): r.record_count for r in early},
        "pre_sample_seen_pair_count": early[-1].seen_pair_count if early else 0, "pre_sample_pair_occurrence_count": early[-1].pair_occurrence_count if early else 0,
    }
    sinks.write_json(spark, f"{out}/manifest.json", facts)
    sinks.write_report(spark, f"{out}/report.md", "Code metrics", facts, {"Periods": summary.orderBy("metric", "period")})
    sinks.write_plots(formal, measured, f"{out}/diagnostics.png")
    return facts


def run_text(spark: SparkSession, config: Config) -> dict:
    """Records to text novelty by quarter and group."""
    out = config.output
    raw = fields_of(read_logical(spark, config.input, "full")).where("n_fields = 31 and application_no <> ''")
    text = clean_text(F.col("abstract"))
    rows = raw.withColumns({
        "stkcd": codes.stock_code(F.col("stkcd_raw")), "relation_type": F.col("relation"), "patent_type_group": codes.patent_type_group(F.col("patent_type")), "abstract_clean": text,
        "claim_present_flag": (F.col("claim") != "").cast("int"), "claim_length_chars": F.length("claim"), "date": lenient_date(F.col("application_date")),
    }).withColumn("listed_parent", F.col("stkcd"))
    eligible = (codes.eligible_relation(F.col("relation")) == 1) & F.col("patent_type_group").isin(codes.BASELINE_TYPES) & F.col("date").isNotNull()
    rows = text_records.prepared(rows.withColumn("baseline_eligible", eligible.cast("int")), "ord")
    sinks.write_parquet(rows, f"{out}/text_records")
    rows = spark.read.parquet(f"{out}/text_records")
    sinks.write_by_year(text_records.text_core(rows), f"{out}/text_core")
    core = spark.read.parquet(f"{out}/text_core").where("application_date is not null and baseline_eligible = 1")
    docs = core.select(F.col("application_no").alias("app"), F.col("application_date").alias("date"), F.col("abstract_clean").alias("text"))
    scored = core.join(text_records.pit_novelty(docs, config.hash_buckets or None, low=config.ngram_low, high=config.ngram_high).drop("date"), F.col("application_no") == F.col("app")).drop("app", "application_year")
    sinks.write_by_year(scored, f"{out}/text_metrics")
    scored = spark.read.parquet(f"{out}/text_metrics")
    metrics = ["prior_centroid_novelty", "unseen_ngram_share", "abstract_length_chars"]
    market = text_records.text_by_quarter(scored, ["quarter"], metrics)
    sinks.write_parquet(market, f"{out}/market_quarter")
    edges = text_records.text_firm_edges(rows, scored).select("listed_parent", F.col("application_no").alias("a"))
    grouped = scored.drop("listed_parent").join(edges, F.col("application_no") == F.col("a"))
    sinks.write_parquet(text_records.text_by_quarter(grouped, ["listed_parent", "quarter"], metrics, config.min_group_patents), f"{out}/group_quarter")
    sinks.write_parquet(text_records.text_period_summary(scored, metrics), f"{out}/period_summary")
    groups = spark.read.parquet(f"{out}/group_quarter")
    sinks.write_csv(text_records.group_diagnostics(groups).coalesce(1).orderBy("quarter"), f"{out}/group_diagnostics_csv")
    audit = text_records.history_audit(scored).first().asDict() | text_records.quality_audit(scored, spark.read.parquet(f"{out}/market_quarter"), groups).first().asDict()
    sinks.write_json(spark, f"{out}/audit.json", audit)
    sinks.write_report(spark, f"{out}/report.md", "Text metrics", audit, {"Quarters": market.orderBy("quarter")})
    return audit


#: Stages of the similarity job in order; each reads what the one before has written.
STAGES = ("prepare", "vectors", "scores", "summary")


def run_similarity(spark: SparkSession, config: Config, tokenize=words, stage: str = "all") -> dict:
    """Records to backward and forward similarity, quality, and its summaries; ``stage`` runs one of STAGES only.

    ``tokenize`` maps a text column to tokens.
    """
    if stage not in (*STAGES, "all"):
        raise ValueError(f"stage must be one of {', '.join(STAGES)} or all")
    out, facts = config.output, {"stage": stage, "settings": config.as_dict()}
    wanted = lambda name: stage in (name, "all")
    if wanted("prepare"):
        raw = fields_of(read_logical(spark, config.input, "buffered")).where("application_no <> ''")
        dated = raw.withColumn("date", lenient_date(F.col("application_date"))).withColumn("kind", codes.patent_type_by_prefix(F.col("patent_type")))
        granted = dated.where((codes.granted_invention(F.col("kind"), F.col("grant_no"), F.col("grant_date")) == 1) & F.col("date").isNotNull())
        rows = granted.withColumn("text", combine_text(clean_text(F.col("title")), clean_text(F.col("abstract"))))
        one = rows.groupBy("application_no").agg(
            F.min("date").alias("date"), F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("text"), F.min_by(F.struct("applicant", "applicant_address"), "ord").alias("who"),
            F.min(codes.main_group(codes.prefix_code(F.col("ipc_main_raw")))).alias("field"), F.max(codes.eligible_relation(F.col("relation"))).alias("baseline_firm"),
        )
        docs = one.select(
            F.col("application_no").alias("app"), quarter_ordinal(F.col("date")).alias("q"), F.coalesce("field", F.lit("")).alias("field"),
            keys.applicant_key(F.col("who.applicant"), F.col("who.applicant_address")).alias("applicant"), tokenize(F.col("text")).alias("tokens"), "baseline_firm",
        )
        sinks.write_parquet(docs, f"{out}/documents")
        edges = dated.where(codes.eligible_relation(F.col("relation")) == 1).select(codes.stock_code(F.col("stkcd_raw")).alias("listed_parent"), F.col("application_no").alias("app")).where("listed_parent is not null").distinct()
        sinks.write_parquet(edges, f"{out}/firm_documents")
    docs = spark.read.parquet(f"{out}/documents")
    kept = docs.where(F.size("tokens") > 0)
    if wanted("vectors"):
        sinks.write_by_quarter(similarity.word_vectors(kept).withColumn("quarter", ordinal_label(F.col("q"))), f"{out}/vectors")
        similarity.check_vectors(spark.read.parquet(f"{out}/vectors"), kept)
    if wanted("scores"):
        counts = docs.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
        sinks.write_parquet(similarity.field_adjusted(similarity.scores(kept, counts, config.window_quarters)), f"{out}/scores")
    if wanted("summary"):
        scored = spark.read.parquet(f"{out}/scores")
        market = similarity.quality_summary(scored.join(kept.where("baseline_firm = 1").select("app"), "app", "left_semi"), ["q"]).withColumn("quarter", ordinal_label(F.col("q")))
        sinks.write_parquet(market, f"{out}/market")
        sinks.write_parquet(similarity.quality_summary(scored.join(spark.read.parquet(f"{out}/firm_documents"), "app"), ["listed_parent", "q"]), f"{out}/firms")
        facts["scored"] = scored.where("quality is not null").count()
    facts["documents"] = kept.count()
    sinks.write_json(spark, f"{out}/manifest.json", facts)
    return facts


def build_dictionary(spark: SparkSession, sources: dict[str, dict[str, str]], output: str) -> dict:
    """One dictionary of several versions. ``sources`` maps a version to paths by kind of source.

    Raises if a version holds a code twice.
    """
    merged = None
    for version, paths in sorted(sources.items()):
        read = lambda kind, schema: dict_sources.read_dictionary_source(spark, paths[kind], kind) if kind in paths else spark.createDataFrame([], schema)  # noqa: E731, B023
        one = audits.merge_dictionary(
            read("scheme", audits.SCHEME), read("valid_symbols", "ipc_code string"), read("title_list", audits.TITLES),
            read("wrapped_text", audits.TITLES), version,
        )
        merged = one if merged is None else merged.unionByName(one)
    sinks.write_parquet(merged, f"{output}/ipc_dictionary")
    final = spark.read.parquet(f"{output}/ipc_dictionary")
    if audits.duplicate_keys(final, ["scheme_version", "ipc_code"]).limit(1).count():
        raise ValueError("a version of the dictionary holds a code twice")
    sinks.write_csv(final, f"{output}/ipc_dictionary_csv")
    facts = {"codes": final.count(), "title_zh_status": {r[0]: r[1] for r in final.groupBy("title_zh_status").count().collect()}}
    sinks.write_json(spark, f"{output}/summary.json", facts)
    sinks.write_report(spark, f"{output}/report.md", "Dictionary", facts, {"By version and level": audits.dictionary_summary(final)})
    return facts


def run_audit(spark: SparkSession, config: Config) -> dict:
    """Observed codes of an export against the dictionary."""
    from ..sources.logical_csv import header_indices

    all_at, main_at = header_indices(spark, config.input)
    rows = read_logical(spark, config.input, "joined")
    get = lambda i: F.coalesce(F.get("fields", F.lit(i)), F.lit(""))
    fields = rows.select("byte_offset", get(all_at).alias("a"), get(main_at).alias("m"))
    observed = audits.observed_codes(fields, "byte_offset", "a", "m")
    status = audits.observed_status(observed, dict_sources.read_dictionary(spark, config.dictionary))
    sinks.write_parquet(status, f"{config.output}/observed_codes")
    sinks.write_csv(audits.top_malformed(observed), f"{config.output}/malformed_csv")
    facts = fields.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size(codes.split_codes(F.col("a"))) > 0).alias("with_all"), F.count_if(F.size(codes.split_codes(F.col("m"))) > 0).alias("with_main")).first().asDict()
    sinks.write_json(spark, f"{config.output}/audit.json", facts)
    by_status = spark.read.parquet(f"{config.output}/observed_codes").groupBy("status").agg(F.count(F.lit(1)).alias("codes"), F.sum("occurrence_count").alias("occurrences"))
    sinks.write_report(spark, f"{config.output}/audit.md", "Observed codes", facts, {"By status": by_status.orderBy("status")})
    return facts


def run_coverage(spark: SparkSession, config: Config) -> dict:
    """Coding coverage by quarter and dimension over the outputs of the code job."""
    out = config.output
    core, edges = spark.read.parquet(f"{out}/patent_core"), spark.read.parquet(f"{out}/patent_firm_edge")
    rows = fields_of(read_logical(spark, config.input, "prefix")).where((F.col("application_no") != "") & (codes.eligible_relation(F.col("relation")) == 1))
    apps = audits.coverage_apps(core, edges, rows.select("application_no", "industry"), dict_sources.read_dictionary(spark, config.dictionary))
    coverage = audits.coverage_by_dimension(apps, audits.COVERAGE_DIMENSIONS)
    sinks.write_parquet(coverage, f"{out}/coverage")
    coverage = spark.read.parquet(f"{out}/coverage")
    annual = audits.coverage_annual(coverage)
    sinks.write_csv(annual, f"{out}/coverage_annual_csv")
    facts = {"rows": coverage.count(), "applications": coverage.where("dimension = 'overall'").agg(F.coalesce(F.sum("patent_count"), F.lit(0))).first()[0]}
    sinks.write_report(spark, f"{out}/coverage.md", "Coverage", facts, {"By year": annual.where("dimension = 'overall'").orderBy("year")})
    return facts


def main(argv: list[str] | None = None) -> int:
    """Command line of the jobs."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["codes", "coverage", "text", "similarity", "audit", "dictionary"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--stage", choices=[*STAGES, "all"], default="all", help="stage of the similarity job")
    args = parser.parse_args(argv)
    spark = build_session()
    ship_package(spark)
    if args.job == "dictionary":
        given = json.loads(Path(args.config).read_text(encoding="utf-8"))
        print(build_dictionary(spark, given["sources"], given["output"]))
        return 0
    run = {"codes": run_codes, "coverage": run_coverage, "text": run_text, "similarity": partial(run_similarity, stage=args.stage), "audit": run_audit}[args.job]
    print(run(spark, load_config(args.config)))
    drop_materialized(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
