import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.config import load_config
from lodestrata.plans import jobs
from lodestrata.streaming import ingest

from test_sources import row


def export(path):
    lines = [
        row(f2="c", f4="上市公司本身", f8="锂电池", f9="发明授权", f10="甲", f16="CN1", f17="1985-01-01", f22="G1", f25="A01B1/00;G06F1/00", f26="A01B1/00", f28="一种锂电池隔膜"),
        row(f2="c", f4="上市公司本身", f8="锂电池", f9="发明授权", f10="甲", f16="CN1", f17="1985-01-01", f22="G1", f25="A01B1/00;G06F1/00", f26="A01B1/00", f28="一种锂电池"),
        row(f2="c", f4="上市公司本身", f8="锂电池", f9="发明授权", f10="乙", f16="CN2", f17="1994-01-01", f22="G2", f25="A01B1/00;G06F1/00", f26="A01B1/00", f28="一种锂电池隔膜制法", f29="权利要求"),
    ]
    path.write_text("﻿head\n" + "\n".join(",".join(r) for r in lines) + "\n", encoding="utf-8")


@pytest.fixture
def config(tmp_path):
    export(tmp_path / "in.csv")
    (tmp_path / "c.json").write_text(json.dumps({"input": "in.csv", "output": "out"}))
    return load_config(tmp_path / "c.json")


def test_codes_job_and_resume(spark, config):
    facts = jobs.run_codes(spark, config)
    assert facts["applications"] == 2 and facts["pairs"] == 2
    q = spark.read.parquet(f"{config.output}/quarterly_metrics").where("quarter = '1994Q1'").first()
    assert q.patent_count == 1 and q.novel_patent_count == 0
    assert jobs.run_codes(spark, config) == facts


def test_codes_job_summarises_all_metrics(spark, config):
    jobs.run_codes(spark, config)
    got = {r.metric: r for r in spark.read.parquet(f"{config.output}/period_summary").where("period = '1994-1999'").collect()}
    assert len(got) == 21 and got["average_patent_scope"]["mean"] == 2.0 and got["multi_ipc_patent_share"]["last"] == 1.0 and got["utility_model_patent_count"]["sum"] == 0.0


def test_annual_comparison_in_the_job(spark, config, tmp_path):
    from dataclasses import replace

    columns = "year int, stkcd string, patents_independent_annual bigint, patents_invention_independent_annual bigint, patents_utility_model_independent_annual bigint, patents_design_independent_annual bigint"
    spark.createDataFrame([(1985, "1", 2, 2, 0, 0), (1985, "2", 1, 0, 1, 0), (1990, "1", 1, 1, 0, 0)], columns).write.parquet(str(tmp_path / "panel"))
    jobs.run_codes(spark, replace(config, annual_panel=str(tmp_path / "panel")))
    got = {r.year: r for r in spark.read.parquet(f"{config.output}/annual_reconciliation").collect()}
    assert (got[1985].detail_patent_count, got[1985].existing_panel_patent_count, got[1985].detail_minus_existing_patent_count) == (1, 3, -2)
    assert got[1994].detail_invention_patent_count == 1 and got[1994].existing_panel_patent_count is None and got[1990].detail_other_patent_count == 0
    assert spark.read.parquet(f"{config.output}/failure_sample").count() == 0 and spark.read.parquet(f"{config.output}/unmatched_sample").columns[0] == "quarter"
    with pytest.raises(ValueError):
        from lodestrata.operators.code_metrics import annual_comparison

        annual_comparison(spark.read.parquet(f"{config.output}/quarterly_metrics"), spark.range(1))


def test_metrics_of_a_universe_by_itself(spark, config):
    from lodestrata.operators.code_metrics import metrics_of_universe

    jobs.run_codes(spark, config)
    universe, edges, events = (spark.read.parquet(f"{config.output}/{t}") for t in ("patent_universe", "patent_ipc_edge", "patent_ipc_pair"))
    got = {r.quarter: r for r in metrics_of_universe(universe, edges, events).collect()}
    whole = {r.quarter: r for r in spark.read.parquet(f"{config.output}/quarterly_base").collect()}
    assert min(got) == "1985Q1" and max(got) == "1994Q1" and len(got) == 37 and got["1994Q1"].eligible_all_patent_count == 1
    for c in ("patent_count", "ipc_hhi", "rao_stirling_diversity", "novel_pair_share"):
        assert got["1994Q1"][c] == whole["1994Q1"][c]
    assert metrics_of_universe(universe.limit(0), edges.limit(0), events.limit(0)).count() == 0


def test_pre_sample_counts_and_quality_audit(spark, config):
    from pathlib import Path

    facts = jobs.run_codes(spark, config)
    assert (facts["pre_sample_record_count"], facts["pre_sample_year_counts"], facts["pre_sample_seen_pair_count"], facts["pre_sample_pair_occurrence_count"]) == (1, {"1985": 1}, 1, 1)
    audit = jobs.run_text(spark, config)
    assert (audit["baseline_type_bad_rows"], audit["group_duplicate_keys"], audit["history_count_max"], audit["pit_history_mismatch_dates"]) == (0, 0, 1, 0)
    assert "1994Q1,1,1.0,1" in "".join(p.read_text(encoding="utf-8") for p in Path(config.output, "group_diagnostics_csv").glob("*.csv"))


def test_coverage_job(spark, config, tmp_path):
    from dataclasses import replace

    jobs.run_codes(spark, config)
    spark.createDataFrame([("A01B", "subclass", True)], "ipc_code string, ipc_level string, is_valid boolean").write.parquet(str(tmp_path / "dict"))
    assert jobs.run_coverage(spark, replace(config, dictionary=str(tmp_path / "dict")))["applications"] == 2
    rows = spark.read.parquet(f"{config.output}/coverage").where("dimension = 'overall'").collect()
    assert {(r.quarter, r.patent_count, r.ipc_coding_rate) for r in rows} == {("1985Q1", 1, 1.0), ("1994Q1", 1, 1.0)}


def test_coverage_job_takes_every_eligible_type(spark, config, tmp_path):
    from dataclasses import replace

    lines = [
        row(f4="上市公司本身", f6="制造业", f9="外观设计", f11="企业", f16="CN3", f17="2001-01-01"),
        row(f4="上市公司本身", f6="", f9="发明授权", f11="企业", f16="CN4", f17="2001-02-01", f25="A01B1/00;G06F1/00", f26="A01B1/00"),
        row(f4="上市公司的子公司", f6="农业", f9="PCT发明", f16="CN5", f17="2001-03-01"),
        row(f4="上市公司本身", f6="农业", f9="PCT发明", f16="CN5", f17="2001-03-01"),
        row(f4="供应商", f6="农业", f9="外观设计", f16="CN6", f17="2001-03-01"),
    ]
    (tmp_path / "in.csv").write_text("head\n" + "\n".join(",".join(r) for r in lines) + "\n", encoding="utf-8")
    spark.createDataFrame([("A01B", "subclass", True)], "ipc_code string, ipc_level string, is_valid boolean").write.parquet(str(tmp_path / "dict"))
    jobs.run_codes(spark, config)
    assert jobs.run_coverage(spark, replace(config, dictionary=str(tmp_path / "dict")))["applications"] == 3
    got = {(r.dimension, r.category): (r.patent_count, r.ipc_coded_patent_count) for r in spark.read.parquet(f"{config.output}/coverage").collect()}
    assert got == {
        ("overall", "all"): (3, 1), ("patent_type_group", "design"): (1, 0), ("patent_type_group", "invention"): (1, 1), ("patent_type_group", "other"): (1, 0),
        ("industry", "制造业"): (1, 0), ("industry", "__MISSING__"): (1, 1), ("industry", "农业"): (1, 0), ("relation", "上市公司本身"): (2, 1),
        ("relation", "上市公司本身; 上市公司的子公司"): (1, 0), ("applicant_type", "企业"): (2, 1), ("applicant_type", "__MISSING__"): (1, 0),
    }


def test_dictionary_job(spark, tmp_path):
    from test_sources import FLAT, zipped

    (tmp_path / "s.zip").write_bytes(zipped(EN_ipc_scheme_x__xml=FLAT))
    (tmp_path / "v.zip").write_bytes(zipped(valid_symbols__xml='<a><IpcSymbol symbol="H"/></a>'))
    facts = jobs.build_dictionary(spark, {"2026.01": {"scheme": str(tmp_path / "s.zip"), "valid_symbols": str(tmp_path / "v.zip")}}, str(tmp_path / "out"))
    assert facts == {"codes": 2, "title_zh_status": {"missing_source": 2}}
    got = {r.ipc_code: (r.is_valid, r.ipc_level, r.main_group_code) for r in spark.read.parquet(str(tmp_path / "out" / "ipc_dictionary")).collect()}
    assert got == {"H": (True, "section", None), "H01L21/3065": (False, "subgroup", "H01L21/00")}


def test_text_similarity_and_audit_jobs(spark, config, tmp_path):
    assert jobs.run_text(spark, config)["history_mismatch_dates"] == 0
    assert jobs.run_similarity(spark, config)["documents"] == 2
    whole = sorted(map(str, spark.read.parquet(f"{config.output}/scores").collect()))
    for stage in jobs.STAGES:
        assert jobs.run_similarity(spark, config, stage=stage)["stage"] == stage
    assert sorted(map(str, spark.read.parquet(f"{config.output}/scores").collect())) == whole
    with pytest.raises(ValueError):
        jobs.run_similarity(spark, config, stage="other")
    with pytest.raises(ValueError):
        from lodestrata.operators.similarity import check_vectors

        docs = spark.read.parquet(f"{config.output}/documents")
        check_vectors(docs.selectExpr("'none' AS app", "q", "'w' AS word"), docs)
    spark.createDataFrame([("A01B1/00", "main_group", True)], "ipc_code string, ipc_level string, is_valid boolean").write.parquet(str(tmp_path / "dict"))
    from dataclasses import replace

    assert jobs.run_audit(spark, replace(config, dictionary=str(tmp_path / "dict"))) == {"records": 3, "with_all": 3, "with_main": 3}


def test_unknown_setting(tmp_path):
    (tmp_path / "c.json").write_text('{"shards": 3}')
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.json")


def test_quarantine_stream(spark, tmp_path):
    good, bad = ",".join(row(f16="CN1", f17="2020-01-01")), "x"
    spark.createDataFrame([(1, good), (2, bad)], "row_id bigint, raw_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id bigint, raw_text string").parquet(str(tmp_path / "in"))
    ingest.quarantine_stream(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.row_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [(r.row_id, r.fail_reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(2, "column_count")]


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streamed_history_and_windows(spark, tmp_path):
    data = [("a|b", dt.date(2020, 1, 1)), ("a|b", dt.date(2020, 1, 1)), ("a|b", dt.date(2020, 1, 2)), ("c|d", dt.date(2020, 1, 2))]
    spark.createDataFrame(data, "pair_id string, application_date date").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("pair_id string, application_date date").parquet(str(tmp_path / "p"))
    drain(ingest.pair_history_stream(stream), "hist")
    got = {(r.pair_id, r.application_date.day): (r.n, r.historical_pair_count) for r in spark.table("hist").collect()}
    assert got == {("a|b", 1): (2, 0), ("a|b", 2): (1, 2), ("c|d", 2): (1, 0)}
    timed = stream.withColumn("ts", F.col("application_date").cast("timestamp"))
    drain(ingest.windowed_counts(timed, "ts", "pair_id"), "win", "complete")
    assert sum(r.n for r in spark.table("win").collect()) == 4


def test_materialized_tables_are_dropped(spark):
    from lodestrata.session import drop_materialized, materialize

    assert materialize(spark.range(3)).count() == 3
    assert drop_materialized(spark) >= 1 and drop_materialized(spark) == 0
