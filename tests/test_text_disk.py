"""What scoring of texts leaves on disk: the texts once, and no shuffle files of results that are written."""

import os
import time

import pytest
from test_gram_history import DOCS, texts

from lodestrata import session
from lodestrata.operators import text_records
from lodestrata.plans import reference_queries

DATA = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_exchanged_rows_are_removed_once_written(spark):
    before = shuffle_files(spark)
    session.materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), remove_exchanged=True)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(session.REMOVE_EXCHANGED) == "false"


@pytest.mark.parametrize("buckets", [None, 50])
def test_novelty_writes_no_copy_of_the_texts(spark, buckets):
    docs = spark.createDataFrame(texts(6, 60, 10, 60), DOCS)
    before = len(session._written(spark))
    text_records.pit_novelty(docs, buckets).collect()
    written = session._written(spark)[before:]
    assert written and not any("text" in spark.read.parquet(p).columns for p in written)


def test_core_of_fewer_columns(spark):
    rows = text_records.prepared(spark.read.parquet(f"{DATA}/text_records.parquet"), "text_id") if os.path.isdir(DATA) else pytest.skip("no test tables")
    whole = text_records.text_core(rows)
    for meta in ([], ["relation"]):
        less = text_records.text_core(rows, meta)
        assert set(whole.columns) - set(less.columns) == set(text_records.META) - set(meta)
        assert less.exceptAll(whole.select(less.columns)).isEmpty() and whole.select(less.columns).exceptAll(less).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_scored_rows_hold_no_texts(spark):
    before = len(session._written(spark))
    scored = reference_queries._scored(spark, DATA)
    assert "abstract_clean" not in scored.columns and scored.count() > 0
    assert sum("abstract_clean" in spark.read.parquet(p).columns or "text" in spark.read.parquet(p).columns for p in session._written(spark)[before:]) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["pit_text_hashed", "text_market_quarter", "pit_history_audit", "text_period_summary", "text_quality_audit"])
def test_queries_write_the_texts_once(spark, name):
    before = len(session._written(spark))
    reference_queries.QUERIES[name](spark, DATA)
    tables = [spark.read.parquet(p).columns for p in session._written(spark)[before:]]
    assert len(tables) > 3 and sum("abstract_clean" in c or "text" in c for c in tables) == 1
