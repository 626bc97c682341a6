"""Novelty in blocks of dates: the same scores for any block, and no rows of n-grams on disk."""

import datetime as dt
import random

import pytest
from test_stages import novelty_loop

from lodestrata import session
from lodestrata.operators import text_records

DOCS = "app string, date date, text string"


def texts(seed, n, days, length):
    rng = random.Random(seed)
    # every third document is of one date, which so needs a group and several parts of its own
    return [(f"d{i}", dt.date(2020, 1, 5 if i % 3 == 0 else 1 + rng.randrange(days)), "".join(rng.choice("ab甲乙𠀀") for _ in range(rng.randint(1, length)))) for i in range(n)]


@pytest.mark.parametrize("block", [1, 40, 100_000])
def test_scores_do_not_depend_on_blocks(spark, block):
    docs = texts(3, 60, 9, 25)
    got = {r.app: r for r in text_records.pit_novelty(spark.createDataFrame(docs, DOCS), block=block).collect()}
    assert len(got) == len(docs)
    for app, (n, unseen, sim) in novelty_loop(docs).items():
        r = got[app]
        assert r.history_document_count == n
        assert r.unseen_ngram_share == (None if unseen is None else pytest.approx(unseen)) and r.prior_centroid_similarity == (None if sim is None else pytest.approx(sim))


@pytest.mark.parametrize("buckets", [None, 50])
def test_nothing_written_has_a_row_per_ngram(spark, buckets):
    docs = spark.createDataFrame(texts(4, 100, 20, 200), DOCS)
    before = len(session._written(spark))
    text_records.pit_novelty(docs, buckets).collect()
    written = session._written(spark)[before:]
    assert written and max(spark.read.parquet(p).count() for p in written) <= 100


def test_hashed_blocks_agree_with_one_block(spark):
    docs = spark.createDataFrame(texts(5, 50, 9, 30), DOCS)
    one, many = ({r.app: (r.unseen_ngram_share, r.prior_centroid_similarity) for r in text_records.pit_novelty(docs, 20, block=b).collect()} for b in (100_000, 50))
    assert all(many[a] == (pytest.approx(u), None if s is None else pytest.approx(s)) for a, (u, s) in one.items() if u is not None)


def test_no_dates_and_no_texts(spark):
    got = text_records.pit_novelty(spark.createDataFrame([("a", None, "text"), ("b", dt.date(2020, 1, 1), None)], DOCS)).collect()
    assert {(r.app, r.history_document_count, r.prior_centroid_novelty) for r in got} == {("a", None, None), ("b", 0, None)}


@pytest.mark.parametrize(("buckets", "block"), [(None, 1), (None, 40), (50, 40)])
def test_rounds_keep_the_scores_and_a_part_on_disk(spark, buckets, block, monkeypatch):
    written, materialize = [], session.materialize

    def recorded(df, **options):
        found = materialize(df, **options)
        if "slice" in found.columns:
            written.append(found.where("grp >= 0").select("grp", "part").distinct().count())
        return found

    docs = spark.createDataFrame(texts(7, 60, 20, 25), DOCS)
    score = lambda rounds: {r.app: (r.history_document_count, r.unseen_ngram_share, r.prior_centroid_similarity) for r in text_records.pit_novelty(docs, buckets, block=block, rounds=rounds, least=1).collect()}
    one = score(1)
    monkeypatch.setattr(session, "materialize", recorded)
    before = len(session._written(spark))
    many = score(3)
    assert one.keys() == many.keys()
    assert all(many[a] == (n, u if u is None else pytest.approx(u), s if s is None else pytest.approx(s)) for a, (n, u, s) in one.items())
    # counts and sums of three rounds, none with the blocks of another, and none left
    counts, sums = written[::2], written[1::2]
    assert counts == sums and len(counts) == 3 and max(counts) < sum(counts)
    assert not any("slice" in spark.read.parquet(p).columns for p in session._written(spark)[before:])
