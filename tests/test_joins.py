"""Sides of joins that grow with the input are never broadcast, however small their files look."""

import io
import random
from contextlib import redirect_stdout

from lodestrata.operators import similarity
from lodestrata.session import materialize


def plan(df):
    df.collect()
    said = io.StringIO()
    with redirect_stdout(said):
        df.explain("formatted")
    return said.getvalue()


def documents(spark, n):
    rng = random.Random(2)
    rows = [(f"a{i}", rng.randrange(4), rng.choice("FG"), rng.choice("PQR"), [rng.choice("tuvwxyz") for _ in range(9)]) for i in range(n)]
    return materialize(spark.createDataFrame(rows, "app string, q int, field string, applicant string, tokens array<string>"))


def broadcast_of(text, column):
    """The broadcast exchanges of a formatted plan that send ``column``."""
    parts = [p for p in text.split("\n\n") if "BroadcastExchange" in p.split("\n", 1)[0] and "Input" in p]
    return [p for p in parts if f"{column}#" in p]


def test_words_are_not_sent_to_the_driver(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b") in ("10m", "10485760")
    text = plan(similarity.word_vectors(documents(spark, 60)))
    assert "BroadcastExchange" in text and not broadcast_of(text, "word")


def test_scores_send_neither_words_nor_documents(spark):
    granted = spark.createDataFrame([(q, 5) for q in range(4)], "q int, n bigint")
    text = plan(similarity.scores(documents(spark, 60), granted, window=2))
    assert not broadcast_of(text, "word") and not broadcast_of(text, "app")


def test_variants_of_names_are_not_sent_to_the_driver(spark):
    from lodestrata.llm import names

    rows = [(f"s{i}", "c" * 12, stem, 2, 0, [0]) for i, stem in enumerate(["harbour", "harbor", "meadow"])]
    placed = materialize(spark.createDataFrame(rows, "sid string, code string, stem string, radius int, home int, cells array<int>"))
    text = plan(names.candidate_pairs(placed))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text
    linked = materialize(spark.createDataFrame([("x", 1, "e"), ("x", 2, "e")], "space string, name_id bigint, entity string"))
    assert "BroadcastExchange" not in plan(names.name_pairs(linked))
