import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import survivors as S

SCHEMA = "app string, id bigint, value string, competes boolean, trust_rank int, loaded_at timestamp"
T = lambda d: dt.datetime(2020, 1, d)


def run(spark, rows):
    return {r.app: r.id for r in S.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_order_of_rules(spark):
    assert run(spark, [("a", 1, "x", True, 2, T(9)), ("a", 2, "x", True, 1, T(1)), ("a", 3, "x", True, 1, T(2)), ("a", 4, "x", True, 1, T(2)), ("a", 5, "x", False, 0, T(9))]) == {"a": 4}


def test_edges(spark):
    rows = [("one", 1, "x", True, 1, T(1)), ("none", 2, None, False, 1, T(1)), ("none", 3, None, False, 1, T(1)), (None, 4, "x", True, 1, T(1)), (None, 5, "x", True, 1, T(1)), ("rank", 6, "x", True, None, T(9)), ("rank", 7, "x", True, 5, T(1)),
            ("rep", 8, "x", True, 1, T(1)), ("rep", 8, "x", True, 1, T(1))]
    assert run(spark, rows) == {"rank": 7, "rep": 8}
    assert run(spark, []) == {}


def learned(n=10):
    # in timestamped groups a draft ("9") always comes before the final form ("A9"), that before ("H9")
    return [r for g in range(n) for r in ((f"g{g}", 10 * g, "123", True, 1, T(1)), (f"g{g}", 10 * g + 1, "B123", True, 1, T(2)), (f"g{g}", 10 * g + 2, "文1", True, 1, T(3)))]


def test_missing_times_follow_learned_precedence(spark):
    rows = learned()
    rows += [("q", 900, "999", True, 1, None), ("q", 901, "Z55", True, 1, None), ("q", 902, "777", True, 1, T(30)), ("u", 910, "1", True, 1, None), ("u", 911, "2", True, 1, None)]
    got = run(spark, rows)
    assert got["q"] == 901 and got["u"] == 911 and got["g0"] == 2


def test_known_times_stay_in_the_partial_order(spark):
    rows = learned()
    # a later time is after an earlier one whatever their kinds; the undated draft precedes what is dated
    rows += [("a", 1000, "A9", True, 1, T(5)), ("a", 1001, "9", True, 1, T(6)), ("a", 1002, "8", True, 1, None)]
    # learned: the undated value comes after the newest dated one
    rows += [("b", 1010, "8", True, 1, T(6)), ("b", 1011, "A9", True, 1, None)]
    # nothing learned about this kind: the known time goes first
    rows += [("c", 1020, "8", True, 1, T(6)), ("c", 1021, "?!?", True, 1, None)]
    # a missing time below the winning trust does not matter
    rows += [("d", 1030, "8", True, 1, T(6)), ("d", 1031, "A9", True, 2, None)]
    # H9 > A9 learned, A9 before the dated draft by time: a circle with the undated H9; the known time stands
    got = run(spark, rows)
    assert (got["a"], got["b"], got["c"], got["d"]) == (1001, 1011, 1020, 1030)


def test_precedence_needs_support_and_balance(spark):
    df = lambda rows: spark.createDataFrame(rows, "app string, kind int, first_at timestamp")
    pairs = lambda rows: {tuple(r) for r in S.learn_precedence(df(rows)).collect()}
    clear = [r for g in range(10) for r in ((f"g{g}", 7, T(1)), (f"g{g}", 3, T(2)))]
    assert pairs(clear) == {(7, 3)} and pairs(clear[:12]) == set() and pairs([]) == set()
    mixed = clear + [r for g in range(8) for r in ((f"h{g}", 7, T(2)), (f"h{g}", 3, T(1)))]
    assert pairs(mixed) == set()


def test_kinds_are_bounded_and_read_the_whole_value(spark):
    kinds = lambda *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(S.value_kind(F.col("v"))).collect()]
    a, b, c, d, e = kinds("2020-01-02", "1999-12-31", "A01B1/00;C02D3/04", "A01B1/00;C02D3/04;E05F5/06", None)
    assert a == b and c == d and e is None or 0 <= e < S.KINDS
    long = "字" * 100 + "，1;" * 50
    assert kinds(long + "。")[0] != kinds(long + "x")[0]


@pytest.mark.parametrize("raw, key", [("CN2020800005845.3", "20208000058453"), (" cn 2009100007124.x", "2009100007124X"), ("20101000119393", "20101000119393"), ("无", None), ("", None), (None, None), ("ＣＮ1.2", "12")])
def test_application_key(spark, raw, key):
    got = spark.createDataFrame([(raw,)], "v string").select(S.application_key(F.col("v")).alias("k"))
    assert got.first().k == key
    if key:
        assert got.select(S.application_number(F.col("k"))).first()[0] == f"CN{key[:-1]}.{key[-1]}"


def test_fields(spark):
    df = spark.createDataFrame([
        ("a", 1, "2020-02-30", ";", "x" * 79, 1, T(1)), ("a", 2, "2020年2月3日", "A01B1/00", "y" * 80, 1, T(1)), ("a", 3, None, "-", "z" * 100, 2, T(1)), ("a", 4, "2020-01", None, None, 1, T(1)),
    ], "app string, id bigint, application_date string, ipc_all_raw string, abstract_clean string, trust_rank int, loaded_at timestamp")
    ok = lambda out: [r.id for r in out.orderBy("id").collect() if r.competes]
    assert ok(S.date_rows(df)) == [2] and ok(S.code_rows(df)) == [2] and ok(S.abstract_rows(df)) == [2, 3]
