import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import codes, dates, keys, text, values


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2020-01-02", dt.date(2020, 1, 2)), ("2020/1/2", dt.date(2020, 1, 2)), ("20200102", dt.date(2020, 1, 2)), ("2020.01.02", dt.date(2020, 1, 2)), ("2020年1月2日", dt.date(2020, 1, 2)),
        ("2020-01-02 00:00:00", dt.date(2020, 1, 2)), (" ２０２０-01-02 ", dt.date(2020, 1, 2)), ("2 Jan 2020", dt.date(2020, 1, 2)), ("January 2, 2020", dt.date(2020, 1, 2)),
        ("2019-02-30", None), ("2023年4月31O日", None), ("2020-01", None), ("2020", None), ("unknown", None), ("", None), (None, None), ("2020/13/1", None), ("2024/2/32", None), ("20201301", None),
    ],
)
def test_full_date(spark, raw, want):
    assert one(spark, raw, dates.full_date) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2020-01", dt.date(2020, 1, 1)), ("2020", dt.date(2020, 1, 1)), ("2020Q2", dt.date(2020, 4, 1)), ("01/02/2020", dt.date(2020, 1, 2)), ("1/2/20", dt.date(2020, 1, 2)), ("2020年1月2日", None),
        ("43831", None), ("1500-01-01", None), (None, None), ("2011-07-18", dt.date(2011, 7, 18)),
    ],
)
def test_lenient_date(spark, raw, want):
    assert one(spark, raw, dates.lenient_date) == want


def test_quarters(spark):
    row = spark.sql("select date'2011-07-18' d").select(
        dates.quarter_label(F.col("d")), dates.quarter_ordinal(F.col("d")), dates.ordinal_label(dates.quarter_ordinal(F.col("d"))), dates.label_ordinal(F.lit("2011Q3")), dates.period_of_year(F.lit(2011)), dates.period_of_year(F.lit(1980))
    ).first()
    assert tuple(row) == ("2011Q3", 8046, "2011Q3", 8046, "2010-2019", None)


@pytest.mark.parametrize("raw, want", [('="001283"', "001283"), ("1283", "001283"), ("1283.0", "001283"), ("'008943", "008943"), ("SH309945", "309945"), ("12345678", "123456"), ("N/A", None), ("", None), (None, None)])
def test_stock_code(spark, raw, want):
    assert one(spark, raw, codes.stock_code) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("H01L 21/3065[2006.01]", "H01L21/3065"), ("H01L0021306500", "H01L21/3065"), ("h01l21/0", "H01L21/00"), ("H", "H"), ("H01", "H01"), ("H01L", "H01L"), ("H01L0021100000", "H01L21/10"),
        ("H01L0021000000", "H01L21/00"), ("A01B／1", None), ("I01B1/00", None), ("67/", None), (None, None), ("H01L０21/1", None),
    ],
)
def test_normalize_code(spark, raw, want):
    assert one(spark, raw, codes.normalize_code) == want


def test_normalize_code_compat(spark):
    assert one(spark, "H01L0021100000", lambda c: codes.normalize_code(c, compat=True)) == "H01L21/01"


def test_levels_and_parents(spark):
    df = spark.createDataFrame([(c,) for c in ("H", "H01", "H01L", "H01L21/00", "H01L21/3065", None)], "c string")
    got = [tuple(r) for r in df.select(codes.code_level(F.col("c")), codes.parent_code(F.col("c")), codes.main_group(F.col("c"))).collect()]
    assert got == [("section", None, None), ("class", "H", None), ("subclass", "H01", None), ("main_group", "H01L", "H01L21"), ("subgroup", "H01L21/00", "H01L21"), (None, None, None)]


def test_code_tokens(spark):
    got = one(spark, "H01L21/3065; H01L21/3065；G06F1/00I;;bad", codes.code_tokens)
    assert [(t.raw_ipc, t.code, t.subclass, t.status) for t in got] == [
        ("H01L21/3065", "H01L21/3065", "H01L", "normalized"), ("G06F1/00I", "G06F1/00", "G06F", "suffix_stripped"), ("bad", None, None, "unmatched"),
    ]
    assert one(spark, "H01L21/3065; H01L21/3065; G06F1/00", codes.code_subclasses) == ["G06F", "H01L"]
    assert one(spark, None, codes.code_subclasses) == []


def test_types_and_relations(spark):
    assert [one(spark, t, codes.patent_type_group) for t in ("发明申请", "发明专利", "实用新型", "外观设计", None)] == ["invention", "other", "utility_model", "design", "other"]
    assert one(spark, "发明专利", codes.patent_type_by_prefix) == "invention"
    assert [one(spark, r, codes.eligible_relation) for r in (" 上市公司本身 ", "其他关联方", None)] == [1, 0, 0]


def test_keys_and_formulas(spark):
    row = spark.range(1).select(
        keys.applicant_key(F.lit("A 公司"), F.lit("123456 北京 路1号")), keys.applicant_key(F.lit(None).cast("string"), F.lit("x")), keys.bidf(F.lit(100), F.lit(9)), keys.bidf(F.lit(0), F.lit(0)),
        keys.relatedness(F.lit(2), F.lit(4), F.lit(4)), keys.relatedness(F.lit(0), F.lit(0), F.lit(4)), keys.distance(F.lit(1.5)),
    ).first()
    assert row[0] == "a公司||北京路1号" and row[1] == "" and abs(row[2] - 2.302585092994046) < 1e-12 and row[3] is None and row[4] == 0.5 and row[5] == 0 and row[6] == 0


def test_text_functions(spark):
    assert one(spark, "Ａ​ b\n　c ", text.clean_text) == "A b c"
    assert one(spark, None, text.clean_text) == ""
    assert sorted(one(spark, "abcd", text.char_ngrams)) == sorted(["ab", "bc", "cd", "abc", "bcd", "abcd"])
    assert one(spark, "a", text.char_ngrams) == [] and one(spark, None, text.char_ngrams) == []
    assert [one(spark, t, text.distinct_chars) for t in ("aab", "", None)] == [2, 0, 0]
    assert one(spark, "锂电 Li+ battery", text.words) == ["锂电", "li+", "battery"]


def test_no_value(spark):
    assert [one(spark, v, values.is_no_value) for v in (None, "", " 　", "-", "n/a", "无", "Ｎ／Ａ", "A01B")] == [True] * 7 + [False]
