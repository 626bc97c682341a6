from lodestrata.operators import packed

SCHEMA = "id bigint, src string, v string, pieces_ int"


def run(spark, values, filler=True):
    base = [(1000 + i, "s", f"A01B1/0{i}{sep}C02D3/1{i}", 0) for i in range(1, 6) for sep in ("；", ";", "; ", "|", "、", "\n", "  ", "，", "\t", "　", "||", " | ")] if filler else []
    df = spark.createDataFrame(base + [(i, "s", v, 0) for i, v in enumerate(values)], SCHEMA)
    out = packed.split_packed(df, ["src"], "v")
    return {r.id: r.pieces for r in out.collect() if r.id < 1000}


def test_separators_quotes_and_layout(spark):
    got = run(spark, [
        'A01B1/02; C02D3/14 | E05F 1/2', '"A01B1/02，发明信息"、\'C02D3/14|备注\'', '["A35J 4/1177(2011.01)N", "B14F 71/7846"]', "a12q80/8770  A45N82/3589", "C72L  55 / 8653", "A45N93/5371；；67/",
        "“G61M53/4027[2006.01](主,附)”", "-", None, "", "A01B1/02;A01B1/02", "; A01B1/02 ;", "N/A;A01B1/02", '"A01B1/02; C02D3/14',
    ])
    assert got[0] == ["A01B1/02", "C02D3/14", "E05F1/2"]
    assert got[1] == ["A01B1/02,发明信息", "C02D3/14|备注"]
    assert got[2] == ["A35J4/1177(2011.01)N", "B14F71/7846"]
    assert got[3] == ["A12Q80/8770", "A45N82/3589"] and got[4] == ["C72L55/8653"]
    assert got[5] == ["A45N93/5371", "67/"] and got[6] == ["G61M53/4027[2006.01](主,附)"]
    assert got[7] == [] and got[8] == [] and got[9] == []
    assert got[10] == ["A01B1/02"] * 2 and got[11] == ["A01B1/02"] and got[12] == ["A01B1/02"]
    assert got[13] == ["A01B1/02", "C02D3/14"]


def test_unused_separator_is_not_inferred(spark):
    df = spark.createDataFrame([(i, "s", "A01B1/02-x, y", 0) for i in range(20)] + [(100 + i, "t", "A01B1/02,C02D3/14", 0) for i in range(20)], SCHEMA)
    scores = {(r.src, r.candidate): r.score for r in packed.score_delimiters(df, ["src"], "v").collect()}
    assert scores[("t", "comma")] > 0.5 and scores.get(("s", "comma"), 0) < 0.5
    got = {r.src: r.pieces for r in packed.split_packed(df, ["src"], "v").collect()}
    assert got["t"] == ["A01B1/02", "C02D3/14"] and got["s"] == ["A01B1/02-X,Y"]


def test_empty_null_source_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packed.split_packed(df, ["src"], "v").count() == 0
    long = ";".join(f"A01B{i}/00" for i in range(5000))
    df = spark.createDataFrame([(1, None, long, 0), (2, None, "A01B1/00;C02D1/00", 0)], SCHEMA)
    got = {r.id: len(r.pieces) for r in packed.split_packed(df, ["src"], "v").collect()}
    assert got == {1: 5000, 2: 2}


def test_positions(spark):
    df = spark.createDataFrame([(i, "s", "A01B1/00;C02D1/00", 0) for i in range(3)], SCHEMA)
    out = packed.explode_pieces(packed.split_packed(df, ["src"], "v"), ["id"], minimum=2)
    assert sorted(map(tuple, out.collect()))[:2] == [(0, 1, "A01B1/00"), (0, 2, "C02D1/00")]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "s", "A01B1/00;C02D1/00", "mine") for i in range(3)], "id bigint, src string, v string, pieces string")
    row = packed.split_packed(df, ["src"], "v").first()
    assert row.in_pieces == "mine" and row.pieces == ["A01B1/00", "C02D1/00"]
