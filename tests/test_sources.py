import csv
import io
import zipfile
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.sources import dictionary as D
from lodestrata.sources import logical_csv as L
from lodestrata.sources import sinks


def row(**fields):
    out = [""] * 31
    out[0] = '="001283"'
    for k, v in fields.items():
        out[int(k[1:])] = v
    return out


def quoted(fields):
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerow(fields[1:])
    return fields[0] + "," + buffer.getvalue()


def sequential(text, mode):
    groups = []
    for line in io.StringIO(text.removeprefix("﻿"), newline=""):
        if L.RECORD_START.match(line):
            groups.append([line])
        elif groups:
            groups[-1].append(line)
    return [L.read_group(g, mode) for g in groups]


SAMPLE = "﻿代码,IPC分类号,IPC主分类号\n" + quoted(row(f16="CN1", f28="one\ntwo", f29="c")) + ",".join(row(f16="CN2", f28="abs")) + "\ncontinued, here\n" + ",".join(row(f16="CN3", f29="claim")) + "\r\nmore\r\n" + ",".join(row()[:10]) + "\nshort\n"


def test_modes():
    full = sequential(SAMPLE, "full")
    assert [r[16] for r in full] == ["CN1", "CN2", "CN3", ""] and full[0][28] == "one\ntwo" and full[1][28] == "abs\ncontinued, here" and full[2][29] == "claim\nmore"
    assert [len(r) for r in sequential(SAMPLE, "prefix")] == [31, 31, 31, 10]
    assert all(len(r) == 31 for r in sequential(SAMPLE, "buffered"))
    assert sequential(SAMPLE, "joined")[0][28] == "onetwo" and len(sequential(SAMPLE, "joined")[3]) == 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet='a",\n\r=é', max_size=12), min_size=1, max_size=12), st.integers(1, 60), st.sampled_from(L.MODES))
def test_any_split_gives_the_same_records(parts, size, mode):
    text = "﻿head\r" + "".join(('="001283",' if i % 2 else "") + p + ("\n" if i % 3 else "\r\n") for i, p in enumerate(parts))
    data = text.encode()
    handle = io.BytesIO(data)
    got = [f for a in range(0, len(data), size) for _, f in L.records_of(handle, a, min(a + size, len(data)), len(data), mode)]
    assert got == sequential(text, mode)


def test_reader_in_spark(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(SAMPLE.encode())
    for mode in L.MODES:
        df = L.read_logical(spark, str(path), mode, split_bytes=50)
        assert [r.fields for r in df.orderBy("byte_offset").collect()] == sequential(SAMPLE, mode)
    assert L.header_indices(spark, str(path)) == (1, 2)


XML = """<classification xmlns="urn:x">{}</classification>"""
FLAT = XML.format('<classification-item level="section" symbol="H"><title lang="en">ELECTRICITY</title></classification-item><classification-item symbol="H01L0021306500" parent="H01L21/00"><title lang="en">ETCH  ING</title></classification-item>')
TREE = XML.format('<ipcEntry kind="s" symbol="H"><ipcEntry kind="c" symbol="H01"><textBody><title><titlePart><text>BASIC</text></titlePart></title></textBody><ipcEntry kind="x" symbol="H02"/></ipcEntry></ipcEntry>')


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "."), body)
    return buffer.getvalue()


def test_schemes():
    rows = {r["ipc_code"]: r for r in D.scheme_rows(zipped(EN_ipc_scheme_x__xml=FLAT))}
    assert rows["H"]["title_en"] == "ELECTRICITY" and rows["H01L21/3065"] == {"ipc_code": "H01L21/3065", "ipc_level": "subgroup", "parent_code": "H01L21/00", "title_en": "ETCH ING", "source_symbol": rows["H01L21/3065"]["source_symbol"], "source_kind": "subgroup"}
    rows = {r["ipc_code"]: r for r in D.scheme_rows(zipped(only__xml=TREE))}
    assert rows["H01"]["parent_code"] == "H" and rows["H01"]["title_en"] == "BASIC" and "H02" not in rows
    with pytest.raises(FileNotFoundError):
        D.zip_member(zipped(a__xml="", b__xml=""), "c")


def test_lists_and_concordance():
    assert D.valid_symbols(zipped(v__xml='<a><IpcSymbol symbol="H01L0021306500"/><ipcSymbol symbol="zz"/></a>')) == [{"ipc_code": "H01L21/3065"}]
    assert D.title_list(zipped(t__txt="H\tELECTRICITY\nno tab\nH01L0021306500\tPLASMA\tETCHING\n")) == [{"ipc_code": "H", "title": "ELECTRICITY"}, {"ipc_code": "H01L21/3065", "title": "PLASMA ETCHING"}]
    xml = '<l from-version="2025.01" to-version="2026.01"><concordance from-symbol="A01B1/00"><concordance-to to-symbol="A01B3/00" modification="m"/><concordance-to to-symbol="A01B5/00"/></concordance></l>'
    assert [(r["from_code"], r["to_code"], r["modification"]) for r in D.concordance(zipped(c__xml=xml))] == [("A01B1/00", "A01B3/00", "m"), ("A01B1/00", "A01B5/00", None)]


def test_wrapped_titles():
    text = "版H部\nH H部——电学\nH01 基本电气元件......12\n12\n第 3 页\nH01L 半导体\n器件\n附注\nignored\nH01L21/00制造\nH01L21/3065\n更具体\n技术\n[2026.01]\nH something\n"
    got = {r["ipc_code"]: r["title"] for r in D.wrapped_titles(text)}
    assert got == {"H": "电学", "H01": "基本电气元件", "H01L": "半导体 器件", "H01L21/00": "制造", "H01L21/3065": "更具体 技术 H something"}


def test_sources_in_spark(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(EN_ipc_scheme_x__xml=FLAT))
    assert D.read_dictionary_source(spark, str(tmp_path), "scheme").count() == 2
    assert len(D.source_hashes(spark, str(tmp_path)).first().sha256) == 64
    (tmp_path / "m.tsv").write_text("CN1\tNA\n")
    assert tuple(D.read_industry_map(spark, str(tmp_path / "m.tsv")).first()) == ("CN1", "NA")
    entry = D.fetch("u", tmp_path / "d" / "f.bin", opener=lambda url: io.BytesIO(b"abc"))
    assert entry["bytes"] == 3 and not entry["reused"] and D.fetch("u", tmp_path / "d" / "f.bin")["reused"]


def test_sinks(spark, tmp_path):
    df = spark.sql("select 'a' k, date'2020-05-01' application_date union all select 'b', null")
    sinks.write_by_year(df, str(tmp_path / "y"))
    assert {p.name for p in (tmp_path / "y").iterdir() if p.is_dir()} == {"application_year=2020", "application_year=unknown"}
    assert sinks.read_known(spark, str(tmp_path / "y")).count() == 1
    sinks.write_by_quarter(df.withColumn("quarter", F.lit(None).cast("string")), str(tmp_path / "q"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert any(p.read_bytes().startswith("﻿k,".encode()) for p in (tmp_path / "c").glob("*.csv"))
    sinks.write_json(spark, (tmp_path / "m" / "x.json").as_uri(), {"a": 1})
    sinks.write_report(spark, str(tmp_path / "r.md"), "T", {"n": 1}, {"rows": df})
    assert "| a |" in Path(tmp_path / "r.md").read_text()
    assert sinks.fingerprint(spark, str(tmp_path / "m"))["files"] == 1


def test_report_has_every_row(spark):
    from lodestrata.sources.sinks import markdown_table

    assert markdown_table(spark.range(60).orderBy("id")).endswith("| 59 |")


def test_small_files_on_any_file_system(spark, tmp_path):
    from lodestrata.session import read_bytes, write_bytes

    for path in (str(tmp_path / "a" / "x.json"), (tmp_path / "b" / "x.json").as_uri()):
        assert read_bytes(spark, path) is None
        write_bytes(spark, path, b"1")
        write_bytes(spark, path, "\u6587".encode())
        assert read_bytes(spark, path).decode() == "\u6587"


def test_no_local_folder_off_local_mode():
    from types import SimpleNamespace as N

    from lodestrata.session import shared_dir

    fake = lambda master, named: N(sparkContext=N(master=master, getConf=lambda: {"spark.checkpoint.dir": named}))
    with pytest.raises(RuntimeError):
        shared_dir(fake("spark://host:7077", None))
    assert shared_dir(fake("spark://host:7077", "s3://b/c/")) == "s3://b/c" and shared_dir(fake("local[2]", None)).startswith("file:")


def test_titles_of_merged_dictionary(spark):
    from lodestrata.operators import audits

    scheme = spark.createDataFrame([("s.zip", 0, "h", "H01L", "subclass", "H01", "OWN", "H01L", "u"), ("s.zip", 1, "h", "H01M", "subclass", "H01", "", "H01M", "u"), ("s.zip", 2, "h", "H01L3/00", "main_group", "H01L", None, "x", "m")], audits.SCHEME)
    titles = spark.createDataFrame([("t", 0, "h", "H01L", "LIST"), ("t", 1, "h", "H01M", "LIST"), ("t", 2, "h", "H01M", "LAST")], audits.TITLES)
    zh = spark.createDataFrame([("b.pdf", 0, "hb", "H01L", "much longer"), ("a.pdf", 7, "ha", "H01L", "first"), ("a.pdf", 8, "ha", "H01L", "second")], audits.TITLES)
    got = {r.code: r for r in audits.merge_dictionary(scheme, spark.createDataFrame([("H01L",)], "ipc_code string"), titles, zh, "2026.01").collect()}
    a, b, c = got["H01L"], got["H01M"], got["H01L3/00"]
    assert (a.title_en, a.title_zh, a.title_zh_status, a.source_zh, a.source_sha256_zh, a.is_valid, a.level) == ("OWN", "first", "matched", "a.pdf", "ha", True, "subclass")
    assert (b.title_en, b.title_zh, b.title_zh_status, b.is_valid) == ("LAST", None, "missing_source", False) and c.main_group_code == "H01L3/00" and c.title_en is None


def test_body_start_and_pinned_sources(tmp_path):
    pages = ["H\n\u76ee\u5f55\nH01", "x", "A\n", "H \nH01 text"]
    assert D.body_start(pages, "H") == 3 and D.body_start(pages, "G") == 0 and D.body_start(pages, None) == 0
    pins = D.pinned_sources()
    assert len(pins) == 23 and len({p["file"] for p in pins}) == 23 and {p["section"] for p in pins if p["kind"] == "pdf"} == set("ABCDEFGH")
    entries = D.fetch_pinned(tmp_path, opener=lambda url: io.BytesIO(url.encode()))
    assert len(entries) == 23 and (tmp_path / "manifest.json").exists() and all(e["reused"] for e in D.fetch_pinned(tmp_path))
