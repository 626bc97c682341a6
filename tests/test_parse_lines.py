import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators import parse_lines as P


def line(**fields):
    row = [""] * 31
    row[0], row[16], row[17] = '="001283"', "CN1", "2020-01-02"
    for k, v in fields.items():
        row[int(k[1:])] = v
    return ",".join(row)


def reference(t):
    """Fields of a record by a plain character loop; None: quoting."""
    out, i, n = [], 0, len(t)
    while True:
        if i < n and t[i] == '"':
            j, part = i + 1, []
            while True:
                k = t.find('"', j)
                if k < 0:
                    return None
                part.append(t[j:k])
                if t[k + 1 : k + 2] == '"':
                    part.append('"')
                    j = k + 2
                    continue
                break
            if k + 1 < n and t[k + 1] != ",":
                return None
            out.append("".join(part))
            i = k + 1
        else:
            k = t.find(",", i)
            k = n if k < 0 else k
            out.append(t[i:k])
            i = k
        if i >= n:
            return out
        i += 1


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, raw_text string")
    return {r.row_id: r for r in P.parse_lines(df).collect()}


def test_reasons_in_order(spark):
    cases = {
        "quoting": line(f28='"open'), "column_count": line() + ",x", "stock_code": line(f0="退市"), "application_no": line(f16="N/A"), "application_date": line(f17="2020-02-30"), "abstract": line(f28="bad�"),
        None: line(f28='"a, ""b"" \n c"', f29='x"y'),
    }
    got = parsed(spark, cases.values())
    assert [got[i].fail_reason for i in range(len(cases))] == list(cases)
    sound = got[len(cases) - 1]
    assert sound.abstract == 'a, "b" \n c' and sound.claim == 'x"y' and sound.stkcd_raw == '="001283"' and sound.field_1 == ""


def test_edges(spark):
    got = parsed(spark, [None, "", line(f28="a\nb\r\nc\td"), line(f28="a\x0bb"), line(f28="x" * 300_000), line(f0='"a"b'), line(f28=""), line() + "\n", '"' + line()[1:]])
    assert got[0].fail_reason == "column_count" and got[1].fail_reason == "column_count"
    assert got[2].fail_reason is None and got[2].abstract == "a\nb\r\nc\td"
    assert got[3].fail_reason == "abstract" and got[4].fail_reason is None and len(got[4].abstract) == 300_000
    assert got[5].fail_reason == "quoting" and got[6].abstract == "" and got[7].field_30 == "\n"


def test_byte_order_mark_stays(spark):
    bom = "\ufeff"
    got = parsed(spark, [bom + line(f0="000001"), bom + bom + line(f0="1"), '"' + bom + '1"' + line(f0=""), line(f28=bom + "a"), bom, bom + '"x"' + line(f0="")])
    assert [got[i].stkcd_raw for i in range(4)] == [bom + "000001", bom + bom + "1", bom + "1", '="001283"'] and got[3].abstract == bom + "a"
    assert got[4].fail_reason == "column_count" and got[5].stkcd_raw == bom + '"x"'
    marks = ["\ue00a", "\ue00d", "\ue00e", "\ue00e\ue00ea\n"]
    got = parsed(spark, [line(f28=f"{m}b", f0=f"{m}c") for m in marks])
    assert [(got[i].stkcd_raw, got[i].abstract, got[i].fail_reason) for i in range(4)] == [(f"{m}c", f"{m}b", "stock_code") for m in marks]


def test_corrupt_text_is_kept(spark):
    bad = [line(f28='"open'), line() + ",x", line(f17="2020-02-30"), ",".join("x" * 25_000), '"' + "," * 25_000]
    got = parsed(spark, [*bad, line(f28='"' + "," * 25_000 + '"'), line(f30='"open'), None])
    assert [got[i].corrupt_text for i in range(5)] == bad and got[3].n_fields == 25_000 and got[0].n_fields is None
    assert [got[i].fail_reason for i in range(5)] == ["quoting", "column_count", "application_date", "column_count", "quoting"]
    assert got[5].fail_reason is None and got[5].corrupt_text is None and len(got[5].abstract) == 25_000 and got[6].fail_reason == "quoting"
    out = P.quarantined(spark.createDataFrame([(1, bad[0]), (2, line())], "row_id bigint, raw_text string"), "row_id").collect()
    assert [(r.row_id, r.corrupt_text) for r in out] == [(1, bad[0])]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "row_id bigint, raw_text string")
    assert P.parse_lines(empty).count() == 0 and P.failures(empty, "row_id").count() == 0
    df = spark.createDataFrame([(1, line(), "mine", "other")], "row_id bigint, raw_text string, claim string, fail_reason string")
    row = P.parse_lines(df).first()
    assert row.in_claim == "mine" and row.in_fail_reason == "other" and row.claim == "" and row.fail_reason is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab",\n ﻿', max_size=6), min_size=29, max_size=32), min_size=1, max_size=20), st.booleans())
def test_agrees_with_character_loop(spark, records, quoted):
    texts = []
    for r in records:
        if quoted:
            buffer = io.StringIO()
            csv.writer(buffer, lineterminator="").writerow(r)
            texts.append(buffer.getvalue())
        else:
            texts.append(",".join(r))
    got = parsed(spark, texts)
    for i, t in enumerate(texts):
        want = reference(t)
        if want is None:
            assert got[i].fail_reason == "quoting", t
        elif len(want) != 31:
            assert got[i].fail_reason == "column_count", t
        else:
            assert [got[i][c] for c in P.COLUMNS] == want, t
