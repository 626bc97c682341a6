import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import name_parts as P
from lodestrata.llm import names as N
from lodestrata.llm.name_lexicon import learn_lexicon

LEX = P.Lexicon(
    ["霖江", "琅浦", "沁阳港"], ["新能源", "半导体", "食品", "信息技术"], forms={"半導體": "半导体", "集团食品": "食品"}, legal=["股份有限公司", "有限责任公司", "有限公司", "股份公司", "公司", "有限"], opening=["st"], stem_sizes=[4],
    latin={
        "med": ("line", "medical"), "dev": ("line", "medical"), "optics": ("line", "optics"), "energy": ("line", "power"), "power": ("line", "power"), "instr": ("line", "instruments"), "instruments": ("line", "instruments"),
        "gmbh": ("legal", "gmbh"), "corp": ("legal", "corporation"), "ag": ("legal", "ag"), "inc": ("legal", "inc"), "incorporated": ("legal", "inc"), "the": ("none", "the"), "and": ("none", "and"),
        "robert": ("given", "robert"), "bob": ("given", "robert"), "alexander": ("given", "alexander"), "michael": ("given", "michael"),
    },
)


@pytest.mark.parametrize(
    "name, want",
    [
        ("霖江市丰骏光睿半导体有限公司", ("zh", "丰骏光睿", "霖江", "半导体")), ("丰骏光睿（霖江）半導體股份公司", ("zh", "丰骏光睿", "霖江", "半导体")), ("有限公司：霖江丰骏光睿半导体", ("zh", "丰骏光睿", "霖江", "半导体")),
        ("霖江半导体公司丰骏光睿", ("zh", "丰骏光睿", "霖江", "半导体")), ("丰骏光睿集团食品公司", ("zh", "丰骏光睿", "", "食品")), ("*ST丰骏光睿", ("zh", "丰骏光睿", "", "")), ("霖 江丰骏光睿信息术技(有限)", ("zh", "丰骏光睿", "霖江", "信息技术")),
        ("The Zadisebonür Med. Dev. G.m.b.H.", ("latin", "zadisebonur", "medical", "gmbh")), ("Corp. Bemunizebul Optics", ("latin", "bemunizebul", "optics", "corporation")), ("Bevusomurux", ("latin", "bevusomurux", "", "")),
        ("Gazalapupix Enerrgy & Power AG", ("latin", "gazalapupix", "power", "ag")), ("Robert V. Relenifosux", ("person", "relenifosux", "robert", "v")), ("Zakituvikux, Alexander K.", ("person", "zakituvikux", "alexander", "k")),
        ("ＶＵＰＩＶＡＶＥＦＥＸ ＢＯＢ", ("person", "vupivavefex", "robert", "")), ("R. Tagubogesun", ("person", "tagubogesun", "r", "")), (None, None), ("", None), ("--", None),
    ],
)
def test_parse(name, want):
    assert P.parse_name(name, LEX) == want


def slow(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, d(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return d(len(a), len(b))


words = st.text(alphabet="abc", max_size=6)


@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert P.damerau(a, b, 9) == slow(a, b) == P.damerau(b, a, 9)
    assert P.damerau(a, c, 20) <= P.damerau(a, b, 20) + P.damerau(b, c, 20)
    assert P.damerau(a, b, 20) <= N._distance(a, b) <= 2 * P.damerau(a, b, 20)


@given(words, words, st.integers(1, 2))
def test_near_strings_share_a_variant(a, b, r):
    if len(a) > r and len(b) > r and P.damerau(a, b, 9) <= r:
        assert N.deletions(a, r) & N.deletions(b, r)


def random_strings(spark, n=120, seed=2):
    rng = random.Random(seed)
    strings = [(f"{i:03}", rng.choice("\ue000\ue001\ue002") * N.CODE, "".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))), 1) for i in range(n)]
    return strings, spark.createDataFrame(strings, "sid string, code string, stem string, radius int")


def test_radius_join_is_exact(spark):
    strings, df = random_strings(spark)
    got = {(r.sid_a, r.sid_b): r.d for r in N.radius_pairs(df).collect()}
    want = {(x[0], y[0]): P.damerau(x[2], y[2]) for x, y in itertools.combinations(strings, 2) if x[1] == y[1] and P.damerau(x[2], y[2]) <= 1}
    assert got == want and want
    assert N.radius_pairs(df.limit(0)).count() == 0


def test_cells_cut_candidates(spark):
    _, df = random_strings(spark, 300, 3)
    placed = N.cells_of(df)
    with_cells = N.candidate_pairs(placed).count()
    one_cell = placed.withColumn("home", F.lit(0)).withColumn("cells", F.array(F.lit(0)))
    without = N.candidate_pairs(one_cell).count()
    copies = placed.agg(F.sum(F.size("cells"))).first()[0]
    assert placed.select("home").distinct().count() >= 3 and with_cells < 0.5 * without and copies < 2.5 * placed.count()


def test_long_chains_end_in_one_root(spark):
    for length in (2, 10, 37):
        nodes = spark.createDataFrame([(f"n{i:02}", "", "", 1 + i) for i in range(length)], "nid string, a string, b string, n bigint")
        edges = spark.createDataFrame([e for i in range(length - 1) for e in ((f"n{i:02}", f"n{i + 1:02}"), (f"n{i + 1:02}", f"n{i:02}"))], "u string, v string")
        got = {r.nid: r.entity for r in N._gather(nodes, edges).collect()}
        assert all(got[e] == e for e in got.values()) and len(got) == length
        assert len(set(got.values())) == (2 if length == 2 else 1) - (length == 2)


def test_linking(spark):
    entities = [
        ["霖江丰骏光睿半导体有限公司", "丰骏光睿(霖江)半導體公司", "霖江丰骏光睿", "丰骏光睿半导体", "霖江丰骏睿半导体有限公司", "霖江丰骏光睿半导体有限公司", "霖江骏丰光睿半导体公司"],
        ["琅浦丰骏光睿半导体有限公司"], ["霖江丰骏光睿食品有限公司", "霖江丰骏光睿食品公司"], ["Veforöbopun Instr. Inc.", "VEFORÖBOPUN INSTRUMENTS INCORPORATED", "Veforbopun Instruments Inc"], ["Veforöbopun Optics AG"],
        ["Robert V. Relenifosux", "Bob Relenifosux", "Relenifosux, R. V."], ["Michael V. Relenifosux", "M. Relenifosux"],
    ]
    rows, truth, n = [], {}, 0
    for e, group in enumerate(entities):
        for name in group:
            rows.append(("applicant", n, name))
            truth[n] = e
            n += 1
    rows += [("applicant", 90, None), ("applicant", 91, " "), ("company", 5, "霖江丰骏光睿半导体有限公司")]
    df = spark.createDataFrame(rows, "space string, name_id bigint, name string")
    linked = N.linked_names(df, LEX)
    pairs = {(r.name_id_a, r.name_id_b) for r in N.name_pairs(linked).collect()}
    # "霖江丰骏光睿" and "丰骏光睿半导体" each fit two entities and stay apart from both; they fit each other
    ambiguous = {2, 3}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b] and not {a, b} & ambiguous} | {(2, 3)}
    assert pairs == want
    assert {r.space for r in linked.collect()} == {"applicant", "company"} and linked.count() == n + 1


def test_empty(spark):
    df = spark.createDataFrame([], "space string, name_id bigint, name string")
    assert N.linked_names(df, LEX).count() == 0


def typed_names(n=60, seed=9):
    """Invented names of a made-up trade: towns, lines and legal forms that occur nowhere else."""
    rng = random.Random(seed)
    towns, lines, short = ["甲都", "乙津"], ["织造", "船舶修理", "灯具"], {"船舶修理": "船修"}
    chars = [chr(c) for c in range(0x6000, 0x6100)]
    firms = [(f"{rng.choice(towns)}", "".join(rng.sample(chars, 3)), rng.choice(lines)) for _ in range(n)]
    zh = []
    for town, stem, line in firms:
        zh += [f"{town}{stem}{line}合作社", f"{town}{stem}{line}联合社", f"{stem}（{town}）{short.get(line, line)}合作社"]
    word = lambda k: "".join(rng.choice("abdefghiklmnoprstuvz") for _ in range(k))
    latin, forms = [], {"oy": "osakeyhtio", "as": "aksjeselskap"}
    trades = {"fishery": "fish", "brewing": "brew", "tanning": "tann"}
    for _ in range(n):
        stem, trade, form = word(10), rng.choice(list(trades)), rng.choice(list(forms))
        latin += [f"{stem} {trade} {form}", f"{stem} {trades[trade]} {form}", f"{stem} {trade} {forms[form]}", f"{stem} {trade}"]
    given = {"gunnar": "gunni", "ingrid": "inga"}
    for _ in range(n):
        surname, first = word(9), rng.choice(list(given))
        latin += [f"{first} q. {surname}", f"{given[first]} {surname}", f"{first} {surname}"]
    return firms, zh + latin


def test_lexicon_is_learned_from_the_names(spark):
    firms, names = typed_names()
    register = spark.createDataFrame([(t + s + line + "合作社", s, line) for t, s, line in firms], "full_name string, short_name string, industry string")
    lex = learn_lexicon(spark.createDataFrame([(x,) for x in [*names, None, "", "--"]], "name string"), register)
    assert lex.towns == ["乙津", "甲都"] and set(lex.business) == {"织造", "船舶修理", "灯具"} and lex.stem_sizes == [3]
    assert {"合作社", "联合社"} <= set(lex.legal) and lex.forms.get("船修") == "船舶修理"
    same = lambda a, b, slot: lex.latin[a] == lex.latin[b] and lex.latin[a][0] == slot
    assert same("fishery", "fish", "line") and same("brewing", "brew", "line") and same("oy", "osakeyhtio", "legal") and same("as", "aksjeselskap", "legal")
    assert same("gunnar", "gunni", "given") and same("ingrid", "inga", "given") and lex.latin["gunnar"] != lex.latin["ingrid"] and lex.latin["fishery"] != lex.latin["brewing"]


def test_linking_with_a_learned_lexicon(spark):
    firms, names = typed_names()
    register = spark.createDataFrame([(t + s + line + "合作社", s, line) for t, s, line in firms], "full_name string, short_name string, industry string")
    frame = spark.createDataFrame([("x", i, n) for i, n in enumerate(names)], "space string, name_id bigint, name string")
    got = {(r.name_id_a, r.name_id_b) for r in N.name_pairs(N.linked_names(frame, learn_lexicon(frame, register))).collect()}
    starts = [*range(0, 180, 3), *range(180, 420, 4), *range(420, len(names), 3)]
    want = {p for a, b in zip(starts, [*starts[1:], len(names)]) for p in itertools.combinations(range(a, b), 2)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(got)


def test_lexicon_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    lex = learn_lexicon(none, spark.createDataFrame([], "full_name string, short_name string, industry string"))
    assert lex == P.Lexicon([], []) and P.parse_name("甲乙丙丁公司", lex) == ("zh", "甲乙丙丁公司", "", "") and P.parse_name("a", lex)[0] == "latin"
