import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm import unify as U

run = U.transducer()


@pytest.mark.parametrize(
    "a, b",
    [
        ("ＡＢ１，", "AB1,"), ("⽤⼀度", "用一度"), ("25℃", "25°C"), ("25°С", "25°C"), ("é", "é"), ("е́", "é"), ("e͏́", "é"), ("Ѕоfа", "Sofa"), ("a​b﻿", "ab"), ("a 　 b", "a b"),
        (" a b \n", "a b"), ("㎜", "mm"), ("ё", "ë"), ("µm", "μm"), ("a​ ​ b", "a b"), ("ﬁ", "fi"), ("a  b", "a b"), ("ΖΝΥ", "ZNY"),
    ],
)
def test_same_look(a, b):
    assert run(a) == run(b) == b


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("O", "0"), ("l", "1"), ("m²", "m2"), ("。", "."), ("土", "士"), ("a b", "ab")])
def test_different_look(a, b):
    assert run(a) != run(b)


@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("Аеé́̈​­ 　Ａ⽤℃")), max_size=30))
def test_one_pass_is_a_fixed_point(text):
    once = run(text)
    assert run(once) == once and "  " not in once and once == once.strip(" ")


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        U.Transducer(look_alikes={"А": "a"})
    with pytest.raises(ValueError):
        U.Transducer(look_alikes={"Ж": "Щ", "Щ": "Ч", "Ч": "C"})


def test_pairs_against_all_pairs(spark):
    texts = ["abc", "аbc", "abc", "ab​c", "x", None, "-", "", "ABC", "ａｂｃ", "x", "長" * 50_000, "⾧" * 50_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id bigint, t string, id_a string")
    got = sorted(map(tuple, U.look_alike_pairs(df, "id", "t").collect()))
    valid = [(i, t) for i, t in enumerate(texts) if t not in (None, "-", "")]
    want = [(i, j) for (i, a), (j, b) in itertools.combinations(valid, 2) if a != b and run(a) == run(b)]
    assert got == sorted(want) and len(want) == 10
    assert U.look_alike_pairs(spark.createDataFrame([], "id bigint, t string"), "id", "t").count() == 0


def test_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(U.unified(df.t)).collect()] == [None, ""]


def test_classes_of_a_hot_form(spark):
    from lodestrata.llm import unify as U

    # one form on half of the rows, in three spellings
    rows = [(i, ["ab", "аb", "ab "][i % 3] if i % 2 else f"x{i}") for i in range(600)] + [(900, None), (901, "--")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: r for r in U.look_alike_classes(df, "id", "text").collect()}
    hot = [r for r in got.values() if r.id % 2]
    assert len(got) == 600 and {(r.class_id, r.n_rows, r.n_spellings) for r in hot} == {(1, 300, 3)} and {r.spelling_id for r in hot} == {1, 3, 5}
    assert all((r.class_id, r.n_rows) == (r.id, 1) for r in got.values() if r.id % 2 == 0)
    assert sorted(map(tuple, U.spelling_pairs(df, "id", "text").collect())) == [(1, 3), (1, 5), (3, 5)]
    assert U.look_alike_pairs(df, "id", "text").count() == 3 * 100 * 100
    assert U.look_alike_classes(df.limit(0), "id", "text").count() == 0
