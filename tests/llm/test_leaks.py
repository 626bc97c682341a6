import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import leaks as L


def edit_substring(pattern, text):
    """Least edits between the pattern and any substring of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def brute(item, text, least):
    n = len(item)
    for length in range(min(least, n), n + 1):
        for a in range(n - length + 1):
            if edit_substring(item[a : a + length], text) <= length // 10:
                return True
    return False


@given(st.text(alphabet="abc", min_size=12, max_size=30), st.text(alphabet="abc", max_size=40), st.integers(4, 12), st.integers(0, 3))
def test_lanes_are_exact(item, text, length, budget):
    lanes = L.Lanes(item, length)
    want = any(edit_substring(item[a : a + length], text) <= budget for a in range(len(item) - length + 1))
    assert lanes.within(text, budget) == want


def mutate(rng, symbols, edits, alphabet):
    out = list(symbols)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice(alphabet)
        elif kind == 1:
            out.insert(i, rng.choice(alphabet))
        else:
            del out[i]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_search_agrees_with_brute_force(seed):
    rng = random.Random(seed)
    han = "金木水火土日月山石田心手足口目耳"
    item = "".join(rng.choice(han) for _ in range(rng.choice([20, 45, 75])))
    start = rng.randrange(0, max(1, len(item) - 38))
    passage = mutate(rng, item[start : start + rng.randint(30, 60)], rng.randint(0, 7), han)
    text = "".join(rng.choice(han) for _ in range(20)) + "".join(passage) + "".join(rng.choice(han) for _ in range(20))
    found = bool(L.Searcher([(1, "zh", item)]).leaked(text))
    assert found == brute(item, text, L.MIN_CHARS)
    vocabulary = [f"w{i}" for i in range(12)]
    words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 18, 34]))]
    body = [rng.choice(vocabulary) for _ in range(9)] + mutate(rng, words[rng.randrange(0, 3) :], rng.randint(0, 4), vocabulary) + [rng.choice(vocabulary) for _ in range(9)]
    found = bool(L.Searcher([(2, "en", " ".join(words))]).leaked(" ".join(body)))
    assert found == brute(words, body, L.MIN_WORDS)


ZH = "合议组查明权重厚169毫米附图9示出海藻酸钠制主路该非接触受电弓售出32台雨彦霜厂主张优先权日为2006年8月"
EN = "the board finds a pin of 80 mm and paragraph twelve gives an epoxy to gallium nitride ratio of 68 in total"


def test_forms_and_edges(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ZH)
    docs = spark.createDataFrame([
        (1, "前言。" + "，".join([ZH[:10], ZH[10:30], ZH[30:]])), (2, wide), (3, EN.upper().replace(" ", " -\n ")), (4, ZH[:30]), (5, None), (6, ""), (7, "x " * 200_000 + EN), (8, " ".join(EN.split()[:12])), (9, ZH + EN), (1, ZH),
    ], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "zh", ZH), (11, "en", EN), (12, "en", None), (13, "zh", "。"), (14, None, EN)], "item_id bigint, lang string, item_text string")
    got = sorted(map(tuple, L.find_leaks(docs, items).collect()))
    assert got == [(1, 10), (1, 10), (2, 10), (3, 11), (3, 14), (7, 11), (7, 14), (9, 10), (9, 11), (9, 14)]
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ZH + EN)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "zh", ZH), (11, "en", EN)], "item_id bigint, lang string, item_text string")
    monkeypatch.setattr(L, "MAX_BLOCK_SYMBOLS", 10)
    assert sorted(map(tuple, L.find_leaks(docs, items).collect())) == [(1, 10), (1, 11)]
