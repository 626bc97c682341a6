import os
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm import packing as P


def check_plan(histogram, capacity):
    used, seen = Counter(), Counter()
    for length, rank, items, each, start in P.plan_best_fit(histogram, capacity):
        assert rank == seen[length]
        seen[length] += items
        for i in range(items):
            used[start + i // each] += length
    assert {k: v for k, v in seen.items()} == {k: v for k, v in histogram.items() if k > 0 and v > 0}
    assert all(v <= capacity for v in used.values()) and set(used) == set(range(1, len(used) + 1))
    return used


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, b in enumerate(bins) if b + n <= capacity), key=lambda i: capacity - bins[i] - n, default=None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), st.integers(30, 60))
def test_plan_is_best_fit_over_items(histogram, capacity):
    used = check_plan(histogram, capacity)
    assert len(used) == best_fit([n for n, c in histogram.items() for _ in range(c)], capacity)


def test_large_counts_stay_cheap():
    plan = P.plan_best_fit({n: 10_000_000 + n for n in range(1, 2048)}, 2048)
    assert len(plan) < 20_000


def test_pack(spark):
    rng = random.Random(1)
    sizes = [7] * 300 + [rng.randint(0, 200) for _ in range(400)] + [50, 100, 0, None, 12_345]
    lengths = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(3, 7), (3, 7)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 50), (2, 100), (3, 1000), (4, 0), (5, None)], "limit_id int, capacity_tokens int")
    rows = P.pack(lengths, limits).collect()
    for limit, capacity in ((1, 50), (2, 100), (3, 1000)):
        mine = [r for r in rows if r.limit_id == limit]
        fill = defaultdict(int)
        pieces = defaultdict(list)
        for r in mine:
            fill[r.container_id] += r.n_tokens
            pieces[r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
        assert max(fill.values()) <= capacity and set(pieces) == set(range(len(sizes)))
        assert set(fill) == set(range(1, len(fill) + 1))
        assert len(fill) <= 1.02 * sum(fill.values()) / capacity + 1
        assert len(pieces[3]) == 3 and sum(n for _, _, n in pieces[3]) == 21
        for i, n in enumerate(sizes):
            if i == 3:
                continue
            parts = sorted(pieces[i])
            assert sum(p[2] for p in parts) == (n or 0)
            assert len(parts) == 1 if (n or 0) <= capacity else [p[1] for p in parts] == [capacity * k for k in range(len(parts))]
    assert {r.limit_id for r in rows} == {1, 2, 3}


def test_empty(spark):
    limits = spark.createDataFrame([(1, 50)], "limit_id int, capacity_tokens int")
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), limits).count() == 0


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
def test_token_lengths(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in P.token_lengths(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_no_limits(spark):
    lengths = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint")
    assert P.pack(lengths, spark.createDataFrame([(1, None)], "limit_id int, capacity_tokens int")).count() == 0


def test_capacity_does_not_matter(spark):
    rng = random.Random(5)
    lengths = spark.createDataFrame([(i, rng.randint(1, 900_000)) for i in range(300)] + [(900, 2_500_000)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 1_000_000), (2, 700_001)], "limit_id int, capacity_tokens int")
    got = P.audit(P.pack(lengths, limits), lengths, limits).collect()
    assert len(got) == 2 and all((r.n_documents, r.missing, r.overfull, r.cut_short, r.broken) == (301, 0, 0, 0, 0) for r in got)


def test_slots_join_gives_one_row_per_item(spark):
    lengths = spark.createDataFrame([(i, 1 + i % 97) for i in range(5000)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 97)], "limit_id int, capacity_tokens int")
    packed = P.pack(lengths, limits)
    assert packed.count() == 5000 and P.audit(packed, lengths, limits).first().tight
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "from_rank" not in plan


def test_audit_sees_faults(spark):
    lengths = spark.createDataFrame([(1, 5), (2, 12), (3, 4)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 10)], "limit_id int, capacity_tokens int")
    bad = spark.createDataFrame([(1, 10, 1, 1, 1, 0, 2), (1, 10, 1, 1, 2, 2, 3), (1, 10, 1, 2, 1, 0, 10), (1, 10, 2, 2, 2, 10, 1)], P._PACKED)
    r = P.audit(bad, lengths, limits).first()
    assert (r.n_documents, r.missing, r.overfull, r.cut_short, r.broken) == (2, 1, 1, 1, 2)


def test_vocabulary_from_any_file_system(spark, tmp_path):
    import base64

    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    for path in (str(tmp_path / "v"), (tmp_path / "v").as_uri()):
        assert P.token_lengths(docs, path).first().n_tokens == 3
    with pytest.raises(FileNotFoundError):
        P.token_lengths(docs, str(tmp_path / "w"))
