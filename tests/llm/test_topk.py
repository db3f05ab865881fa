"""Top-k against all inner products."""

from __future__ import annotations

import numpy as np
import pytest
from compare import connection, differences
from hypothesis import given, settings, strategies as st

from swellframe.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(queries.op8_top_k(spark, sf_dir), connection(sf_dir), queries.CHECK_OP8) == []


@pytest.mark.parametrize(("chunk", "block"), [(7, 3), (16_384, 2_048)])
def test_edge_rows(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], "x") for i in range(40)]
    same = [(i, [0.5, 0.5, 0.5, 0.5], "x") for i in range(40, 80)]
    odd = [
        (None, [1.0] * 4, "x"), (100, None, "x"), (120, [1.0, None, 1.0, 1.0], "x"),
        (140, [float("nan")] * 4, "x"), (160, [float("inf")] * 4, "x"), (200, [], "x"), (220, [2.0], "x"),
    ]
    df = spark.createDataFrame(vectors + same + odd + same[:1], SCHEMA)
    stored = topk.quantised(df)
    got = topk.top_k(stored, stored.filter("vec_id % 20 = 0"), 5).collect()
    rows = [(r.row, r.vec_id, np.array([*r["values"], 0, 0, 0, 0][:4])) for r in stored.collect()]
    expected = []
    for row, query_id, q in rows:
        if query_id % 20 == 0:
            others = sorted((-int(q @ v), i, r) for r, i, v in rows if r != row)[:5]
            expected += [(query_id, n + 1, i, -s) for n, (s, i, _) in enumerate(others)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], None), (1, [-1.0], None)], SCHEMA)
    stored = topk.quantised(df)
    assert [tuple(r) for r in topk.top_k(stored, stored.filter("vec_id = 0"), 20).collect()] == [(0, 1, 1, -4096)]
    assert topk.top_k(stored, stored.limit(0), 20).collect() == []
    empty = topk.quantised(df.limit(0))
    assert topk.top_k(empty, empty, 20).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 900]), st.sampled_from([1, 1000]))
def test_aggregation(seed, n, scale):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-40, 40, (3, 6)) * scale
    candidates = centre[rng.integers(0, 3, n)] + rng.integers(-3, 4, (n, 6))
    asked, own = candidates[:2], np.array([0, 1])
    q, c, score = topk.aggregate(asked, candidates, own, 5)
    for i in range(2):
        best = sorted((-int(asked[i] @ candidates[j]), j) for j in range(n) if j != i)[:5]
        assert [(-s, j) for s, j in zip(score[q == i], c[q == i], strict=True)] == [(s, j) for s, j in best]
