"""Targets by repeated sharing, permutations, and mixes on known sources."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellframe.llm import mixing, queries
from swellframe.sources.workspace import written


def brute_targets(sizes, weights):
    """Shares by weight; what is above twice the size is shared again among the others."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = 1.5 * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = {i for i in open_ if share[i] >= 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        open_ -= full
    return target


PICK = random.Random(5)
SIZES = {
    "one": [7], "zero": [0], "zeros": [0, 0, 0, 0], "equal": [10] * 7, "one hot": [1, 100_000, 3, 0, 50],
    "small first": [1, 1, 1, 10_000], "many": [int(10 ** PICK.uniform(0, 6)) for _ in range(400)],
    "ties": [PICK.choice([0, 5, 10, 25]) for _ in range(60)],
}


@pytest.mark.parametrize("name", SIZES)
def test_targets(spark, name):
    sizes = SIZES[name]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    rows = [(i, size, float(weight)) for i, (size, weight) in enumerate(zip(sizes, weights, strict=True))]
    table = spark.createDataFrame(rows, "rank long, source_size long, weight double").repartition(3)
    got = {r["rank"]: r.target for r in mixing.with_targets(table).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(sizes))], brute_targets(sizes, weights), rtol=1e-9, atol=1e-6)


def test_prefix_sums(spark):
    rows = [(PICK.randrange(10**6), PICK.randrange(100), i) for i in range(500)]
    table = spark.createDataFrame(rows, "key long, n long, tie long").repartition(7)
    got = mixing.prefix_sums(table, [F.col("key").desc(), F.col("tie")], {"n": "before"}).collect()
    before, sums = 0, {}
    for _, n, tie in sorted(rows, key=lambda row: (-row[0], row[2])):
        sums[tie] = before
        before += n
    assert {r.tie: r.before for r in got} == sums


@pytest.mark.parametrize("groups", [1, 2, 7, 5000])
def test_group_quotas(spark, monkeypatch, groups):
    """Quotas are whole, follow each other, and differ by one slot at most within a source."""
    monkeypatch.setattr(mixing, "LISTED_GROUPS", 64)
    plan = spark.createDataFrame(
        [(rank, 9, slots) for rank, slots in enumerate([0, 1, 1, 2, 6, 7, 8, 500, 12_345])],
        "rank long, n_blocks long, n_slots long",
    )
    rows = mixing.group_quotas(plan, groups).collect()
    assert len({(r.group, r["rank"]) for r in rows}) == len(rows)
    for rank, slots in enumerate(r.n_slots for r in plan.collect()):
        own = sorted((r.group, r["first"], r.quota) for r in rows if r["rank"] == rank)
        place = 0
        for group, first, quota in own:
            assert 0 <= group < groups and first == place and quota in (slots // groups, -(-slots // groups))
            place += quota
        assert place == slots and all(quota for _, _, quota in own)


def test_groups_are_drawn_by_tasks_of_their_own(spark):
    plan = spark.createDataFrame([(0, 900_000, 900_000)], "rank long, n_blocks long, n_slots long")
    slots = mixing.drawn_slots(plan)
    groups = -(-900_000 // (mixing.SHARD_SLOTS * mixing.GROUP_SHARDS))
    tasks = slots.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 900_000 and len(tasks) > groups // 3


def test_as_many_sources_as_documents(spark):
    """Small sources each, one hot one: the mix is whole, and nothing of the size of the sources
    is put into a plan or sent to the driver."""
    n = 30_000
    text = F.when(F.col("id") < 200, F.repeat(F.lit("hot "), 700)).otherwise(F.repeat(F.lit("w "), (1 + F.col("id") % 90).cast("int")))
    source = F.when(F.col("id") >= 200, F.concat(F.lit("host"), "id"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"))
    sized = mixing.stored_sizes(docs)
    plan = mixing.source_plan(sized)
    assert plan.count() == n - 199
    assert "LocalTableScan" not in plan._jdf.queryExecution().toString()
    taken = mixing.taken_words(sized, plan).collect()
    assert len(taken) == n and all(r.taken <= 2 * r["size"] for r in taken)
    total = sum(r["size"] for r in taken)
    assert sum(r.taken for r in taken) == pytest.approx(1.5 * total, rel=0.05)
    hot = [r for r in taken if r.doc_id < 200]
    assert sum(r.taken for r in hot) == pytest.approx(hot[0].target, abs=mixing.BLOCK_WORDS)
    per_group = mixing.group_quotas(plan, 60).groupBy("group").agg(F.sum("quota").alias("n")).collect()
    assert max(r.n for r in per_group) < 1.5 * min(r.n for r in per_group)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    if n > 100:
        assert (mixing.permuted(np.arange(n), n, 5) != mixing.permuted(np.arange(n), n, 6)).any()


def test_shard_counts():
    quota = np.array([5000, 300, 0, 7])
    counts = list(mixing.shard_counts(quota, 256, np.random.default_rng(1)))
    assert (sum(counts) == quota).all() and all(c.sum() == 256 for c in counts[:-1])
    assert len({int(c[1]) for c in counts}) > 3


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = queries.table(spark, sf_dir, "documents").collect()
    rows = {r.doc_id: r for r in queries.op2_mix_sources(spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    sizes, taken = Counter(), Counter()
    for doc in documents:
        row = rows[doc.doc_id]
        assert row["size"] == words(doc.text) and 0 <= row.taken <= 2 * row["size"]
        sizes[doc.source] += row["size"]
        taken[doc.source] += row.taken
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    expected = brute_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    by_name = dict(zip(names, expected, strict=True))
    for doc in documents:
        row = rows[doc.doc_id]
        assert row.source_size == sizes[doc.source]
        assert row.target == pytest.approx(by_name[doc.source])
    for name, target in by_name.items():
        assert abs(taken[name] - target) <= mixing.BLOCK_WORDS + 0.005 * target
    again = queries.op2_mix_sources(spark, sf_dir).collect()
    assert {r.doc_id: r.taken for r in again} == {i: r.taken for i, r in rows.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string"
ROWS = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (None, "w " * 500, "en", "a", 1000, "x"),
    (3, " ".join(f"v{i}" for i in range(900)) + " \n", None, None, 0, "x"),
    (4, "one two\tthree", "en", "b", 1, None), (4, "one two\tthree", "en", "b", 1, None),
    (5, " ".join(f"u{i}" for i in range(3000)), "en", "c", 1, None), (6, None, None, "empty", 0, None),
]


def test_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sized = mixing.stored_sizes(df)
    plan = mixing.source_plan(sized)
    got = mixing.taken_words(sized, plan).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    spread = mixing.stored_sizes(df.repartition(5))
    again = mixing.taken_words(spread, mixing.source_plan(spread)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    empty = mixing.stored_sizes(df.limit(0))
    assert mixing.taken_words(empty, mixing.source_plan(empty)).collect() == []
    # The mix itself: every piece lies in its document, and a slot holds one block.
    pieces = mixing.mixture(sized, plan).collect()
    by_row = {r.row: r["size"] for r in sized.collect()}
    assert all(0 <= p.first_word and p.first_word + p.n_words <= by_row[p.row] for p in pieces)
    slots = Counter()
    for piece in pieces:
        slots[piece.shard, piece.slot] += piece.n_words
    assert max(slots.values()) <= mixing.BLOCK_WORDS


def test_mixed_documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    keyed = written(df, "mix-test")
    out = mixing.mixed_documents(keyed)
    assert out.columns == df.columns
    rows = out.collect()
    sized = mixing.stored_sizes(keyed)
    taken = Counter()
    for r in mixing.taken_words(sized, mixing.source_plan(sized)).collect():
        taken[r.doc_id] += r.taken
    assert +Counter({i: sum(words(r.text) for r in rows if r.doc_id == i) for i in taken}) == +taken
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_runs_and_spans():
    assert mixing.runs([(1, 0, 4), (0, 4, 4), (0, 0, 4), (0, 9, 1)]) == [(0, 0, 8), (0, 9, 1), (1, 0, 4)]
    assert mixing.span_text(" a  b\nc ", 1, 2) == "b\nc"
    assert mixing.span_text(" a  b\nc ", 0, 3) == " a  b\nc "
