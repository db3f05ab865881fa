"""Linked documents against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import connection, differences

from swellframe.llm import graph, jaccard, queries
from swellframe.llm.wanted import parted

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        out = out.replace(space, " ")
    return [w for w in out.split(" ") if w]


def set_of(text, n):
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, link):
    sets = [set_of(text, link.words) for _, text in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and link.den * shared >= link.num * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return sorted((str(key), len(sets[i]), str(smallest.get(find(i)))) for i, (key, _) in enumerate(rows))


def found(spark, rows, link):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")
    out = jaccard.similar_documents(df, link).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out)


def family(rng, words, copies, changes):
    """Copies of a text, each with some words changed, some in the same places."""
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = [" ".join(base)] * 2
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(50)}"
        out.append(" ".join(text[: words - rng.randrange(2)]))
    return out[1:] if rng.random() < 0.5 else out


@pytest.mark.parametrize(("link", "seed"), [(queries.WORD_TRIPLES, 1), (jaccard.Link(), 2)])
def test_families(spark, monkeypatch, link, seed):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "LIST_SETS", 16)
    monkeypatch.setattr(jaccard, "LEADER_ROWS", 8)
    rng = random.Random(seed)
    texts = []
    for words in (1, 2, 3, 6, 8, 10, 14, 20, 33, 60, 120, 400):
        for _ in range(3):
            texts += family(rng, words, rng.randrange(1, 14), max(1, words // 12))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (3, 5, 8, 30, 60) * 4]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows, link) == brute(rows, link)


def test_edge_rows(spark):
    rows = [
        (5, None), (6, ""), (7, " \n\t"), (8, "A b"), (3, "a\tB"), (9, "a b c"), (9, "a b c"), (None, "A B C"),
        (None, "\xa0 z"), (10, "Ä b c"), (11, "ä b c"), (12, "lone " * 3000), (13, "q" * 200_000),
    ]
    for link in (queries.WORD_TRIPLES, jaccard.Link()):
        assert found(spark, rows, link) == brute(rows, link)
    assert found(spark, [(None, "only"), (None, "only")], jaccard.Link()) == [("None", 1, "None")] * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(df).collect() == []


def test_query_equals_sql(spark):
    rows = queries.op4_jaccard_join(spark, SF_DIR)
    assert differences(rows, connection(SF_DIR), queries.CHECK_OP4) == []


@pytest.mark.parametrize("link", [queries.WORD_TRIPLES, jaccard.Link(), jaccard.Link(1, 50, 100)])
def test_linked_sets_share_a_list(link):
    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 75, 300, 2000]:
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            apart = int(rng.integers(0, 2 + len(base) // 3))
            other = np.union1d(
                rng.permutation(base)[int(rng.integers(0, apart + 1)) :],
                rng.integers(0, 1 << 64, int(rng.integers(0, apart + 1)), dtype=np.uint64),
            )
            shared = len(np.intersect1d(base, other))
            if shared and link.linked(shared, len(base), len(other)) and shared < max(len(base), len(other)):
                lists = set(jaccard.signatures(link, base).tolist())
                assert lists & set(jaccard.signatures(link, other).tolist())
                sketches = [(len(x), jaccard.sketch(link, x)) for x in (base, other)]
                assert jaccard.may_link(link, *sketches[0], *sketches[1])
                assert all(1 in mates for _, mates in jaccard.sketch_links(link, sketches[:1], sketches))


def test_block_links():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    sets = []
    for i in range(40):
        keep = base[rng.random(len(base)) > 0.004 * i]
        sets.append(np.union1d(keep, rng.integers(0, 1 << 64, i // 3, dtype=np.uint64)))
    link = jaccard.Link()
    for i, mates in jaccard.block_links(link, sets[:25], sets[10:]):
        shared = [len(np.intersect1d(sets[i], other)) for other in sets[10:]]
        expected = [j for j, n in enumerate(shared) if link.linked(n, len(sets[i]), len(sets[10 + j]))]
        assert mates.tolist() == expected


def joined(count, pairs):
    """For each number below ``count`` the smallest one that the pairs join it with."""
    label = list(range(count))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(count)]


def near_copies(rng, size, copies, changes):
    base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
    sets = []
    for _ in range(copies):
        n = int(rng.integers(1, changes + 1))
        sets.append(np.union1d(rng.permutation(base)[n:], rng.integers(0, 1 << 64, n, dtype=np.uint64)))
    return sets


@pytest.mark.parametrize("link", [queries.WORD_TRIPLES, jaccard.Link()])
def test_sketch_families(link):
    rng = np.random.default_rng(8)
    sets = [x for size in (12, 90, 115, 118, 300) for x in near_copies(rng, size, 12, size // 3)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    sketches = [(len(x), jaccard.sketch(link, x)) for x in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.may_link(link, *sketches[i], *sketches[j])]
    assert joined(len(sets), enumerate(jaccard.sketch_families(link, sketches).tolist())) == joined(len(sets), pairs)


def test_near_copies_are_not_compared_in_pairs(monkeypatch):
    """The comparisons of a large group of near copies grow with its members, not their pairs."""
    link, rng = queries.WORD_TRIPLES, np.random.default_rng(9)
    rows = [
        {"class": i, "label": i, "list": 1, "block": 0, "size": len(x), "data": jaccard.sketch(link, x)}
        for i, x in enumerate(near_copies(rng, 200, 1500, 12))
    ]
    compared, mates = [], jaccard.Sketches.mates

    def counted(self, size, data):
        compared.append(sum(len(at) for at, _ in self.groups.values()))
        return mates(self, size, data)

    monkeypatch.setattr(jaccard.Sketches, "mates", counted)
    edges = jaccard.block_sketch_edges(link, rows, rows)
    assert joined(1500, edges) == [0] * 1500
    assert len(edges) == 1499
    assert sum(compared) < 20 * 1500


@pytest.mark.parametrize("link", [queries.WORD_TRIPLES, jaccard.Link()])
def test_set_edges(link):
    rng = np.random.default_rng(10)
    sets = near_copies(rng, 150, 60, 30) + near_copies(rng, 150, 60, 30)
    labels = rng.integers(0, 60, len(sets)).tolist()
    rows = [
        {"class": i, "label": label, "size": len(x), "data": jaccard.set_bytes(link, x)}
        for i, (label, x) in enumerate(zip(labels, sets, strict=True))
    ]
    for left, right in [(rows, rows), (rows[:50], rows[50:])]:
        linked = [
            (a["label"], b["label"])
            for a in left
            for b in right
            if link.linked(len(np.intersect1d(sets[a["class"]], sets[b["class"]])), a["size"], b["size"])
        ]
        edges = jaccard.set_edges(link, left, right)
        assert joined(60, [(labels[a], labels[b]) for a, b in edges]) == joined(60, linked)
        assert len(edges) < 60


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(900, i) for i in range(901, 960)] + [(5, 5)]
    out = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    assert {r.node: r.label for r in out} == {x: find(x) for x in list(label)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [
        (4, text, 1), (2, text + " more", 2), (2, text + " more", 2), (None, text + " end", 3), (9, "alone in the corpus", 4),
        (None, "x y", 5), (None, "X Y", 6), (7, None, 7), (8, "", 8), (8, "", 8), (5, "x y z", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    out = [(r.doc_id, r.n_chars) for r in jaccard.one_of_each(df).collect()]
    fixed = [(2, 2), (5, 9), (7, 7), (8, 8), (8, 8), (9, 4)]
    assert sorted(x for x in out if x[0] is not None) == fixed
    assert [x for x in out if x[0] is None] in ([(None, 5)], [(None, 6)])
    assert jaccard.one_of_each(df.limit(0)).collect() == []


def test_one_of_each_on_documents(spark):
    link = jaccard.Link()
    docs = queries.table(spark, SF_DIR, "documents")
    groups = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, link).collect()}
    kept = jaccard.one_of_each(docs, link)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_texts_are_chosen_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(400)], "doc_id long, text string")
    link = jaccard.Link()
    facts = jaccard.set_facts(docs, link).cache()
    some = facts.filter("id % 4 = 0").select("class")
    texts = jaccard.Texts(docs, "text", link, facts.select("class", "source"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = jaccard.wanted_sets(texts, some, jaccard.set_bytes)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(source" in line]
        got = {row["class"] for row in sets.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        facts.unpersist()
    assert {row["class"] for row in some.collect()} <= got
    assert len(got) < 200


@pytest.mark.parametrize("count", [0, 1, 900])
def test_parted_rows_are_whole(spark, count):
    rows = spark.range(3000).selectExpr("id", "xxhash64(id) AS name", "'x' AS _bits")
    names = rows.filter(f"id < {count}").select("name")
    there, rest = parted(rows, rows["name"], names)
    assert there.columns == rest.columns == rows.columns
    there, rest = ([row["id"] for row in part.collect()] for part in (there, rest))
    assert sorted(there + rest) == list(range(3000))
    assert set(range(count)) <= set(there)
    assert len(there) <= count + 400
