"""Removed bytes against a table of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from swellframe.llm import queries, repeats, suffixes

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    """Documents in order of id, none last; equal ids in order of their text's fingerprint."""
    bodies = [(key, (text or "").encode()) for key, text in rows]
    order = sorted(
        range(len(bodies)),
        key=lambda i: (bodies[i][0] is None, bodies[i][0] or 0, repeats.fingerprint(bodies[i][1])),
    )
    seen, out = set(), []
    for i in order:
        key, data = bodies[i]
        covered = np.zeros(len(data) + 1, int)
        for s in range(len(data) - repeats.MATCH + 1):
            string = data[s : s + repeats.MATCH]
            if string in seen:
                covered[s] += 1
                covered[s + repeats.MATCH] -= 1
            seen.add(string)
        gone = np.cumsum(covered[:-1]) > 0 if len(data) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0
        out.append((str(key), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    rows = repeats.without_repeats(df).collect()
    for r in rows:
        assert r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").collect()]
    got = queries.op9_suffix_dedup(spark, SF_DIR).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


@pytest.mark.parametrize(("most", "shard"), [(8192, 1 << 20), (3, 4000)])
def test_planted(spark, monkeypatch, most, shard):
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", most)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "GROUP_ROWS", 2 * most)
    rng = random.Random(most)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = letters(150), letters(99)
    texts = [letters(rng.randrange(400)) + passage + letters(rng.randrange(300)) for _ in range(25)]
    texts += [letters(50) + other + letters(50) for _ in range(5)]
    base = letters(900)
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(base[:at] + letters(3) + base[at + rng.randrange(4) :])
    texts += [base, base, letters(120) * 3, "a" * 350, "a" * 170, "ab" * 120, "b" + "a" * 99, "a" * 99, "a" * 100]
    texts += [passage[:100], passage[1:101], None, "", "\x00" * 130, "\x00" * 101 + "é" * 60]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [(None, base), (None, base), (7, passage + base), (7, texts[7]), (7, texts[7]), (3, "z" * 50), (3, "z" * 50)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    assert found(df) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70))
def test_suffix_array_and_prefixes(symbols):
    text = [*symbols, 0]
    array = suffixes.suffix_array(np.array(text))
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = suffixes.permuted_prefixes(np.array(text), array, 4)
    for before, at in zip(array[:-1], array[1:], strict=True):
        shared = 0
        while max(before, at) + shared < len(text) and text[before + shared] == text[at + shared]:
            shared += 1
        assert min(prefixes[at], 4) == min(shared, 4) and prefixes[at] <= shared


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(2)
    string = rng.integers(0, 256, repeats.MATCH, dtype=np.uint8)
    found = []
    for n in (0, 40, 300):
        data = np.concatenate([rng.integers(0, 256, n, dtype=np.uint8), string, rng.integers(0, 256, 200, dtype=np.uint8)])
        at, hashes, first, last, _ = repeats.anchors(data)
        assert first[0] == 0 and last[-1] == len(data) - repeats.MATCH and (first[1:] == last[:-1] + 1).all()
        assert ((first <= at) & (at <= first + 127) & (at >= last)).all()
        inside = (at >= n) & (at <= n + repeats.MATCH - repeats.GRAM)
        found.append(set(zip((at[inside] - n).tolist(), hashes[inside].tolist(), strict=True)))
    assert set.intersection(*found)
    assert len(repeats.anchors(np.zeros(99, np.uint8))[0]) == 0
