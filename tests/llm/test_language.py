"""The field's inference by enumeration, and accuracy on documents it did not see."""

from __future__ import annotations

import itertools

import numpy as np

from swellframe.llm import language, queries


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths, k = np.array([3, 1, 4, 3]), 3
    emissions = rng.normal(size=(lengths.sum(), k)).astype(np.float32)
    transitions = rng.normal(size=(k, k)).astype(np.float32)
    posteriors, pairs = language.Chains(lengths).posteriors(emissions, transitions)
    expected, expected_pairs = np.zeros_like(emissions, float), np.zeros((k, k))
    at = 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        weights = np.array([
            np.exp(sum(emissions[at + i, p[i]] for i in range(n)) + sum(transitions[p[i], p[i + 1]] for i in range(n - 1)))
            for p in paths
        ])
        weights /= weights.sum()
        for path, weight in zip(paths, weights, strict=True):
            for i, label in enumerate(path):
                expected[at + i, label] += weight
            for a, b in itertools.pairwise(path):
                expected_pairs[a, b] += weight
        at += n
    np.testing.assert_allclose(posteriors, expected, atol=1e-4)
    np.testing.assert_allclose(pairs, expected_pairs, atol=1e-3)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op6_language(spark, sf_dir)
    known = queries.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    unseen = rows.join(known, "doc_id").filter("held_out and lang is not null and text is not null").collect()
    assert len(unseen) > 150
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.95
    assert all(0 <= r.score <= 1 for r in unseen)
    import zlib

    for row in rows.select("doc_id", "held_out").collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_code_switched_words():
    samples = {
        "aa": [f"the house number {w} of mine".split() for w in "abcdefgh"],
        "bb": [f"das kleine haus {w} ist mein".split() for w in "abcdefgh"],
    }
    fitted = language.train(samples)
    text = "the house of mine das kleine haus ist mein"
    _, _, posteriors = language.label_texts(fitted, [text])
    assert posteriors.argmax(1).tolist() == [0] * 4 + [1] * 5
    assert fitted.transitions[0, 0] > fitted.transitions[0, 1]


def test_edge_rows(spark):
    text = "le chat et la maison"
    rows = [
        (1, "en", "the cat and the house with a dog"), (2, "fr", text), (3, None, text), (4, "fr", None),
        (None, "fr", text), (6, "en", "12 !? ²"), (7, "en", ""), (2, "fr", text), (8, "en", "the " * 40_000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, score int")
    fitted = language.fit(df)
    assert set(fitted.languages) <= {"en", "fr"}
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(df, fitted, ["doc_id"]).collect()]
    assert len(got) == len(rows)
    assert {i for i, lang, _ in got if lang == "und"} >= {4, 6, 7}
    assert all(score == 0 for _, lang, score in got if lang == "und")
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(df.limit(0), fitted, ["doc_id"]).collect() == []
