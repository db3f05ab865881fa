"""Ids against the tiktoken library, and the round trip."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from swellframe.llm import byte_bpe, queries

PATH, PATTERN = queries.vocabulary()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def model(tokens):
    return byte_bpe.serialized_model(tokens)


@pytest.fixture(scope="module")
def exact(tokens):
    import tiktoken

    ranks = {token: rank for rank, token in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(model, text):
    import regex

    lookup = byte_bpe._PreTokens(model).__getitem__
    return np.frombuffer(b"".join(map(lookup, regex.findall(PATTERN, text))), "<u4").tolist()


TEXTS = [
    "a",
    "Hello  world\n\n\tit's 12345 naïve 🙂 \x00\x1c\x85　 x",
    "<|endoftext|> [INST] <s>",
    "a" * 5000,
    "ab" * 3000 + " " * 700,
    "▁Āǿ <unk>",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_tiktoken(model, exact, text):
    assert ids_of(model, text) == exact.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text_equals_tiktoken(model, exact, text):
    assert ids_of(model, text) == exact.encode_ordinary(text)


def test_edge_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hi there", "x"), (4, "hi there", None), (4, "hi there", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    encoded = byte_bpe.encode(df, model, PATTERN, ["doc_id"])
    back = byte_bpe.decode(encoded, model, ["doc_id", "n_tokens"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in back) == [
        (0, 2, b"hi there"), (1, 0, b""), (2, 0, b""), (4, 2, b"hi there"), (4, 2, b"hi there"),
    ]
    assert byte_bpe.encode(df.limit(0), model, PATTERN, ["doc_id"]).collect() == []


def test_query_equals_tiktoken(spark, exact):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF_DIR, "documents").collect()}
    rows = queries.op10_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = exact.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
