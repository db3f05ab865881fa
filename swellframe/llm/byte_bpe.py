"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

The model file is written directly from the vocabulary: each token's bytes are mapped to
one character per byte, its score is the negative rank, and the normaliser is the identity.
Sentencepiece then merges the best-ranked neighbours first, leftmost on ties, as byte-level
BPE does. Text is cut into pre-tokens before, and ids are mapped back by the inverse table.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField

from swellframe.llm.batches import map_batches

# One character per byte: this block has neither spaces nor combining characters.
FIRST_CHAR = 0x100
UNKNOWN = "<unk>"
# Pre-tokens whose ids a task remembers, and the longest that it remembers.
CACHED_TOKENS = 200_000
CACHED_CHARS = 64


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a file of ``base64 rank`` lines."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not consecutive")
    return [ranks[i] for i in range(len(ranks))]


def mapped(data: bytes) -> str:
    return "".join(chr(FIRST_CHAR + byte) for byte in data)


def unmapped(piece: str) -> bytes:
    return bytes(ord(char) - FIRST_CHAR for char in piece)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def _blob(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


# Field numbers and enum values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL_PIECE, UNKNOWN_PIECE = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE_MODEL = 2
NORMALIZER_NAME, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def serialized_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the last id is the unknown piece."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = _blob(PIECE_TEXT, mapped(token).encode())
        piece += _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank)
        out += _blob(PIECES, piece + _number(PIECE_TYPE, NORMAL_PIECE))
    unknown = _blob(PIECE_TEXT, UNKNOWN.encode())
    unknown += _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", 0.0)
    out += _blob(PIECES, unknown + _number(PIECE_TYPE, UNKNOWN_PIECE))
    trainer = _number(MODEL_TYPE, BPE_MODEL) + _number(VOCAB_SIZE, len(tokens) + 1)
    trainer += _number(UNK_ID, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    plain = _blob(NORMALIZER_NAME, b"identity")
    plain += b"".join(_number(field, 0) for field in (DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES))
    return bytes(out + _blob(TRAINER, trainer) + _blob(NORMALIZER, plain))


@lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class _PreTokens(dict):
    """Ids of pre-tokens as packed unsigned 32-bit integers, computed when first asked for."""

    def __init__(self, model: bytes):
        super().__init__()
        self.processor = _processor(model)
        size = self.processor.get_piece_size() - 1
        # A pre-token that is a token as a whole keeps that id.
        self.whole = {self.processor.id_to_piece(i): struct.pack("<I", i) for i in range(size)}

    def __missing__(self, token: str) -> bytes:
        piece = mapped(token.encode())
        ids = self.whole.get(piece)
        if ids is None:
            ids = np.asarray(self.processor.encode(piece), "<u4").tobytes()
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = ids
        return ids


def encode(df: DataFrame, model: bytes, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    Every match of ``pattern`` is encoded by itself. A null or empty text has no ids.
    Repeated rows are encoded each. Other columns are not read.
    """

    def make():
        import regex

        pre_tokens, ids_of = regex.compile(pattern), _PreTokens(model).__getitem__

        def work(texts):
            ids = [b"".join(map(ids_of, pre_tokens.findall(t))) if t else b"" for t in texts]
            return pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())

        return work

    added = [StructField("ids", BinaryType()), StructField("n_tokens", LongType())]
    return map_batches(df, keep, [text], added, make)


def decode(df: DataFrame, model: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes that the ids stand for; null ids: empty."""

    def make():
        processor = _processor(model)
        bytes_of = [unmapped(processor.id_to_piece(i)) for i in range(processor.get_piece_size() - 1)]

        def work(packed):
            found = [np.frombuffer(x or b"", "<u4").tolist() for x in packed]
            return (pa.array([b"".join(map(bytes_of.__getitem__, x)) for x in found], pa.binary()),)

        return work

    return map_batches(df, keep, [ids], [StructField("decoded", BinaryType())], make)
