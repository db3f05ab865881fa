"""Spelling variants: words one edit apart, and the form that a rare one stands for.

Asymmetric chunks. Of two words one edit apart, the shorter one (or either, of equal length)
is cut into two disjoint chunks, its halves. One inserted, deleted or replaced code point
leaves one of them whole, and the other word has it as a gram at the same position or shifted
by one. So the one word contributes two chunks, the other the positional grams that a chunk
can meet, and they join on the chunk's content; the shift is checked, then the whole words. A
pair is found by its first whole chunk at its smallest shift only, so none is found twice.

Chunks that many words share are joined by sort and merge, which adaptive execution splits;
no task gathers the words of a chunk.

A word's form is its most frequent near word, if that is at least ``RATIO`` times as frequent;
ties go to the smallest word. Following forms ends at the root: counts grow by ``RATIO`` each
time, so a few joins that double the steps reach it.

A null text has no words, a null id counts as an empty one, repeated rows count again, and an
empty table or one without frequent words gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from swellframe.llm.batches import slices
from swellframe.sources.workspace import only_kept, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHORTEST = 6
RAREST = 5
RATIO = 5
# One run in so many, by the hash of its document and itself, loses a letter.
SLIPS = 199
# Distinct words that a task adds up before it hands them on.
HELD = 200_000


def with_slip(key: str, run: str) -> str:
    """The run, without one code point where the hash of key and run says so."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % SLIPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", change=with_slip) -> DataFrame:
    """``word`` and ``n``: the frequent long words of all texts, each run taken through
    ``change`` (a function of the row's key as text and the run in lower case)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            out = pa.RecordBatch.from_arrays(arrays, ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for row_key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # A run that loses a letter may be one longer than the shortest word.
                    for word, n in Counter(RUN.findall((body or "").translate(LOWER))).items():
                        if len(word) >= SHORTEST and len(word := change(row_key or "", word)) >= SHORTEST:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(docs[key].cast("string").alias("_key"), docs[text].alias("_text"))
    words = rows.mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def _parts(length: Column) -> list[tuple[Column, Column]]:
    """Position (from 0) and length of the two chunks of a word of some length."""
    half = F.floor(length / 2).cast("int")
    return [(F.lit(0), half), (half, length.cast("int") - half)]


def chunks(words: DataFrame) -> DataFrame:
    """The two chunks of every word: ``size`` (of the word), ``part``, ``content``."""
    length = F.char_length("word")
    pieces = [
        F.struct(F.lit(part).alias("part"), F.substring(F.col("word"), at + 1, size).alias("content"))
        for part, (at, size) in enumerate(_parts(length))
    ]
    return words.select("word", "n", length.alias("size"), F.explode(F.array(*pieces)).alias("p")).select(
        "word", "n", "size", "p.part", "p.content"
    )


def grams(words: DataFrame) -> DataFrame:
    """The positional grams of every word that a chunk can meet within shift one, for words
    as long as it and one shorter: ``size`` (of the chunk's word), ``part``, ``shift``,
    ``content``."""
    length = F.char_length("word")
    pieces = [
        F.struct(
            (length - less).alias("size"),
            F.lit(part).alias("part"),
            F.lit(shift).alias("shift"),
            F.substring(F.col("word"), at + shift + 1, size).alias("content"),
        )
        for less in (0, 1)
        for part, (at, size) in enumerate(_parts(length - less))
        # The other word is at most one longer, so nothing in it moves back.
        for shift in range(less + 1)
    ]
    return words.select("word", "n", F.explode(F.array(*pieces)).alias("p")).select("word", "n", "p.*")


def _meets(short: Column, long: Column, part: int, shift: int) -> Column:
    """Whether a chunk of ``short`` stands in ``long`` at a shift."""
    at, size = _parts(F.char_length(short))[part]
    return F.substring(short, at + 1, size) == F.substring(long, at + shift + 1, size)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of words exactly one edit apart, once each, with ``a_n`` and ``b_n``.

    ``words`` has distinct words and their counts ``n``.
    """
    short = chunks(words).select(F.col("word").alias("a"), F.col("n").alias("a_n"), "size", "part", "content")
    long = grams(words).select(F.col("word").alias("b"), F.col("n").alias("b_n"), "size", "part", "shift", "content")
    a, b = F.col("a"), F.col("b")
    met = short.join(long, ["size", "part", "content"])
    # Of two words of one length the smaller one gives the chunks.
    met = met.filter((F.char_length(b) > F.col("size")) | (a < b))
    near = met.filter(F.levenshtein(a, b, 1) == 1)
    longer = F.char_length(b) > F.col("size")
    ways = [(0, 0), (0, 1), (1, 0), (1, 1)]
    found_before = F.lit(False)
    for i, (part, shift) in enumerate(ways):
        this = (F.col("part") == part) & (F.col("shift") == shift)
        for earlier_part, earlier_shift in ways[:i]:
            earlier = _meets(a, b, earlier_part, earlier_shift)
            earlier = earlier & longer if earlier_shift else earlier
            found_before = found_before | (this & earlier)
    return near.filter(~found_before).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word."""
    turn = lambda x, y: pairs.select(
        F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near")).alias("other")
    )
    near = turn("a", "b").unionByName(turn("b", "a"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (stored) with ``root``, the last word that its forms lead to."""
    steps = written(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(steps.join(ahead, "root", "left"), "forms")
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").isEmpty():
            break
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", change=with_slip) -> DataFrame:
    """Every frequent long word with ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    with only_kept(docs.sparkSession) as keep:
        words = written(word_counts(docs, key, text, change), "words")
        pairs = written(near_pairs(words), "near-words")
        formed = written(forms(words, pairs), "word-forms")
        columns = ["word", "form", "root", "n", "n_near", "form_n"]
        return keep(with_roots(formed).select(columns), "spelling-variants")
