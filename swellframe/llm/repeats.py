"""Bytes of documents that lie in a long string found earlier in the corpus, removed.

A string of ``MATCH`` bytes counts as repeated if it also starts earlier: in a document with
a smaller id, or further up in the same one. All documents together would make one suffix
array; it is built in shards that hold only what can repeat:

1. Anchors. In every ``MATCH`` bytes the grams with the smallest hash are anchors, so equal
   strings have equal anchors at equal places. Equal strings over a gram also agree in half
   of their other bytes before it or behind it; anchors that have this in common with no
   other one are done.
2. Contexts. Each string belongs to the first of its smallest grams, and an anchor's context
   is all that its strings hold. Of equal contexts only the earliest goes on; the strings of
   the others are repeated.
3. Shard arrays. Different contexts of the same anchor come together in a shard. Its suffix
   array is induced, permuted common prefixes tell which strings are equal, and all but the
   earliest are repeated.

Equal texts are one text with a 64-bit fingerprint: all rows of it but the one with the
smallest id are repeated throughout. A null text is empty. Rows without an id come after all
others. Where one anchor has more contexts than a shard holds, its strings are grouped by
hash in Spark instead, however many they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from swellframe.llm.batches import map_batches, slices
from swellframe.llm.suffixes import permuted_prefixes, suffix_array
from swellframe.llm.wanted import Seen, is_wanted, wanted_table
from swellframe.sources.workspace import written

MATCH = 100
GRAM = 16
# Bytes before or behind a gram that equal strings over it must have in common.
HALF = (MATCH - GRAM) // 2
# Rows of one gram that are compared in memory; of longer groups all rows go on.
GROUP_ROWS = 200_000
# Bytes of contexts in a shard's array, and contexts of one anchor that a shard may hold.
SHARD_BYTES = 1 << 20
SHARD_CONTEXTS = 8192
# Place of rows without an id.
LAST = (1 << 63) - 1


def fingerprint(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


_GRAM_BYTES = np.random.default_rng(99).integers(0, 1 << 63, 256, dtype=np.uint64)
_GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        hashes, factor, length = _GRAM_BYTES[data], _GRAM_FACTOR, 1
        while length < GRAM:
            hashes = hashes[:-length] * factor + hashes[length:]
            factor, length = factor * factor, 2 * length
        hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ hashes >> np.uint64(32)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        values = pick(values[:-length], values[length:])
        length *= 2
    return pick(values[: len(values) - (width - length)], values[width - length :]) if width > length else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grams that are smallest in some ``MATCH`` bytes: their places, their hashes, the first
    and last start of the strings in which they are the first of the smallest grams, and
    hashes of what stands before and behind them (32 bits each, 0 where that is too short)."""
    width = MATCH - GRAM + 1
    if len(data) < MATCH:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    hashes = gram_hashes(data)
    least = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    # The largest minimum among the strings over a gram is its own hash if it is an anchor.
    best = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(best == hashes)
    starts = np.arange(len(least))
    owner = np.searchsorted(at, starts)
    todo = starts
    while len(todo := todo[hashes[at[owner[todo]]] != least[todo]]):
        owner[todo] += 1
    used, first = np.unique(owner, return_index=True)
    last = np.append(first[1:], len(owner)) - 1
    at = at[used]
    before = _side(hashes, at, [-HALF, -HALF + GRAM, -GRAM])
    behind = _side(hashes, at, [GRAM, HALF - GRAM, HALF])
    return at, hashes[at], first, last, before << np.uint64(32) | behind


def _side(hashes: np.ndarray, at: np.ndarray, steps: list[int]) -> np.ndarray:
    """32-bit hashes of grams that stand ``steps`` away, 0 where the text ends before."""
    out = np.zeros(len(at), np.uint64)
    inside = np.flatnonzero((at + min(steps) >= 0) & (at + max(steps) < len(hashes)))
    with np.errstate(over="ignore"):
        total = np.zeros(len(inside), np.uint64)
        for step in steps:
            total = (total ^ hashes[at[inside] + step]) * _GRAM_FACTOR
    out[inside] = (total >> np.uint64(32)) | np.uint64(1)
    return out


# A context as one number: its start in the text, how many strings it has besides the first,
# and where its gram is.
SHORT = 7


def packed(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((first << SHORT) + last - first << SHORT) + place - first


def unpacked(span):
    """First and last start of a context's strings and the place of its gram; also of columns."""
    first = F.shiftright(span, 2 * SHORT) if hasattr(span, "cast") else span >> 2 * SHORT
    more = F.shiftright(span, SHORT) if hasattr(span, "cast") else span >> SHORT
    low = (1 << SHORT) - 1
    mask = (lambda x: x.bitwiseAND(F.lit(low))) if hasattr(span, "cast") else lambda x: x & low
    return first, first + mask(more), first + mask(span)


def text_facts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``name`` (the text's fingerprint), ``n_bytes`` and ``sha256``."""

    def make():
        def work(texts):
            bodies = [(t or "").encode() for t in texts]
            return (
                pa.array([fingerprint(b) for b in bodies], pa.int64()),
                pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
            )

        return work

    added = [StructField("name", LongType()), StructField("n_bytes", LongType()), StructField("sha256", StringType())]
    return map_batches(docs, [key], [text], added, make)


def anchor_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram``, ``context``, ``sides`` (hashes), ``name`` and ``span`` of all anchors.

    Equal texts are cut up once per task.
    """
    names = ["gram", "context", "sides", "name", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch):
                columns = [[np.zeros(0, np.int64)] for _ in names]
                for body in part.column(0).to_pylist():
                    data = (body or "").encode()
                    if len(data) < MATCH or not seen.first(name := fingerprint(data)):
                        continue
                    places, hashes, first, last, sides = anchors(np.frombuffer(data, np.uint8))
                    # The place within the context is part of what must be equal.
                    contexts = [
                        xxhash.xxh3_64_intdigest(data[a : b + MATCH], p)
                        for a, b, p in zip(first.tolist(), last.tolist(), (places - first).tolist(), strict=True)
                    ]
                    columns[0].append(hashes.view(np.int64))
                    columns[1].append(np.array(contexts, np.uint64).view(np.int64))
                    columns[2].append(sides.view(np.int64))
                    columns[3].append(np.full(len(places), name, np.int64))
                    columns[4].append(packed(first, last, places))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    schema = "gram long, context long, sides long, name long, span long"
    return docs.select(docs[text].alias("_text")).mapInArrow(run, schema)


def _shared(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row has the same gram and side, for sides that are there."""
    with np.errstate(over="ignore"):
        keys = (gram.view(np.uint64) ^ side) * _GRAM_FACTOR ^ side
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out & (side != 0)


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """The rows, without ``sides``, that share a side with another row of their gram.

    Sorted rows pass by; the rows of one gram are compared in memory up to ``GROUP_ROWS``.
    """
    names = [name for name in rows.columns if name != "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        long = None  # a gram whose rows all go on

        def given(columns: dict[str, np.ndarray], whole: bool) -> pa.RecordBatch:
            sides = columns["sides"].view(np.uint64)
            keep = np.full(len(sides), whole)
            if not whole:
                halves = (sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF))
                keep = _shared(columns["gram"], halves[0]) | _shared(columns["gram"], halves[1])
            return pa.RecordBatch.from_arrays([pa.array(columns[name][keep]) for name in names], names)

        for batch in batches:
            columns = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            if held:
                columns = {name: np.append(held[name], column) for name, column in columns.items()}
            if not len(columns["gram"]):
                continue
            if long is not None:
                end = int(np.searchsorted(columns["gram"], long, side="right"))
                yield given({name: column[:end] for name, column in columns.items()}, True)
                columns = {name: column[end:] for name, column in columns.items()}
                if not len(columns["gram"]):
                    held = {}
                    continue
                long = None
            start = int(np.searchsorted(columns["gram"], columns["gram"][-1]))
            yield given({name: column[:start] for name, column in columns.items()}, False)
            held = {name: column[start:] for name, column in columns.items()}
            if len(held["gram"]) > GROUP_ROWS:
                long = held["gram"][-1]
                yield given(held, True)
                held = {}
        if held:
            yield given(held, False)

    schema = ", ".join(f"{name} long" for name in names)
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)


def with_texts(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (one per ``name``) with the ``data`` of the text of that name, each once or,
    for copies in other tasks, more often."""
    table = wanted_table(rows, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch):
                found = {}
                for body in part.column(0).to_pylist():
                    data = (body or "").encode()
                    name = fingerprint(data)
                    if is_wanted(table, name) and seen.first(name):
                        found[name] = data
                arrays = [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "data"])

    texts = docs.select(docs[text].alias("_text")).mapInArrow(run, "name long, data binary")
    return texts.join(rows, "name")


CONTEXTS = "gram long, contexts long, owner long, name long, start long, place long, data binary"


def context_rows(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """The bytes of the contexts of anchors: see CONTEXTS; ``start`` is in the document
    and ``place``, that of the gram, in the context.

    ``wanted`` has ``gram``, ``contexts`` (how many the gram has), ``owner`` (the smallest id
    of the text), ``name`` and ``span``.
    """
    by_text = wanted.groupBy("name").agg(
        F.first("owner").alias("owner"), F.collect_set(F.struct("gram", "contexts", "span")).alias("spans")
    )
    names = [part.split()[0] for part in CONTEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for row in part.to_pylist():
                    data = row["data"]
                    for at in row["spans"]:
                        first, last, place = unpacked(at["span"])
                        fixed = (at["gram"], at["contexts"], row["owner"], row["name"], first, place - first)
                        rows.append((*fixed, data[first : last + MATCH]))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return with_texts(docs, by_text, text).mapInArrow(run, CONTEXTS)


MARKS = "name long, first long, last long"


def with_mates(rows: list[dict]) -> list[dict]:
    """The contexts of a shard that can have a string in common with another one.

    Equal strings over a gram agree in half of their other bytes before it or behind it.
    """
    sides = []
    for row in rows:
        data, at = row["data"], row["place"]
        before = (row["gram"], True, data[at - HALF : at]) if at >= HALF else None
        behind = (row["gram"], False, data[at + GRAM : at + GRAM + HALF])
        sides.append((before, behind if len(behind[2]) == HALF else None))
    counts = Counter(side for pair in sides for side in pair if side)
    return [row for row, pair in zip(rows, sides, strict=True) if any(side and counts[side] > 1 for side in pair)]


def shard_marks(owner: np.ndarray, name: np.ndarray, start: np.ndarray, data: list[bytes]) -> list[np.ndarray]:
    """Strings of a shard's contexts that also start earlier, as runs of starts: see MARKS."""
    if not data:
        return [np.zeros(0, np.int64)] * 3
    size = np.array([len(d) for d in data])
    # Contexts stand apart by a symbol below all bytes; the last symbol is below that.
    text = np.frombuffer(b"".join(d + b"\0" for d in data), np.uint8).astype(np.int16) + 2
    ends = np.cumsum(size + 1) - 1
    text[ends] = 1
    text = np.append(text, 0)
    array = suffix_array(text, MATCH)
    prefixes = permuted_prefixes(text, array, MATCH)
    which = np.repeat(np.arange(len(data)), size + 1)
    left = ends[which] - np.arange(len(which))
    array = array[1:]
    kept = array[left[array] >= MATCH]
    if not len(kept):
        return [np.zeros(0, np.int64)] * 3
    # Shorter suffixes stand between groups of equal strings, never inside one.
    edge = np.append(True, (prefixes[array] < MATCH)[1:])
    group = np.cumsum(edge)[left[array] >= MATCH]
    group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    at = which[kept]
    where = start[at] + kept - (ends[at] - size[at])
    order = np.lexsort((where, name[at], owner[at]))
    ordered = (owner[at][order], name[at][order], where[order])
    fresh = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in ordered]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    earliest = np.full(group[-1] + 1, len(rank) + 1)
    np.minimum.at(earliest, group, rank)
    repeated = rank > earliest[group]
    texts, starts = name[at][repeated], where[repeated]
    order = np.lexsort((starts, texts))
    texts, starts = texts[order], starts[order]
    first = np.append(True, (texts[1:] != texts[:-1]) | (starts[1:] > starts[:-1] + 1)) if len(texts) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(texts) else first
    return [texts[first], starts[first], starts[last]]


def array_marks(contexts: DataFrame) -> DataFrame:
    """MARKS from the suffix arrays of shards. A gram's contexts all lie in one shard."""
    names = [part.split()[0] for part in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = with_mates(held)
            column = lambda key: np.array([row[key] for row in rows], np.int64)
            marks = shard_marks(column("owner"), column("name"), column("start"), [row["data"] for row in rows])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in marks], names)

        for batch in batches:
            for part in slices(batch, 1024):
                for row in part.to_pylist():
                    if size >= SHARD_BYTES and row["gram"] != held[-1]["gram"]:
                        yield flush()
                        size = 0
                    held.append(row)
                    size += len(row["data"])
        if held:
            yield flush()

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, MARKS)


def hashed_marks(contexts: DataFrame) -> DataFrame:
    """MARKS of contexts of grams that have too many for a shard: strings grouped by hash.

    Grouping adds up in each task before the shuffle, so no task meets all strings of a gram.
    """
    schema = "gram long, string long, owner long, name long, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                rows = [
                    (row["gram"], fingerprint(row["data"][i : i + MATCH]), row["owner"], row["name"], row["start"] + i)
                    for row in part.to_pylist()
                    for i in range(len(row["data"]) - MATCH + 1)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "string", "owner", "name", "start"])

    strings = contexts.mapInArrow(run, schema)
    place = F.struct("owner", "name", "start")
    earliest = strings.groupBy("gram", "string").agg(F.min(place).alias("earliest"))
    later = strings.join(earliest, ["gram", "string"]).filter(place > F.col("earliest"))
    return later.select("name", F.col("start").alias("first"), F.col("start").alias("last"))


def merged_spans(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in runs (first, last)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(marks):
        end = last + MATCH
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def marked_starts(docs: DataFrame, owners: DataFrame, text: str = "text") -> DataFrame:
    """MARKS of all texts: runs of starts of strings that also start earlier.

    ``owners`` has ``name`` and ``owner``, the smallest id of the rows with that text.
    """
    found = repeated_anchors(anchor_rows(docs, text))
    known = written(found.join(owners.select("name", "owner").hint("merge"), "name"), "repeat-anchors")
    place = F.struct("owner", "name", "span")
    first = written(known.groupBy("gram", "context").agg(F.min(place).alias("first")), "repeat-contexts")
    copies = known.join(first, ["gram", "context"]).filter(place > F.col("first"))
    # All strings of a context that occurs earlier are repeated.
    start, end, _ = unpacked(F.col("span"))
    whole = copies.select("name", start.alias("first"), end.alias("last"))
    counts = first.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    others = first.select("gram", "first.*").join(counts, "gram")
    contexts = written(context_rows(docs, others, text), "repeat-context-bytes")
    fits = F.col("contexts") <= SHARD_CONTEXTS
    return whole.unionByName(array_marks(contexts.filter(fits))).unionByName(hashed_marks(contexts.filter(~fits)))


REMOVED = "name long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(docs: DataFrame, marks: DataFrame, text: str = "text") -> DataFrame:
    """What is left of every text with marks: see REMOVED."""
    by_text = marks.groupBy("name").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    names = [part.split()[0] for part in REMOVED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for row in part.to_pylist():
                    data, spans = row["data"], merged_spans([(m["first"], m["last"]) for m in row["marks"]])
                    edges = [0, *(edge for span in spans for edge in span), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    digest = hashlib.sha256(kept).hexdigest()
                    rows.append((row["name"], len(data) - len(kept), len(spans), digest, kept))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return with_texts(docs, written(by_text, "repeat-marks"), text).mapInArrow(run, REMOVED)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``key``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``kept``, the bytes that stay (null where the whole text does).

    Texts of fewer than ``MATCH`` bytes stay whole, copies or not. An empty table gives an
    empty result. Repeated rows stay rows; the first of them counts as the earlier one.
    """
    facts = written(text_facts(docs, key, text).withColumn("place", F.coalesce(F.col(key), F.lit(LAST))), "text-facts")
    owners = facts.groupBy("name").agg(F.min("place").alias("owner"), F.max("n_bytes").alias("n_bytes"))
    owners = written(owners, "text-owners")
    left = removed(docs, marked_starts(docs, owners, text), text)
    # Copies of a text in several tasks give the same line more than once.
    left = written(left, "repeat-removed").dropDuplicates(["name"])
    # Rows of one text and id are counted, and one of them may be the text's first.
    rows = facts.groupBy("name", "place").agg(
        F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("sha256").alias("sha256")
    )
    rows = rows.withColumn("nth", F.explode(F.expr("sequence(1L, n)")))
    rows = rows.join(owners.select("name", "owner"), "name").join(left, "name", "left")
    long = F.col("n_bytes") >= MATCH
    later = long & ~((F.col("place") == F.col("owner")) & (F.col("nth") == 1))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.when(F.col("place") != LAST, F.col("place")).alias(key),
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(later, nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
