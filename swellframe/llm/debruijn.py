"""Words that lie in a long run of words found earlier in the corpus, removed.

A window of ``WINDOW`` words counts as repeated if the same words also start earlier: in a
document with a smaller id, or further up in the same one. Windows are the edges of a De
Bruijn graph whose nodes are the runs of one word less:

1. Candidates. In every window the leftmost gram of ``GRAM`` words with the smallest hash is
   its anchor, so equal windows have equal anchors. Windows whose anchor stands at one place
   only are done; neighbours with the same anchor are handled as one row.
2. Edges. The windows left are grouped by their two nodes, added up in each task before the
   shuffle. Edges that occur once are dropped. The others know how often they occur, where
   first, and checksums of all their places and of the places one word before.
3. Junctions. Nodes with one edge in and one edge out are found by grouping the ends of all
   edges. Two edges are joined there if the source coordinates verify it: both occur equally often, and every
   place of the second is a place of the first moved on by one word. Such edges compact into
   paths, numbered along the document in which they occur first.
4. Spans. Only the places of a path's first edge are looked up. All that they start, but for
   the first one, is repeated.

No step gathers the places of an edge or pairs them with each other. Equal word sequences are
one text, told apart by 128 bits of SHA-256: all rows of it but the first are repeated
throughout. Nodes are told apart by 64 bits each, so windows by 128.

A null text is empty. Rows without an id come after all others. Of repeated rows, one is the
earlier. An empty table gives an empty result. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from swellframe.llm.batches import map_batches, slices
from swellframe.llm.wanted import Seen, parted
from swellframe.sources.workspace import only_kept, written

WINDOW = 20
GRAM = 8
# Place of rows without an id.
LAST = (1 << 63) - 1
# Bytes of a text that are hashed at once.
PIECE = 1 << 22

_BYTES = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class _Powers:
    """Powers of the factor and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, factor, np.uint64)))
                for factor in (_FACTOR, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(32)


def _run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs from ``first`` up to ``end`` of some 64-bit values."""
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.append(np.uint64(0), np.cumsum(values * up[:-1], dtype=np.uint64))
    return _mixed((sums[end] - sums[first]) * down[first])


def word_hashes(words: bytes) -> np.ndarray:
    """A hash for every word of ``words``, which are separated by one space."""
    out, start = [], 0
    while start < len(words):
        end = len(words) if len(words) - start <= PIECE else words.find(b" ", start + PIECE)
        end = end if end >= 0 else len(words)
        data = np.frombuffer(words, np.uint8, end - start, start)
        gaps = np.flatnonzero(_SPACE[data])
        first, last = np.append(0, gaps + 1), np.append(gaps, len(data))
        out.append(_run_hashes(_BYTES[data], first, last))
        start = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each place on."""
    first = np.arange(max(0, len(hashes) - length + 1))
    return _run_hashes(hashes, first, first + length)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of every run of windows with the same anchor."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = run_hashes(hashes, GRAM)
    at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return grams[at[first]], first, np.append(first[1:], len(at)) - 1


def plain_words(text: str | None) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join((text or "").encode().split())


def _name(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()[:16]


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def text_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``name`` (of the word sequence), ``short`` (half of it), ``n_words`` and
    ``sha256`` of every row."""

    def make():
        def work(texts):
            bodies = [plain_words(t) for t in texts]
            return (
                pa.array(names := [_name(b) for b in bodies], pa.binary()),
                pa.array([_short(name) for name in names], pa.int64()),
                pa.array([b.count(b" ") + bool(b) for b in bodies], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
            )

        return work

    long = lambda name: StructField(name, LongType())
    added = [StructField("name", BinaryType()), long("short"), long("n_words"), StructField("sha256", StringType())]
    return map_batches(docs, [key], [text], added, make)


def anchor_rows(docs: DataFrame, text: str) -> DataFrame:
    """``anchor``, ``short`` (half of the text's name), ``first`` and ``last`` window."""
    names = ["anchor", "short", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch):
                columns = [[np.zeros(0, np.int64)] for _ in names]
                for body in part.column(0).to_pylist():
                    words = plain_words(body)
                    if words.count(b" ") < WINDOW - 1 or not seen.first(name := _name(words)):
                        continue
                    found, first, last = anchors(word_hashes(words))
                    for column, values in zip(
                        columns, (found.view(np.int64), np.full(len(found), _short(name)), first, last), strict=True
                    ):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    schema = ", ".join(f"{name} long" for name in names)
    return docs.select(docs[text].alias("_text")).mapInArrow(run, schema)


def candidate_spans(docs: DataFrame, text: str) -> DataFrame:
    """``short`` and ``spans`` (first, last) of the windows whose anchor stands elsewhere too."""
    with only_kept(docs.sparkSession) as keep:
        # Stored, as texts are cut up once then, for both steps.
        rows = written(anchor_rows(docs, text), "word-anchor-rows")
        place = F.xxhash64("short", "first")
        twice = rows.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b")
        # Stored, so that a hot anchor's rows can be split over tasks in the join.
        twice = written(twice.select("anchor"), "word-anchors")
        shared = parted(rows, F.col("anchor"), twice)[0].join(twice, "anchor")
        return keep(shared.groupBy("short").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "word-candidates")


def with_words(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``wanted`` (one row per ``name``) with the ``words`` of the text of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch):
                found = {}
                for body in part.column(0).to_pylist():
                    words = plain_words(body)
                    if words.count(b" ") >= WINDOW - 1 and seen.first(name := _name(words)):
                        found[name] = words
                arrays = [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "words"])

    texts = docs.select(docs[text].alias("_text")).mapInArrow(run, "name binary, words binary")
    # Copies in other tasks give the same text again.
    return texts.join(wanted, "name").dropDuplicates(["name"])


WINDOWS = "head long, tail long, place long, start long"


def window_rows(texts: DataFrame) -> DataFrame:
    """The windows in the ``spans`` of ``texts``, with the two nodes that they lead from and to."""
    names = [part.split()[0] for part in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                columns = [[np.zeros(0, np.int64)] for _ in names]
                for row in part.to_pylist():
                    nodes = run_hashes(word_hashes(row["words"]), WINDOW - 1).view(np.int64)
                    spans = sorted((s["first"], s["last"]) for s in row["spans"])
                    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans]))
                    # Half a name stands for two texts in rare cases.
                    starts = starts[starts < len(nodes) - 1]
                    for column, values in zip(
                        columns, (nodes[starts], nodes[starts + 1], np.full(len(starts), row["place"]), starts), strict=True
                    ):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    return texts.select("words", "place", "spans").mapInArrow(run, WINDOWS)


def repeated_edges(windows: DataFrame) -> DataFrame:
    """Edges that occur twice or more: nodes, first place and start, count, and checksums of
    the places (``here``) and of the places one word before (``before``)."""
    return (
        windows.groupBy("head", "tail")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("place", "start")).alias("at"),
            F.bit_xor(F.xxhash64("place", "start")).alias("here"),
            F.bit_xor(F.xxhash64("place", F.col("start") - 1)).alias("before"),
        )
        .filter("n > 1")
        .select("head", "tail", "at.place", "at.start", "n", "here", "before")
    )


def continuing(edges: DataFrame) -> DataFrame:
    """``place`` and ``start`` of the edges that every source reaches from one edge alone."""
    columns = ["place", "start", "n", "here", "before"]

    def ends(node: str, comes: bool) -> DataFrame:
        return edges.select(F.col(node).alias("node"), F.lit(comes).alias("comes"), *columns)

    def lone(name: str, comes: bool) -> Column:
        return F.min(F.when(F.col("comes") == F.lit(comes), F.col(name)))

    # Where a node has one edge in and one out, the least values are those of these edges.
    # Numbers alone, so that tasks add up in a hash table what they send.
    nodes = ends("tail", True).unionAll(ends("head", False)).groupBy("node").agg(
        F.count_if("comes").alias("n_in"),
        F.count_if(~F.col("comes")).alias("n_out"),
        *[lone(name, True).alias(f"in_{name}") for name in ("place", "start", "n", "here")],
        *[lone(name, False).alias(name) for name in ("place", "start", "n", "before")],
    )
    verified = "in_n = n AND in_here = before AND in_place = place AND in_start + 1 = start"
    return nodes.filter(f"n_in = 1 AND n_out = 1 AND {verified}").select("place", "start")


def paths(edges: DataFrame) -> DataFrame:
    """Compacted paths: nodes of the first edge, its first ``place`` and ``start``, and
    ``edges``, how many edges it has.

    Edges of a path follow each other in the document that they occur in first, so they are
    numbered along that, a document at most at once. An edge that goes on a path has a mark,
    a row of its place and start without nodes, right before it.
    """
    rows = edges.select("place", "start", "head", "tail").unionByName(continuing(edges), allowMissingColumns=True)
    is_edge = F.col("head").isNotNull()
    along = Window.partitionBy("place").orderBy("start", is_edge)
    is_first = F.col("is_first")
    marked = rows.withColumn("is_first", is_edge & F.coalesce(F.lag(is_edge).over(along), F.lit(True)))
    own = F.when(is_first, F.col("start"))
    numbered = marked.withColumn("path", F.max(own).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.filter(is_edge).groupBy("place", "path").agg(
        F.max(F.when(is_first, F.col("head"))).alias("head"),
        F.max(F.when(is_first, F.col("tail"))).alias("tail"),
        F.count("*").alias("edges"),
    ).withColumnRenamed("path", "start")


def repeated_spans(windows: DataFrame, compact: DataFrame) -> DataFrame:
    """``place``, ``first`` and ``last`` window of every place of a path but its first one."""
    firsts = compact.select(
        "head", "tail", "edges", F.col("place").alias("first_place"), F.col("start").alias("first_start")
    )
    edge = F.xxhash64("head", "tail")
    found = parted(windows, edge, compact.select(edge))[0].join(firsts, ["head", "tail"])
    later = (F.col("place") != F.col("first_place")) | (F.col("start") != F.col("first_start"))
    return found.filter(later).select("place", F.col("start").alias("first"), (F.col("start") + F.col("edges") - 1).alias("last"))


REMOVED = "name binary, n_removed long, kept_sha256 string, kept binary"


def removed(texts: DataFrame) -> DataFrame:
    """What is left of ``words`` without their ``spans``: see REMOVED."""
    names = [part.split()[0] for part in REMOVED.split(", ")]
    types = (pa.binary(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for row in part.to_pylist():
                    words = row["words"].split(b" ")
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["first"] for s in row["spans"]], 1)
                    np.add.at(change, [s["last"] + WINDOW for s in row["spans"]], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                    rows.append((row["name"], int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return texts.select("name", "words", "spans").mapInArrow(run, REMOVED)


def without_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the
    kept words joined by one space) and ``kept``, those words (null where all stay).

    Texts of fewer than ``WINDOW`` words stay whole, copies or not.
    """
    with only_kept(docs.sparkSession) as keep:
        facts = text_facts(docs, key, text).withColumnRenamed(key, "_id")
        facts = written(facts.withColumn("row", F.monotonically_increasing_id()), "word-facts")
        order = F.struct(F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("id"), "row")
        owners = facts.groupBy("name").agg(
            F.min(order).alias("owner"), F.min("n_words").alias("n_words"), F.min("short").alias("short")
        )
        placed = owners.filter(F.col("n_words") >= WINDOW).select("name", "short", "owner.*")
        placed = placed.repartitionByRange("id", "name").sortWithinPartitions("id", "name")
        placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "word-places")

        spans = candidate_spans(docs, text)
        wanted = placed.select("name", "short", "place").join(spans, "short").drop("short")
        with only_kept(docs.sparkSession) as keep_marks:
            windows = written(window_rows(with_words(docs, wanted, text)), "word-windows")
            edges = written(repeated_edges(windows), "word-edges")
            compact = written(paths(edges), "word-paths")
            marks = repeated_spans(windows, compact).groupBy("place")
            marks = keep_marks(marks.agg(F.collect_list(F.struct("first", "last")).alias("spans")), "word-marks")
        texts = with_words(docs, placed.select("name", "place").join(marks, "place"), text)
        left = written(removed(texts), "word-removed")

        later = (F.col("n_words") >= WINDOW) & (F.col("row") != F.col("first_row"))
        rows = facts.join(owners.select("name", F.col("owner.row").alias("first_row")), "name")
        return keep(
            rows.join(left, "name", "left").select(
                F.col("_id").alias(key),
                "n_words",
                F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(later, hashlib.sha256(b"").hexdigest())
                .otherwise(F.coalesce("kept_sha256", "sha256"))
                .alias("kept_sha256"),
                F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
            ),
            "without-repeated-words",
        )
