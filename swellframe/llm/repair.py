"""Conversations brought back into shape by the cheapest edits.

Roles must read ``(s?(ua)+)?`` by their initials: a system turn or none, then a user and an
assistant turn by turns, or nothing at all. A turn is blank, a duplicate of an earlier one,
truncated, or without fault. Edits: keep a turn, delete it, give it another role, or insert an
empty turn; blank and duplicate turns must go.

Run-length DP. A conversation becomes a word of symbols, one per turn, of its role and fault.
Equal neighbours collapse into runs, and the min-plus transition of a run is put together from
cached binary powers of its symbol's. Conversations are cut into blocks of bounded length;
the transitions of blocks are combined in groups of bounded size, level by level, and give
every block the costs that lie behind it. With these, choices are unrolled for each state that
a block may be entered in; following the states through the blocks, again level by level,
tells which of them is real. So one huge conversation spreads over tasks.

Of the cheapest edits those with the least letters (D, I, K, R) in ASCII order count.

Order: by turn, nulls first; rows of one turn by role and text. Rows with a null
conversation id are one conversation. A null role or text is one space. An empty table gives
an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from swellframe.llm.batches import slices
from swellframe.sources.workspace import only_kept, written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
SPACE = " \t\n\v\f\r"

# Turns per block: places are numbered, and a block is all of these but the last bits.
BLOCK_BITS = 11
# Blocks that are combined at once, by level.
FAN_BITS = 9

# States: nothing yet, after the system turn, after a user, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
# Where an inserted or reroled turn leads, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ADDED = ("user", "user", "assistant", "user")
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Turns to insert at the end, by state, and their cost.
CLOSING = ((), ("user", "assistant"), ("assistant",), ())
BEHIND = [INSERT * len(roles) for roles in CLOSING]
FAR = 1 << 50

# Symbols: a letter for each role class and fault.
CLASSES = "suao"
FAULTS = ("", "truncated", "blank", "duplicate")
SYMBOLS = {(c, f): chr(65 + 4 * i + j) for i, c in enumerate(CLASSES) for j, f in enumerate(FAULTS)}
_MEANING = {symbol: meaning for meaning, symbol in SYMBOLS.items()}
# Turns that must go are alike for the transitions, whatever their role.
_ALIKE = str.maketrans({symbol: "X" for (_, fault), symbol in SYMBOLS.items() if fault in ("blank", "duplicate")})
_LEGAL = {"su", "ua", "au"}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def _moves(symbol: str) -> tuple[int | None, dict[int, int]]:
    """Extra cost of not deleting a turn (None: it must go) and where keeping it leads."""
    if symbol == "X":
        return None, {}
    role, fault = _MEANING[symbol]
    return (TRUNCATED if fault else 0), {state: to for (state, c), to in KEPT.items() if c == role}


@cache
def transition(symbol: str) -> np.ndarray:
    """Costs from state to state over one turn, insertions before it included."""
    extra, kept = _moves(symbol)
    turn = np.full((4, 4), FAR)
    insert = np.full((4, 4), FAR)
    for state in range(4):
        turn[state, state] = DELETE
        if extra is not None:
            turn[state, NEXT[state]] = REROLE + extra
            if state in kept:
                turn[state, kept[state]] = KEEP + extra
        insert[state, NEXT[NEXT[state]]] = 2 * INSERT
        insert[state, NEXT[state]] = min(insert[state, NEXT[state]], INSERT)
        insert[state, state] = 0
    return np.minimum(times(insert, turn), FAR)


@cache
def power(symbol: str, k: int) -> np.ndarray:
    """Costs over ``2 ** k`` equal turns."""
    if k == 0:
        return transition(symbol)
    half = power(symbol, k - 1)
    return np.minimum(times(half, half), FAR)


_RUN = re.compile(r"(.)\1*", re.DOTALL)


def runs(word: str) -> list[tuple[str, int]]:
    return [(m.group(1), m.end() - m.start()) for m in _RUN.finditer(word.translate(_ALIKE))]


def word_transition(word: str) -> np.ndarray:
    """Costs over all turns of a word, run by run."""
    total = np.full((4, 4), FAR)
    np.fill_diagonal(total, 0)
    for symbol, length in runs(word):
        for k in range(length.bit_length()):
            if length >> k & 1:
                total = np.minimum(times(total, power(symbol, k)), FAR)
    return total


def illegal_pairs(word: str) -> int:
    roles = "".join(_MEANING[symbol][0] for symbol in word)
    return sum(roles[i : i + 2] not in _LEGAL for i in range(len(roles) - 1))


def unrolled(word: str, behind: list[int]) -> tuple[list[str], list[int]]:
    """The edits from each state on, and the states that they end in, with costs behind."""
    word = word.translate(_ALIKE)
    costs = [list(behind)]
    value = np.array(behind, np.int64)
    for symbol in reversed(word):
        value = (transition(symbol) + value).min(1)
        costs.append(value.tolist())
    costs.reverse()
    moves = {symbol: _moves(symbol) for symbol in set(word)}
    audits, ends = [], []
    for state in range(4):
        letters = []
        for i, symbol in enumerate(word):
            extra, kept = moves[symbol]
            here, after = costs[i], costs[i + 1]
            while True:
                if DELETE + after[state] == here[state]:
                    letters.append("D")
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    letters.append("I")
                    state = NEXT[state]
                    continue
                if state in kept and KEEP + extra + after[kept[state]] == here[state]:
                    letters.append("K")
                    state = kept[state]
                else:
                    letters.append("R")
                    state = NEXT[state]
                break
        audits.append("".join(letters))
        ends.append(state)
    return audits, ends


def row_edits(audit: str, symbols: str, state: int) -> list[tuple[list[str], str, str | None]]:
    """Per turn: roles inserted before it, its letter, and its new role (None: unchanged)."""
    out, added = [], []
    turn = iter(symbols)
    for letter in audit:
        if letter == "I":
            added.append(ADDED[state])
            state = NEXT[state]
            continue
        symbol, role = next(turn), None
        if letter == "R":
            role, state = ADDED[state], NEXT[state]
        elif letter == "K":
            state = KEPT[state, _MEANING[symbol][0]]
        out.append((added, letter, role))
        added = []
    return out


# ---- rows --------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query: by the hash of id and turn, rows go, lose their text or its
    ends, are repeated, or become the user's. Nulls of role and text are one space."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", "text")
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.filter(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows with ``key`` (the id as text, empty for none) and ``place``, which numbers all rows
    in order. Sorted by range, so that a huge conversation spreads; equal rows spread by number."""
    said = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    key = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    rows = conversations.select(key, "conv_id", "turn", said("role"), said("text"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text", "number"]
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("number")
    return rows.withColumn("place", F.monotonically_increasing_id())


def marked_turns(turns: DataFrame) -> DataFrame:
    """``key``, ``place``, ``fault`` and ``symbol`` of ordered turns (stored)."""
    bare = F.rtrim("text", F.lit(SPACE))
    spoken = turns.select(
        "key",
        "place",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.unhex(F.sha2("text", 256)).alias("said"),
    )
    first = spoken.filter("NOT blank").groupBy("key", "role", "said").agg(F.min("place").alias("place"))
    # Places are unique, so no hot text or conversation meets in this join.
    rows = spoken.select("key", "place", "initial", "blank", "open").join(
        first.select("place", F.lit(True).alias("first")), "place", "left"
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
    fault = fault.when(F.col("open"), "truncated").otherwise("")
    group = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letters = F.create_map(*[F.lit(x) for (c, f), s in SYMBOLS.items() for x in (c + f, s)])
    rows = rows.withColumns({"fault": fault, "group": group})
    return rows.select("key", "place", "fault", letters[F.concat("group", "fault")].alias("symbol"))


def blocks_of(marked: DataFrame) -> DataFrame:
    """``key``, ``block``, ``word`` and ``places``: turns of a conversation in bounded pieces."""
    grouped = marked.groupBy("key", F.shiftright("place", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("turns")
    )
    return grouped.select(
        "key",
        "block",
        F.concat_ws("", F.transform("turns", lambda t: t["symbol"])).alias("word"),
        F.transform("turns", lambda t: t["place"]).alias("places"),
    )


SUMMARY = "key string, block long, costs array<long>, left string, right string, illegal long"


def _summaries(rows: DataFrame, summary) -> DataFrame:
    """A row of SUMMARY per row: ``summary`` gives its last four columns."""
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [(row["key"], row["block"], *summary(row)) for row in part.to_pylist()]
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, SUMMARY)


def _of_word(row: dict) -> tuple:
    word = row["word"]
    return word_transition(word).ravel().tolist(), word[:1], word[-1:], illegal_pairs(word)


def _of_ends(row: dict) -> tuple:
    costs = np.full((4, 4), FAR)
    costs[range(4), row["ends"]] = 0
    return costs.ravel().tolist(), "", "", 0


def _of_parts(row: dict) -> tuple:
    parts = row["parts"]
    total, illegal = np.array(parts[0]["costs"]).reshape(4, 4), parts[0]["illegal"]
    for before, part in zip(parts, parts[1:], strict=False):
        total = np.minimum(times(total, np.array(part["costs"]).reshape(4, 4)), FAR)
        illegal += part["illegal"]
        if before["right"] and part["left"]:
            illegal += illegal_pairs(before["right"] + part["left"])
    return total.ravel().tolist(), parts[0]["left"], parts[-1]["right"], illegal


def _grouped(level: DataFrame, bits: int) -> DataFrame:
    up = F.shiftright("block", bits)
    return level.groupBy("key", up.alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("block", "costs", "left", "right", "illegal"))).alias("parts")
    )


def levels_of(summary: DataFrame) -> list[tuple[DataFrame, int]]:
    """Summaries level by level, down to one per conversation, with the bits dropped next."""
    level = written(summary, "repair-level")
    out = []
    while (level.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        most = level.groupBy("key").count().agg(F.max("count")).first()[0]
        bits = FAN_BITS if most > 1 << FAN_BITS else 62
        out.append((level, bits))
        parents = _grouped(level, bits).withColumnRenamed("up", "block")
        level = written(_summaries(parents, _of_parts), "repair-level")
    return [*out, (level, 0)]


def scanned(levels: list[tuple[DataFrame, int]], start: list[int], backwards: bool) -> DataFrame:
    """``key``, ``block`` and ``at``: for every block the costs of the states before it, from
    ``start`` at the front, or behind it, from ``start`` at the end."""
    schema = "key string, block long, at array<long>"
    names = ["key", "block", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for row in part.to_pylist():
                    at = np.array(row["at"])
                    for piece in reversed(row["parts"]) if backwards else row["parts"]:
                        out.append((row["key"], piece["block"], at.tolist()))
                        costs = np.array(piece["costs"]).reshape(4, 4)
                        at = (costs + at).min(1) if backwards else (at[:, None] + costs).min(0)
                        at = np.minimum(at, FAR)
                columns = list(zip(*out, strict=True)) or [[]] * 3
                types = (pa.string(), pa.int64(), pa.list_(pa.int64()))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    top, _ = levels[-1]
    at = top.select("key", "block", F.array(*[F.lit(x).cast("long") for x in start]).alias("at"))
    for level, bits in reversed(levels[:-1]):
        above = at.withColumnRenamed("block", "up")
        at = _grouped(level, bits).join(above, ["key", "up"]).mapInArrow(run, schema)
    return at


def _unrolled_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``at`` (costs behind), unrolled: ``audits`` and ``ends`` by first state."""
    schema = "key string, block long, word string, places array<long>, audits array<string>, ends array<int>"
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = ["key", "block", "word", "places", "audits", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [
                    (row["key"], row["block"], row["word"], row["places"], *unrolled(row["word"], row["at"]))
                    for row in part.to_pylist()
                ]
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return blocks.mapInArrow(run, schema)


def _edits(blocks: DataFrame) -> DataFrame:
    """``place``, ``added`` (roles inserted before the turn), ``edit`` and ``new_role``."""
    schema = "place long, added array<string>, edit string, new_role string"
    types = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for row in part.to_pylist():
                    edits = row_edits(row["audit"], row["word"], row["state"])
                    out += [(place, *edit) for place, edit in zip(row["places"], edits, strict=True)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "added", "edit", "new_role"])

    return blocks.select("word", "places", "audit", "state").mapInArrow(run, schema)


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ordered turns (stored): per conversation what was found, per turn what to do, and the
    turns as they are afterwards.

    ``found``: ``key``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` (pairs of
    neighbours that the shape does not allow), ``cost``, ``audit``. ``edits``: ``place``,
    ``added``, ``edit``, ``new_role``. ``after``: ``key``, ``place``, ``nth`` (within a place),
    ``role``, ``text``.
    """
    marked = written(marked_turns(turns), "repair-marks")
    blocks = written(blocks_of(marked), "repair-blocks")
    levels = levels_of(_summaries(blocks.drop("places"), _of_word))
    behind = scanned(levels, BEHIND, backwards=True)
    tried = written(_unrolled_blocks(blocks.join(behind, ["key", "block"])), "repair-unrolled")
    states = levels_of(_summaries(tried.select("key", "block", "ends"), _of_ends))
    entered = scanned(states, [0, FAR, FAR, FAR], backwards=False)
    state = (F.array_position("at", F.lit(0).cast("long")) - 1).cast("int")
    known = tried.join(entered, ["key", "block"]).withColumn("state", state)
    known = known.select(
        "key", "block", "word", "places", "state",
        F.get("audits", "state").alias("audit"), F.get("ends", "state").alias("end"),
    )
    known = written(known, "repair-known")
    edits = written(_edits(known), "repair-edits")

    counts = marked.groupBy("key").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS[1:]])
    gaps = turns.filter("turn IS NOT NULL").groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    closing = F.array(*[F.lit("I" * len(roles)) for roles in CLOSING])
    ended = known.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts"), F.max_by("end", "block").alias("end")
    )
    ended = ended.select(
        "key", "end", F.concat(F.concat_ws("", F.transform("parts", lambda p: p["audit"])), F.get(closing, "end")).alias("audit")
    )
    cost = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("costs", i) + F.get(F.array(*map(F.lit, BEHIND)), i)))
    totals = levels[-1][0].select("key", "illegal", cost.cast("long").alias("cost"))
    found = counts.join(totals, "key").join(ended, "key").join(gaps, "key", "left").fillna(0, ["gaps"])

    turn = F.struct(F.coalesce("new_role", "role").alias("role"), "text")
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") != "D", F.array(turn)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    after = turns.join(edits, "place").select(
        "key", "place", F.posexplode(F.concat(empty(F.col("added")), own)).alias("nth", "turn")
    )
    roles = F.get(F.array(*[F.array(*map(F.lit, r)).cast("array<string>") for r in CLOSING]), "end")
    closed = ended.select("key", F.lit(2**62).alias("place"), F.posexplode(empty(roles)).alias("nth", "turn"))
    after = after.unionByName(closed).select("key", "place", "nth", "turn.role", "turn.text")
    return found, edits, after


def digests(after: DataFrame) -> DataFrame:
    """``key`` and SHA-256 of the lines ``role:text``, joined by newlines.

    A digest is sequential by nature, so a conversation's lines pass through one task, in order
    and one at a time; none is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        done: list[tuple[str, str]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 2
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "sha256"])

        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    line = f"{row['role']}:{row['text']}".encode()
                    if digest is None or row["key"] != key:
                        if digest is not None:
                            done.append((key, digest.hexdigest()))
                        key, digest = row["key"], hashlib.sha256(line)
                    else:
                        digest.update(b"\n" + line)
                if len(done) >= 1000:
                    yield flush()
        if digest is not None:
            done.append((key, digest.hexdigest()))
        yield flush()

    rows = after.repartition("key").sortWithinPartitions("key", "place", "nth")
    return rows.mapInArrow(run, "key string, sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For every id of ``conversations`` what was found in its ``rows`` and their repair's
    digest; zeros, no audit and the digest of nothing where it has no rows."""
    with only_kept(conversations.sparkSession) as keep:
        turns = written(ordered_turns(rows), "repair-turns")
        found, _, after = repaired(turns)
        digest = written(digests(after), "repair-digests")
        key = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("key")
        every = conversations.select(key, "conv_id").distinct()
        report = every.join(found, "key", "left").join(digest, "key", "left")
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return keep(
            report.select(
                "conv_id",
                *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
                F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
            ),
            "repair-report",
        )
