"""Chat conversations formatted into windows of a token budget.

Prefix sums of turn tokens choose the windows. The system turn of a conversation, the first
with that role wherever it stands, is held by every window after it, whatever its length.
What it leaves of the budget is for the other turns: the line of the conversation's tokens is
cut into stretches of half of that. Turns inside one stretch share a window, a turn across a
border has its own. A window also holds the turns just before it, up to a quarter of the
budget. A system turn that fills the budget alone leaves its windows over budget; their own
turns are then cut as if it were not there. Only a window's own assistant turns are
under the loss mask, so a repeated turn is never learned twice. Every step is a join or a
window over a bounded piece of a conversation, so one huge conversation spreads over tasks.

Format: each turn is ``<|im_start|>role\\n<|im_sep|>text\\n<|im_end|>\\n``. Inside roles and
texts each control string gets a backslash in front, which reading takes off again.

Nulls: a null text or role is empty, rows with a null ``turn`` come first, and rows with a
null conversation id are one conversation. Rows of the same turn are ordered by role and
text; repeated rows are turns of their own. An empty table has no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Control strings of public chat templates, all escaped inside texts.
OPEN, SEPARATE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (OPEN, SEPARATE, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL = "(" + "|".join(re.escape(c) for c in CONTROLS) + ")"
JAVA_CONTROL = "(" + "|".join(re.sub(r"([\[\]|/])", r"\\\1", c) for c in CONTROLS) + ")"

BUDGET = 512
# Tokens that the template adds to a turn.
TURN_COST = 4
# Turns per block of the two-level prefix sums.
BLOCK_TURNS = 256
WORD = r"[^\x20\x09-\x0D]+"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(JAVA_CONTROL), F.lit(r"\\$1"))


def unescape(text: str) -> str:
    return re.sub(r"\\" + CONTROL, r"\1", text)


def with_prefix_sums(conversations: DataFrame) -> DataFrame:
    """Turns with ``position``, ``first_token`` and ``end_token`` within their conversation.

    Summed in blocks of turn numbers first, so that no task sorts a whole conversation.
    """
    text, role = (F.coalesce(conversations[c], F.lit("")) for c in ("text", "role"))
    turns = conversations.select(
        F.coalesce(conversations["conv_id"].cast("string"), F.lit("")).alias("key"),
        conversations["conv_id"].alias("conv_id"),
        conversations["turn"].alias("turn"),
        F.coalesce(F.floor(conversations["turn"] / BLOCK_TURNS), F.lit(-(2**60))).alias("block"),
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(WORD)) + TURN_COST).cast("long").alias("cost"),
    )
    blocks = turns.groupBy("key", "block").agg(
        F.sum("cost").alias("block_cost"), F.count("*").alias("block_turns")
    )
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "key",
        "block",
        F.coalesce(F.sum("block_cost").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    ordered = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumns(
        {"inside": F.sum("cost").over(upto), "row": F.row_number().over(ordered)}
    )
    return numbered.join(offsets, ["key", "block"]).select(
        "key",
        "conv_id",
        "role",
        "text",
        "cost",
        (F.col("turns_before") + F.col("row") - 1).alias("position"),
        (F.col("tokens_before") + F.col("inside") - F.col("cost")).alias("first_token"),
        (F.col("tokens_before") + F.col("inside")).alias("end_token"),
    )


def formatted_windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per window of ``turns`` (a stored result of ``with_prefix_sums``).

    Columns: ``key``, ``conv_id``, ``window``, ``formatted``, ``n_tokens``, ``over_budget``
    (a single turn beyond what the system turn leaves of the budget), and ``turns``: start
    and length of each turn's text in ``formatted`` in code points, with ``repeated`` and
    ``loss``.
    """
    bin_of = lambda token: F.floor(token / F.col("stretch"))
    systems = turns.filter(F.col("role") == "system").groupBy("key").agg(
        F.min(F.struct("position", "first_token", "cost")).alias("system")
    )
    reserved = F.coalesce(F.col("system.cost"), F.lit(0))
    left = F.when(reserved < budget, F.lit(budget) - reserved).otherwise(F.lit(budget))
    placed = turns.join(systems, "key", "left").withColumns(
        {
            "stretch": F.greatest(F.lit(1), F.floor(left / 2)),
            "quarter": F.least(F.lit(budget // 4), left),
            "reserved": reserved,
            "retained": F.coalesce(F.col("position") == F.col("system.position"), F.lit(False)),
            "system_token": F.col("system.first_token"),
        }
    ).drop("system")
    first_bin, last_bin = bin_of(F.col("first_token")), bin_of(F.col("end_token") - 1)
    placed = placed.withColumn("window", 2 * first_bin + (first_bin != last_bin).cast("long"))
    limits = ("stretch", "quarter", "reserved", "system_token")
    spans = placed.groupBy("key", "window").agg(
        F.min("first_token").alias("start"),
        F.sum("cost").alias("own"),
        *(F.first(name).alias(name) for name in limits),
    )
    # Windows that start behind the system turn repeat it; null without one.
    behind = F.coalesce(F.col("start") > F.col("system_token"), F.lit(False))
    spans = spans.withColumns({"behind": behind, "bin": bin_of(F.col("start"))})
    free = F.lit(budget) - F.when(F.col("behind"), F.col("reserved")).otherwise(0) - F.col("own")
    spans = spans.withColumn("room", F.greatest(F.lit(0), F.least(F.col("quarter"), free)))
    spans = spans.select("key", "window", "bin", "start", "room", "behind")

    shape = lambda df, kind: df.select(
        "key", "conv_id", "window", F.lit(kind).alias("kind"), "position", "role", "text", "cost"
    )
    near = placed.filter(~F.col("retained") & (F.col("cost") <= F.col("quarter"))).drop("window")
    near = near.withColumn(
        "bin",
        F.explode(
            F.sequence(bin_of(F.col("end_token")), bin_of(F.col("first_token") + F.col("quarter")))
        ),
    )
    history = near.join(spans, ["key", "bin"]).filter(
        (F.col("end_token") <= F.col("start"))
        & (F.col("start") - F.col("first_token") <= F.col("room"))
    )
    system = placed.filter("retained").drop("window").join(
        spans.filter("behind").select("key", "window"), "key"
    )
    rows = shape(placed, 2).unionByName(shape(history, 1)).unionByName(shape(system, 1))

    before = F.concat(
        F.lit(OPEN), escaped(F.col("role")), F.lit("\n" + SEPARATE)
    )
    body = escaped(F.col("text"))
    rows = rows.withColumns({"head": before, "body": body})
    piece = F.concat(F.col("head"), F.col("body"), F.lit("\n" + CLOSE + "\n"))
    order = Window.partitionBy("key", "window").orderBy("kind", "position")
    ends = F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("piece", piece).withColumn("end", ends)
    start = F.col("end") - F.char_length("piece") + F.char_length("head")
    own = F.col("kind") == 2
    part = F.struct(
        "kind",
        "position",
        "piece",
        start.cast("long").alias("start"),
        F.char_length("body").cast("long").alias("length"),
        (~own).alias("repeated"),
        (own & (F.col("role") == "assistant")).alias("loss"),
    )
    grouped = rows.groupBy("key", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("cost").alias("n_tokens"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return grouped.select(
        "key",
        "conv_id",
        "window",
        F.concat_ws("", F.transform("parts", lambda p: p["piece"])).alias("formatted"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.transform(
            "parts",
            lambda p: F.struct(p["start"], p["length"], p["repeated"], p["loss"]),
        ).alias("turns"),
    )


TURN = re.compile(
    r"(?<!\\)" + re.escape(OPEN) + r"(.*?)\n(?<!\\)" + re.escape(SEPARATE)
    + r"(.*?)\n(?<!\\)" + re.escape(CLOSE) + r"\n",
    re.DOTALL,
)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, parsed from its marks alone."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_windows long"
)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold when read back: turns once each, and the loss.

    A digest is sequential by nature, so a conversation's windows pass through one task, in
    order and one at a time; none is gathered.
    """
    columns = ["key", "conv_id", "window", "formatted", "turns"]
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    types = [pa.string() if "sha256" in name else pa.int64() for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key = state = None

        def close():
            if state is not None:
                conv_id, n, turns, chars, loss, total, count = state
                done.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total, count))

        def flush():
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["key"] != key:
                    close()
                    key = row["key"]
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["formatted"]
                for part, (role, said) in zip(row["turns"], read_turns(text), strict=True):
                    if not part["repeated"]:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                    if part["loss"]:
                        learned = unescape(text[part["start"] : part["start"] + part["length"]])
                        state[3] += len(learned)
                        state[4].update(learned.encode())
                state[5] += len(text)
                state[6] += 1
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    ordered = windows.select(columns).repartition("key").sortWithinPartitions("key", "window")
    return ordered.mapInArrow(run, DIGESTS)
