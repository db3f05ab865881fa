"""Mixes sources to target weights from fixed-length blocks of words.

The words of a source, documents in hashed order, are cut into blocks of equal length. A
source's target gives its slots. Slots are dealt to output shards by multinomial draws, and
the n-th slot of a source takes the block at place n of a pseudorandom permutation of the
source's block numbers, a new one for each pass. Joining slots and blocks by source and
block number gives the spans of words that the mix takes.

There may be as many sources as documents: their ranks, targets and slots are a table, made
with sums over ranges of sources. The driver reads totals only. An empty table gives no plan
and no mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from swellframe.llm.batches import map_batches, slices, unused
from swellframe.sources.workspace import written

WEIGHTS = (5, 2, 1)
# Words that the mix takes, as a share of all words, and the most of any one source.
TOTAL_SHARE, MOST_PASSES = 1.5, 2.0
BLOCK_WORDS = 64
SHARD_SLOTS = 256
# Shards whose draws share exact source totals; one task's unit of work.
GROUP_SHARDS = 64
# Documents of a source are summed in so many parts, so that no task holds a whole source.
ORDER_PARTS = 1024
# A source's groups are listed in stretches of so many, so that no row holds them all.
LISTED_GROUPS = 4096
# Tasks that groups of shards are dealt to.
MOST_TASKS = 10_000
SEED = 20240131


def with_sizes(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``size``, the words of the whole text (null and empty have 0), and
    ``tie``, a hash of the text that orders rows of one id."""

    def make():
        def work(texts):
            sizes = [len(t.encode().split()) if t else 0 for t in texts]
            ties = [xxhash.xxh3_64_intdigest(t or "") - (1 << 63) for t in texts]
            return pa.array(sizes, pa.int64()), pa.array(ties, pa.int64())

        return work

    added = [StructField(name, LongType()) for name in ("size", "tie")]
    return map_batches(df, keep, [text], added, make)


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with the sums of columns over all earlier rows, stored. ``sums`` names them.

    Rows are dealt to ranges of the order. Each range is summed by itself, and one row per
    range carries the sums of the ranges before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_range", F.spark_partition_id())
    # Stored first: a range that is made again need not have the same bounds.
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "mix-ranges")
    ranges = placed.groupBy("_range").agg(*[F.sum(name).alias(name) for name in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_range", *[F.sum(name).over(before).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.sum(name).over(inside).alias(f"_in_{name}") for name in sums])
    # One row per range, and there are as many ranges as shuffle partitions.
    joined = own.join(F.broadcast(carried), "_range")
    zero = F.lit(0)
    added = [
        (F.coalesce(f"_{name}", zero) + F.coalesce(f"_in_{name}", zero)).alias(alias)
        for name, alias in sums.items()
    ]
    return joined.select(*rows.columns, *added)


def with_targets(sources: DataFrame, share=TOTAL_SHARE, most=MOST_PASSES) -> DataFrame:
    """Sources (``rank``, ``source_size``, ``weight``) with ``target``, the words to take from
    each: shares by weight, none above ``most`` times its size.

    Sources in the order in which they reach their limit: each is at its limit if its share
    of what the ones before it leave is at least that.
    """
    totals = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if totals[0] is None:
        return sources.withColumn("target", F.lit(0.0))
    limit = F.lit(float(most)) * F.col("source_size")
    in_order = prefix_sums(
        sources.withColumn("reached", limit / F.col("weight")),
        [F.col("reached"), F.col("rank")],
        {"source_size": "size_before", "weight": "weight_before"},
    )
    left = F.lit(share * totals[0]) - F.lit(float(most)) * F.col("size_before")
    levels = written(
        in_order.withColumn("level", left / (F.lit(totals[1]) - F.col("weight_before"))), "mix-levels"
    )
    full = F.col("reached") <= F.col("level")
    shared = levels.filter(~full).agg(F.max("level")).first()[0] or 0.0
    target = F.when(full, limit).otherwise(F.lit(shared) * F.col("weight"))
    return levels.withColumn("target", target).select(*sources.columns, "target")


def source_plan(sized: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sources in code point order, null last, with repeating weights: ``source``, ``rank``,
    ``source_size``, ``target``, ``n_blocks``, ``n_slots``; stored."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(
        sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"one": "rank"}
    )
    turn = F.pmod("rank", F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(weight)) for weight in weights]), turn)
    aimed = with_targets(ranked.withColumn("weight", weight).drop("one"))
    blocks = F.ceil(F.col("source_size") / block_words)
    planned = aimed.withColumn("n_blocks", blocks).withColumn(
        "n_slots",
        F.rint(F.col("target") / F.greatest("source_size", F.lit(1)) * F.col("n_blocks")).cast("long"),
    )
    columns = ["source", "rank", "source_size", "target", "n_blocks", "n_slots"]
    return written(planned.select(columns), "mix-plan")


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``places`` under a pseudorandom permutation of 0..n-1.

    A Feistel network over the next even power of two; images beyond n go through again.
    """
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, key]).integers(1, 1 << 63, 4, dtype=np.uint64)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(quota: np.ndarray, slots: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Multinomial source counts of shard after shard, until every source's quota is used.

    Draws beyond what a source has left are drawn again among the others.
    """
    left = quota.copy()
    while left.sum() > slots:
        counts = np.zeros_like(left)
        while (missing := slots - counts.sum()) > 0:
            room = left - counts
            counts += np.minimum(rng.multinomial(missing, room / room.sum()), room)
        left -= counts
        yield counts
    if left.sum():
        yield left


def group_quotas(plan: DataFrame, groups: int) -> DataFrame:
    """How many slots each source has in each group of shards: ``group``, ``rank``, ``n_blocks``,
    ``first`` (its slots in earlier groups) and ``quota``, where there are any.

    The n slots of a source up to group g are floor((n * g + phase) / groups). Phases are
    hashes of the rank, so that sources with fewer slots than groups don't meet in one.
    """
    phase = F.pmod(F.xxhash64(F.lit(SEED), "rank"), F.lit(groups))
    # Whole rounds of the groups are taken out, which keeps the products small.
    rounds = F.expr(f"n_slots div {groups}")
    rest = F.col("n_slots") - rounds * groups
    used = plan.filter("n_slots > 0").select(
        "rank", "n_blocks", "n_slots", phase.alias("phase"), rounds.alias("rounds"), rest.alias("rest")
    )
    many = F.least("n_slots", F.lit(groups))
    stretches = used.withColumn("many", many).withColumn(
        "stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {LISTED_GROUPS}")))
    )
    low = F.col("stretch") * LISTED_GROUPS
    high = F.least(low + LISTED_GROUPS, F.col("many")) - 1
    listed = stretches.withColumn("nth", F.explode(F.sequence(low, high)))
    # With fewer slots than groups, the n-th slot is in a group of its own.
    alone = F.expr(f"((nth + 1) * {groups} - phase + n_slots - 1) div n_slots - 1")
    grouped = listed.withColumn("group", F.when(F.col("rounds") > 0, F.col("nth")).otherwise(alone))
    upto = lambda g: F.expr(f"rounds * ({g}) + (rest * ({g}) + phase) div {groups}")
    return grouped.select(
        "group", "rank", "n_blocks", upto("`group`").alias("first"),
        (upto("`group` + 1") - upto("`group`")).alias("quota"),
    )


SLOTS = "shard long, slot long, rank long, pass long, block long"


def drawn_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of every output shard: which block of which source it takes in which pass.

    A group of shards is drawn by itself from the sources that have slots in it. Its size does
    not depend on the number of sources.
    """
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    groups = max(1, -(-total // (shard_slots * GROUP_SHARDS)))
    names = [part.split()[0] for part in SLOTS.split(", ")]

    def group_slots(quotas: pa.Table) -> pa.Table:
        quotas = quotas.sort_by("rank")
        rank, n_blocks, first, quota = (
            quotas[name].to_numpy() for name in ("rank", "n_blocks", "first", "quota")
        )
        group = quotas["group"][0].as_py()
        place, rng = first.copy(), np.random.default_rng([SEED, 1, group])
        parts = []
        for number, counts in enumerate(shard_counts(quota, shard_slots, rng)):
            which = np.repeat(np.arange(len(rank)), counts)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            shard = np.full(len(which), (group << 20) + number)
            parts.append([shard, rng.permutation(len(which)), which, place[which] + inside])
            place += counts
        shard, slot, which, nth = map(np.concatenate, zip(*parts, strict=True))
        turn, block = np.divmod(nth, n_blocks[which])
        order = np.lexsort((turn, which))
        edges = np.flatnonzero(np.diff(which[order]) | np.diff(turn[order])) + 1
        for at in np.split(order, edges):
            r, t = int(which[at[0]]), int(turn[at[0]])
            block[at] = permuted(block[at], int(n_blocks[r]), int(rank[r]) << 20 | t)
        return pa.table([shard, slot, rank[which], turn, block], names=names)

    # A group is seconds of work at most. Adaptive execution would see only its few quota rows.
    tasks = min(groups, MOST_TASKS)
    quotas = group_quotas(plan, groups).repartition(tasks, "group")
    return quotas.groupBy("group").applyInArrow(group_slots, SLOTS)


def block_spans(sized: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pieces of documents in the blocks of their source.

    ``sized`` has ``row`` (unique), ``doc_id``, ``source``, ``size`` and ``tie``. Documents of a source
    follow each other by a hash of their id, so that the order does not depend on storage.
    """
    ranks = plan.select(F.col("source").alias("_source"), "rank")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_PARTS))
    rows = sized.filter(F.col("size") > 0).join(ranks, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("row", "doc_id", "size", "tie", "rank", part.alias("part"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rank", "part").agg(F.sum("size").alias("words")).select(
        "rank", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("rank", "part").orderBy("doc_id", "size", "tie")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(starts, ["rank", "part"])
    placed = placed.withColumn("end", F.col("before") + F.col("upto"))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))
    pieces = placed.withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return pieces.select(
        "rank",
        "block",
        "row",
        "doc_id",
        (first - F.col("start")).alias("first_word"),
        (last - first).alias("n_words"),
    )


def mixture(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix: ``shard``, ``slot``, ``pass``, and the words that fill the slot: ``row``,
    ``doc_id``, ``first_word``, ``n_words``. Documents without words fill none."""
    # Spark takes drawn slots for as small as the quotas that they are drawn from.
    slots = drawn_slots(plan).hint("merge")
    return slots.join(block_spans(sized, plan), ["rank", "block"]).drop("rank", "block")


def stored_sizes(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``source`` and ``size`` of all documents, as a stored table.

    The row numbers only tell repeated rows apart; no result depends on their values.
    """
    sized = with_sizes(docs, ["doc_id", "source"])
    return written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def taken_words(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    taken = mixture(sized, plan).groupBy("row").agg(F.sum("n_words").alias("taken"))
    facts = plan.select(F.col("source").alias("_source"), "source_size", "target")
    known = sized.join(facts, F.col("source").eqNullSafe(F.col("_source")))
    return known.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def runs(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces (pass, first word, words) of a document, joined where one ends as the next begins."""
    out: list[tuple[int, int, int]] = []
    for turn, first, words in sorted(pieces):
        if out and out[-1][0] == turn and out[-1][1] + out[-1][2] == first:
            out[-1] = (turn, out[-1][1], out[-1][2] + words)
        else:
            out.append((turn, first, words))
    return out


def span_text(text: str, first: int, words: int) -> str:
    """Some words of a text with what stands between them; all words: the text as it is."""
    import re

    ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    if words >= len(ends):
        return text
    return text[ends[first][0] : ends[first + words - 1][1]]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, with the same columns.

    Each run of words taken in one pass is a row with the document's id: the whole text where
    all of it is taken, else the words of the run; ``n_chars`` is set to the text's length.
    Documents of which nothing is taken are gone; documents without words are never taken.
    """
    columns = docs.columns
    row_name, taken_name = unused(columns, "_row", "_pieces")
    keyed = written(docs.withColumn(row_name, F.monotonically_increasing_id()), "mix-documents")
    narrow = keyed.select(F.col(row_name).alias("row"), "doc_id", "source", "text")
    sized = written(with_sizes(narrow, ["row", "doc_id", "source"]), "mix-sizes")
    pieces = mixture(sized, source_plan(sized)).groupBy("row").agg(
        F.collect_list(F.struct("pass", "first_word", "n_words")).alias(taken_name)
    )
    joined = keyed.join(pieces, keyed[row_name] == pieces["row"])
    joined = joined.select(*[keyed[c] for c in columns], pieces[taken_name])
    schema = StructType([docs.schema[name] for name in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for row in part.to_pylist():
                    taken = [(p["pass"], p["first_word"], p["n_words"]) for p in row.pop(taken_name)]
                    for _, first, words in runs(taken):
                        text = span_text(row["text"], first, words)
                        rows.append(row | {"text": text} | ({"n_chars": len(text)} if "n_chars" in row else {}))
                types = pa.schema([part.schema.field(name) for name in columns])
                yield pa.RecordBatch.from_pylist(rows, types)

    return joined.mapInArrow(run, schema)
