"""Fixed response lifetimes per cache key.

A request is a HIT while an earlier stored response of its key is younger than the
lifetime. Otherwise it is a MISS, and a successful MISS stores a response whose lifetime
starts then. HITs do not extend a lifetime and failures do not start one.

So the stored responses ("writes") of a key form a chain: the first success, then each
time the first success at least one lifetime after the last write. With buckets as long
as the lifetime there is at most one write per key and bucket, and a write covers only
its own bucket and the next. The work is therefore: find the writes, then join every
request to the at most two writes that may cover it.

Finding the writes never holds all requests of a key:

* Requests are first reduced to distinct success times per key, with partial aggregation.
* A gap of a lifetime or more always starts a new chain. Such gaps lie between buckets,
  so chains ("runs") are found on one row per key and bucket.
* Runs of a bounded number of success times are folded as one sorted array.
* Longer runs, such as those of a hot key, are solved by joins: see :func:`_long_run_writes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from swellframe.functions.times import HOUR_SECONDS, epoch_micros
from swellframe.sources.workspace import written

# Fixed value: lifetime of a stored response.
LIFETIME_SECONDS = HOUR_SECONDS

# Most success times of one run that are folded as an array in one task.
FOLDED_RUN = 8192

# Slots per lifetime in which a long run's times are matched with their successors.
SLOTS_PER_LIFETIME = 3600

# Slots of a run are scanned in blocks of 2 ** BLOCK_BITS, and blocks in blocks of blocks.
# Three levels of them hold more slots than there are seconds in 2,000 years.
BLOCK_BITS = 12
BLOCK_LEVELS = 3

RUN = ["cache_key", "run"]


def ttl_labels(
    requests: DataFrame,
    lifetime_seconds: int = LIFETIME_SECONDS,
    folded_run: int = FOLDED_RUN,
) -> DataFrame:
    """``requests`` with ``cache`` set to HIT or MISS.

    ``requests`` has ``id, ts, cache_key, success`` and holds only requests that reach
    the cache. Requests of a key are taken in order of ``ts, id``. They are read three
    times, so rows that are costly to compute should be stored first.
    """
    lifetime = lifetime_seconds * 1_000_000
    timed = requests.withColumn("_at", epoch_micros(F.col("ts"))).withColumn(
        "_bucket", _whole(F.col("_at"), lifetime)
    )
    writes = _writes(timed, lifetime, folded_run)
    covers = _covers(writes, lifetime)
    after_write = (F.col("_at") > F.col("write_at")) | (
        (F.col("_at") == F.col("write_at")) & (F.col("id") > F.col("write_id"))
    )
    covered = (F.col("_at") < F.col("earlier_at") + lifetime) | after_write
    return (
        timed.join(covers, ["cache_key", "_bucket"], "left")
        .withColumn("cache", F.when(covered, "HIT").otherwise("MISS"))
        .select(*requests.columns, "cache")
    )


def _whole(at: Column, length: int) -> Column:
    """Number of whole lengths in a time. Only multiples are divided, so this is exact."""
    return ((at - F.pmod(at, F.lit(length))) / length).cast("bigint")


def upstream_calls(labelled: DataFrame) -> DataFrame:
    """Requests, hits and needed upstream calls per cache key."""
    return labelled.groupBy("cache_key").agg(
        F.count("*").alias("requests"),
        F.count(F.when(F.col("cache") == "HIT", 1)).alias("hits"),
        F.count(F.when(F.col("cache") == "MISS", 1)).alias("upstream_calls"),
    )


def _writes(timed: DataFrame, lifetime: int, folded_run: int) -> DataFrame:
    """Stored responses as ``(cache_key, at, write_id)``."""
    successes = (
        timed.filter("success")
        .groupBy("cache_key", F.col("_bucket").alias("bucket"), F.col("_at").alias("at"))
        .agg(F.min("id").alias("write_id"))
    )
    # Written out once: the size of the runs decides how they are solved.
    runs = written(_runs(successes, lifetime), "cache-runs")
    short = runs.filter(F.col("run_size") <= folded_run)
    long = runs.filter(F.col("run_size") > folded_run)
    member = ["cache_key", "bucket"]
    writes = _fold(successes.join(short.select(*member, "run"), member), lifetime)
    if not long.isEmpty():
        in_run = successes.join(
            long.select(*member, "run", "run_bucket", F.col("first_at")), member
        )
        last_bucket = long.agg(F.max("run_bucket")).first()[0]
        writes = writes.unionByName(_long_run_writes(in_run, last_bucket, lifetime))
    return writes


def _runs(successes: DataFrame, lifetime: int) -> DataFrame:
    """One row per key and bucket with its run and the size of that run.

    The window sees one row per key and bucket, so its size depends on the time
    covered (24 rows a day for an hour's lifetime), not on the number of requests.
    """
    buckets = successes.groupBy("cache_key", "bucket").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("size")
    )
    in_order = Window.partitionBy("cache_key").orderBy("bucket")
    gap = F.col("first_at") - F.lag("last_at").over(in_order)
    starts = F.when(F.coalesce(gap, F.lit(lifetime)) >= lifetime, F.col("bucket"))
    whole = Window.partitionBy(*RUN)
    return (
        buckets.withColumn("run", F.last(starts, ignorenulls=True).over(in_order))
        .withColumn("run_size", F.sum("size").over(whole))
        .withColumn("run_bucket", F.col("bucket") - F.col("run"))
        .select("cache_key", "bucket", "run", "run_bucket", "run_size", "first_at")
    )


def _fold(successes: DataFrame, lifetime: int) -> DataFrame:
    """Writes of runs that are small enough to be sorted as one array."""
    times = F.array_sort(F.collect_list(F.struct("at", "write_id")))
    nothing = F.array().cast("ARRAY<STRUCT<at: BIGINT, write_id: BIGINT>>")

    def step(chain: Column, time: Column) -> Column:
        return F.when(
            time["at"] >= chain["open_from"],
            F.struct(
                (time["at"] + lifetime).alias("open_from"),
                F.concat(chain["writes"], F.array(time)).alias("writes"),
            ),
        ).otherwise(chain)

    empty = F.struct(F.lit(-(2**63)).alias("open_from"), nothing.alias("writes"))
    chain = F.aggregate(F.col("times"), empty, step, lambda chain: chain["writes"])
    return (
        successes.groupBy(*RUN)
        .agg(times.alias("times"))
        .select("cache_key", F.explode(chain).alias("write"))
        .select("cache_key", "write.at", "write.write_id")
    )


def _covers(writes: DataFrame, lifetime: int) -> DataFrame:
    """Per key and bucket, the write in it and the write in the bucket before."""
    bucket = _whole(F.col("at"), lifetime)
    here = F.struct(
        bucket.alias("_bucket"),
        F.col("at").alias("write_at"),
        F.col("write_id").alias("write_id"),
        F.lit(None).cast("bigint").alias("earlier_at"),
    )
    next_one = F.struct(
        (bucket + 1).alias("_bucket"),
        F.lit(None).cast("bigint").alias("write_at"),
        F.lit(None).cast("bigint").alias("write_id"),
        F.col("at").alias("earlier_at"),
    )
    return (
        writes.select("cache_key", F.inline(F.array(here, next_one)))
        .groupBy("cache_key", "_bucket")
        .agg(*[F.max(name).alias(name) for name in ("write_at", "write_id", "earlier_at")])
    )


def _successors(in_run: DataFrame, lifetime: int) -> DataFrame:
    """Success times of long runs with ``next_at``, the write that would follow.

    That is the first success at least one lifetime later. Times and the points to look
    up are matched within short slots of a run; where a slot has no later success, the
    first one of the next slot that has any is taken (:func:`_first_in_later_slots`). Slots
    hold at most two rows per microsecond, and the slot table a row per slot, however many
    requests there are.
    """
    slot_length = max(1, lifetime // SLOTS_PER_LIFETIME)
    success = F.struct(
        F.col("at").alias("point"), F.col("at").alias("found"), F.lit(None).cast("bigint").alias("asks")
    )
    question = F.struct(
        (F.col("at") + lifetime).alias("point"),
        F.lit(None).cast("bigint").alias("found"),
        F.col("at").alias("asks"),
    )
    points = in_run.select(*RUN, F.inline(F.array(success, question))).withColumn(
        "slot", _whole(F.col("point"), slot_length)
    )
    # Downwards in time, a success before a question at the same time.
    seen = (
        Window.partitionBy(*RUN, "slot")
        .orderBy(F.desc("point"), F.col("asks").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    slots = _first_in_later_slots(
        points.groupBy(*RUN, "slot").agg(F.min("found").alias("first_found"))
    )
    asked = points.withColumn("in_slot", F.last("found", ignorenulls=True).over(seen)).filter(
        F.col("asks").isNotNull()
    )
    return asked.join(slots, [*RUN, "slot"]).select(
        *RUN, F.col("asks").alias("at"), F.coalesce("in_slot", "later").alias("next_at")
    )


def _first_in_later_slots(slots: DataFrame) -> DataFrame:
    """``slots`` with ``later``, the first success of the next slot of the run that has any.

    A scan by blocks: a block's summary is its first success, and so is that of a block of
    blocks. From the highest level down, a row takes the next success of its own block, or
    else what its block has taken on the level above. No task orders more than one block of
    a run, whatever time the run covers.
    """
    levels = [slots.withColumnRenamed("slot", "place")]
    for _ in range(BLOCK_LEVELS - 1):
        levels.append(
            levels[-1]
            .groupBy(*RUN, F.shiftright("place", BLOCK_BITS).alias("place"))
            .agg(F.min("first_found").alias("first_found"))
        )
    carried = None
    for level in reversed(levels):
        block = F.shiftright("place", BLOCK_BITS)
        higher = (
            Window.partitionBy(*RUN, "block")
            .orderBy(F.desc("place"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        in_block = F.last("first_found", ignorenulls=True).over(higher)
        scanned = level.withColumn("block", block).withColumn("later", in_block)
        if carried is None:
            # Blocks of the highest level follow each other as rows do; a run has one or two.
            over_blocks = Window.partitionBy(*RUN).orderBy(F.desc("block"))
            ends = scanned.groupBy(*RUN, "block").agg(F.min("first_found").alias("end"))
            before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
            carry = ends.withColumn("carry", F.last("end", ignorenulls=True).over(before)).drop("end")
        else:
            carry = carried.select(*RUN, F.col("place").alias("block"), F.col("later").alias("carry"))
        carried = scanned.join(carry, [*RUN, "block"]).select(
            *RUN, "place", F.coalesce("later", "carry").alias("later")
        )
    return carried.withColumnRenamed("place", "slot")


def _long_run_writes(in_run: DataFrame, last_bucket: int, lifetime: int) -> DataFrame:
    """Writes of long runs, found with joins whose number grows with log(buckets).

    Buckets of a run are paired into blocks of 2, 4, 8, ... up to the whole run. A hop
    leads from a time by which a chain can enter a block to the first write behind that
    block. The hop of a block is the hop of its first half followed, if that ends in the
    second half, by the hop from there. Entry times lie in a block's first bucket, or
    are the first success of its second bucket, so every level has about half the rows
    of the one below. Going back down from the run's first success, the hops of each
    level add the entries of the second halves, until every bucket's write is known.
    """
    levels = int(last_bucket).bit_length()
    first = F.col("at") == F.col("first_at")
    base = written(in_run.withColumn("bucket_first", first), "cache-times")
    place = [*RUN, "at"]
    known = base.select(*place, "run_bucket", "bucket_first")
    hops = [written(_successors(base, lifetime).join(known, place), "cache-hops")]
    for level in range(levels - 1):
        hops.append(written(_joined_hops(hops[level], level), "cache-hops"))
    entries = base.filter((F.col("run_bucket") == 0) & F.col("bucket_first")).select(
        *place, "run_bucket"
    )
    # Stored level by level, so that no plan holds the joins of them all.
    for level in reversed(range(levels)):
        entries = written(_second_half_entries(entries, hops[level], level), "cache-entries")
    return entries.join(base.select(*place, "write_id").hint("merge"), place).select(
        "cache_key", "at", "write_id"
    )


def _block(bucket: Column, level: int) -> Column:
    return F.shiftright(bucket, level)


def _joined_hops(hops: DataFrame, level: int) -> DataFrame:
    """Hops over blocks of twice the length of those of ``level``.

    Hops grow with the requests, and stored they take far less room than in memory: joins with
    them are merged, never sent through the driver.
    """
    size = 2 ** (level + 1)
    offset = F.pmod(F.col("run_bucket"), F.lit(size))
    entering = hops.filter((offset == 0) | ((offset == 1) & F.col("bucket_first")))
    onward = hops.select(
        *RUN,
        F.col("at").alias("next_at"),
        F.col("run_bucket").alias("_half_bucket"),
        F.col("next_at").alias("_onward_at"),
    )
    same_block = _block(F.col("run_bucket"), level + 1) == _block(F.col("_half_bucket"), level + 1)
    return entering.join(onward.hint("merge"), [*RUN, "next_at"], "left").select(
        *RUN,
        "at",
        F.when(same_block, F.col("_onward_at")).otherwise(F.col("next_at")).alias("next_at"),
        "run_bucket",
        "bucket_first",
    )


def _second_half_entries(entries: DataFrame, hops: DataFrame, level: int) -> DataFrame:
    """Entries of blocks of ``level + 1``, with those of their second halves added."""
    hop = hops.select(*RUN, "at", "next_at")
    target = hops.select(
        *RUN, F.col("at").alias("next_at"), F.col("run_bucket").alias("next_bucket")
    )
    onward = entries.join(hop.hint("merge"), [*RUN, "at"], "left")
    joined = onward.join(target.hint("merge"), [*RUN, "next_at"], "left")
    inside = _block(F.col("run_bucket"), level + 1) == _block(F.col("next_bucket"), level + 1)
    own = F.struct(F.col("at"), F.col("run_bucket"))
    reached = F.when(
        inside, F.struct(F.col("next_at").alias("at"), F.col("next_bucket").alias("run_bucket"))
    )
    return joined.select(
        *RUN, F.explode(F.filter(F.array(own, reached), lambda e: e.isNotNull())).alias("entry")
    ).select(*RUN, "entry.*")
