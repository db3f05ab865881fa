"""Response lifetimes on requests that arrive in steps.

A stateless stream brings the narrow requests; a batch step labels the new ones. Labels and
stored responses are one table: a successful MISS has stored a response. New requests that a
stored response covers are HITs, late ones included. What is left is labelled by the batch
operator, which splits hot keys. On requests that arrive in order the labels equal those of
the batch operator. No request is ever dropped, and labels that were given out stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from swellframe.functions.times import epoch_micros
from swellframe.operators.facts import cache_requests, classify
from swellframe.operators.response_cache import LIFETIME_SECONDS, ttl_labels
from swellframe.sources import tables
from swellframe.sources.workspace import written

LABELS = (
    "id BIGINT, ts TIMESTAMP_NTZ, cache_key STRING, success BOOLEAN, cache STRING, dt DATE"
)


def cache_request_stream(
    access_log: DataFrame, allowed_apps: Sequence[str] = (), default_key: str = ""
) -> DataFrame:
    """Access log stream as a stateless stream of the requests that reach the cache."""
    return cache_requests(classify(access_log, allowed_apps, default_key))


def _covered(requests: DataFrame, stored: DataFrame, lifetime: int) -> DataFrame:
    """Ids of requests that fall into the lifetime of a stored response.

    A response covers at most the bucket of its time and the next, so this is an equi-join.
    """
    bucket = lambda at: F.floor(at / F.lit(lifetime))
    at = F.col("at")
    responses = stored.select(
        "cache_key",
        F.col("at").alias("stored_at"),
        F.col("id").alias("stored_id"),
        F.explode(F.array(bucket(at), bucket(at) + 1)).alias("bucket"),
    )
    asked = requests.select("id", "cache_key", "at", bucket(at).alias("bucket"))
    after = (at > F.col("stored_at")) | ((at == F.col("stored_at")) & (F.col("id") > F.col("stored_id")))
    covering = after & (at < F.col("stored_at") + lifetime)
    return asked.join(responses, ["cache_key", "bucket"]).filter(covering).select("id").distinct()


def label_arrivals(arrivals: DataFrame, path: str, lifetime_seconds: int = LIFETIME_SECONDS) -> None:
    """Labels the requests that the label table does not have yet, and adds them to it.

    Every id ends up in the table once, however often a step is run.
    """
    spark, lifetime = arrivals.sparkSession, lifetime_seconds * 1_000_000
    at = epoch_micros(F.col("ts"))
    dated = arrivals.withColumn("dt", F.col("ts").cast("date"))
    new = written(tables.missing_rows(dated, path, LABELS).withColumn("at", at), "arrivals")
    first = new.agg(F.min("ts").alias("ts")).first()["ts"]
    if first is None:
        return
    # Older responses cover none of the new requests; the day limit prunes folders.
    since = F.lit(first).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(lifetime_seconds)} SECOND")
    known = tables.read_by_day(spark, path, LABELS) if tables.exists(spark, path) else None
    if known is None:
        rest = new
        hits = None
    else:
        stored = known.filter((F.col("dt") >= since.cast("date")) & (F.col("ts") >= since))
        stored = stored.filter(F.col("success") & (F.col("cache") == "MISS")).withColumn("at", at)
        covered = written(_covered(new, stored, lifetime), "covered-arrivals")
        hits = new.join(covered, "id", "left_semi").withColumn("cache", F.lit("HIT"))
        rest = new.join(covered, "id", "left_anti")
    labelled = ttl_labels(rest.select("id", "ts", "cache_key", "success"), lifetime_seconds)
    labelled = labelled.withColumn("dt", F.col("ts").cast("date"))
    columns = ["id", "ts", "cache_key", "success", "cache", "dt"]
    if hits is not None:
        labelled = labelled.unionByName(hits.select(columns))
    tables.append_by_day(written(labelled.select(columns), "new-labels"), path)
