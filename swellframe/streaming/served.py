"""The request stream with everything the service answers from what is stored.

One classification of the arriving requests feeds all tables of a folder: first answers per
cell, labels of response lifetimes, request facts, error rows, location counters and counts
per day. A step first adds its requests to the first answers and labels, which tell what is
served without asking upstream, and then loads the facts that follow. Every table takes a
step once, so a step may be repeated at any point. On requests that arrive in order the
tables equal those of ``served.service_rows`` over all of them; what was once logged stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from swellframe.operators.facts import cache_requests, countable, error_rows, request_facts
from swellframe.operators.geocode import CELL, first_seen_cell, geocode_resolve, merge_first_answers, with_cell
from swellframe.operators.reports import backend_days, cell_days, reason_days
from swellframe.operators.served import as_served, geocode_answers
from swellframe.sources import tables
from swellframe.sources.workspace import compiled, only_kept, written
from swellframe.streaming.response_cache import LABELS, label_arrivals

# What the tables are made of, of a classified request with the outcome that the service gave it.
LOGGED = (
    "id", "ts", "method", "path", "query", "request_body", "upstream_body", "kind",
    "backend", "status_code", "error_type", "message", "passed_on", "lat", "lng",
)
FIRSTS, REQUEST_LABELS = "first-answers", "labels"
REQUESTS, ERRORS, LOCATIONS, BACKENDS = "requests", "errors", "locations", "backend-days"
CELLS, REASONS = "cell-days", "reason-days"


def load_first_answers(answers: DataFrame, overrides: DataFrame, path: str, step: str) -> DataFrame:
    """Merges the first answers of the arriving requests into the stored ones, and gives those.

    Cells with an override are never asked for. ``answers`` is read twice.
    """
    asked = with_cell(answers.filter("answered")).join(overrides.select(*CELL), CELL, "left_anti")
    firsts = first_seen_cell(asked)
    spark = answers.sparkSession
    tables.merge_version(
        spark, path, tables.FIRST_ANSWERS, step, lambda stored: merge_first_answers(stored, firsts)
    )
    return tables.read_version(spark, path, tables.FIRST_ANSWERS)


def _merge_counts(path: str, schema: str, step: str, counts: DataFrame, sums: list[str]) -> None:
    keys = [name for name in counts.columns if name not in sums]
    tables.merge_version(
        counts.sparkSession, path, schema, step, lambda stored: tables.merge_sums(stored, counts, keys, sums)
    )


def load_served(landed: DataFrame, overrides: DataFrame, folder: str, step: str) -> None:
    """Loads classified requests that have landed into all tables under ``folder``."""
    spark = landed.sparkSession
    with only_kept(spark), compiled(spark):
        answers = written(geocode_answers(landed), "arriving-answers")
        firsts = load_first_answers(answers, overrides, f"{folder}/{FIRSTS}", step)
        places = geocode_resolve(answers, overrides, firsts).filter(F.col("source").isin("override", "cache"))
        requests = written(cache_requests(landed), "arriving-requests")
        label_arrivals(requests, f"{folder}/{REQUEST_LABELS}")
        hits = requests.select("id", F.col("ts").cast("date").alias("dt"))
        if tables.exists(spark, f"{folder}/{REQUEST_LABELS}"):
            days = [row["dt"] for row in hits.select("dt").distinct().collect()]
            labels = tables.read_by_day(spark, f"{folder}/{REQUEST_LABELS}", LABELS)
            labels = labels.filter(F.col("dt").isin(days) & (F.col("cache") == "HIT")).select("id", "dt")
            hits = hits.join(labels, ["id", "dt"], "left_semi")
        else:
            hits = hits.limit(0)
        served = places.select("id").unionByName(hits.select("id"))
        # Narrow, as the join sends every request.
        rows = written(as_served(landed.select(*LOGGED), served), "arriving-served")
        facts = request_facts(rows)
        tables.append_missing(facts, f"{folder}/{REQUESTS}", tables.REQUESTS)
        tables.append_missing(error_rows(rows), f"{folder}/{ERRORS}", tables.ERROR_LOGS)
        located = countable(rows).groupBy("lat", "lng").agg(F.count("*").alias("count"))
        _merge_counts(f"{folder}/{LOCATIONS}", tables.LOCATIONS, step, located, ["count"])
        _merge_counts(f"{folder}/{BACKENDS}", tables.BACKEND_DAYS, step, backend_days(facts), ["success", "failed"])
        _merge_counts(f"{folder}/{CELLS}", tables.CELL_DAYS, step, cell_days(facts), ["count"])
        _merge_counts(f"{folder}/{REASONS}", tables.REASON_DAYS, step, reason_days(facts), ["count"])
