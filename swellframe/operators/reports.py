"""Usage reports over request facts and error rows.

Every report takes an explicit ``as_of``; none reads the clock. ``days`` of 0 or less
means no time limit.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from swellframe.functions.numbers import marker_radius
from swellframe.functions.times import cutoff, cutoff_date

# Report sizes.
TOP_REASONS = 10
RECENT_ERRORS = 50


def days_requested(text: str | None) -> int:
    """Days from a report request; text that is no number means no limit."""
    # Python's int() would also take blanks, underscores and digits of other scripts.
    return int(text) if re.fullmatch("[+-]?[0-9]+", text or "") else 0


def last_n_days(rows: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Rows from ``as_of`` minus ``days`` on, the bound included.

    A partition column ``dt`` is limited as well, because Spark does not derive that
    from the limit on ``ts``.
    """
    if days <= 0:
        return rows
    recent = rows.filter(F.col("ts") >= cutoff(as_of, days))
    if "dt" in rows.columns:
        recent = recent.filter(F.col("dt") >= cutoff_date(as_of, days))
    return recent


def lifetime_locations(locations: DataFrame) -> DataFrame:
    """Count per cell over all time, from the cells of countable requests."""
    return locations.groupBy("lat", "lng").agg(F.count("*").alias("count"))


def windowed_locations(facts: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Count per cell of the last ``days``, requests of any status."""
    return (
        last_n_days(facts, as_of, days)
        .filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy("lat", "lng")
        .agg(F.count("*").alias("count"))
    )


def cell_days(facts: DataFrame) -> DataFrame:
    """Requests per day and cell, whatever their status, to be added up over the days."""
    placed = facts.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return placed.groupBy("dt", "lat", "lng").agg(F.count("*").alias("count"))


def reason_days(facts: DataFrame) -> DataFrame:
    """Failures per day and error type, to be added up over the days."""
    failed = facts.filter((F.col("status_code") >= 400) & (F.col("error_type") != ""))
    return failed.groupBy("dt", F.col("error_type").alias("reason")).agg(F.count("*").alias("count"))


def _added_up(daily: DataFrame, facts: DataFrame, roll_up, as_of: datetime, days: int, keys: list[str]) -> DataFrame:
    """Counts of the last days: whole days from ``daily``, the day of the cut-off from its rows."""
    if days > 0:
        border = cutoff_date(as_of, days)
        cut = facts.filter((F.col("dt") == border) & (F.col("ts") >= cutoff(as_of, days)))
        daily = daily.filter(F.col("dt") > border).unionByName(roll_up(cut))
    return daily.groupBy(*keys).agg(F.sum("count").alias("count"))


def windowed_locations_by_day(daily: DataFrame, facts: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """:func:`windowed_locations` from stored :func:`cell_days` and day-partitioned facts, of
    which one day is read."""
    return _added_up(daily, facts, cell_days, as_of, days, ["lat", "lng"])


def failure_reasons_by_day(
    daily: DataFrame, facts: DataFrame, as_of: datetime, days: int = 0, top: int = TOP_REASONS
) -> DataFrame:
    """:func:`failure_reasons` from stored :func:`reason_days` and day-partitioned facts, of
    which one day is read."""
    counts = _added_up(daily, facts, reason_days, as_of, days, ["reason"])
    return counts.orderBy(F.desc("count"), F.asc("reason")).limit(top)


def location_report(
    facts: DataFrame, counters: DataFrame, as_of: datetime, days: int
) -> DataFrame:
    """Locations for the map: lifetime counters, or log rows of the last days."""
    source = windowed_locations(facts, as_of, days) if days > 0 else counters
    return source.select("lat", "lng", "count", marker_radius(F.col("count")).alias("radius"))


def backend_days(facts: DataFrame) -> DataFrame:
    """Successes and failures per day and backend, to be added up over the days."""
    return facts.groupBy("dt", "backend").agg(
        F.count_if(F.col("status_code") < 400).alias("success"),
        F.count_if(F.col("status_code") >= 400).alias("failed"),
    )


def backend_stats(facts: DataFrame, as_of: datetime, days: int = 0) -> DataFrame:
    """Successful and failed requests per backend."""
    return (
        last_n_days(facts, as_of, days)
        .groupBy("backend")
        .agg(
            F.count(F.when(F.col("status_code") < 400, 1)).alias("success"),
            F.count(F.when(F.col("status_code") >= 400, 1)).alias("failed"),
        )
    )


def overall_totals(stats: DataFrame) -> DataFrame:
    """Successful, failed and all requests over all backends."""
    success = F.coalesce(F.sum("success"), F.lit(0))
    failed = F.coalesce(F.sum("failed"), F.lit(0))
    return stats.agg(
        success.alias("success"), failed.alias("failed"), (success + failed).alias("total")
    )


def failure_reasons(
    facts: DataFrame, as_of: datetime, days: int = 0, top: int = TOP_REASONS
) -> DataFrame:
    """Most frequent error types; equal counts are ordered by name."""
    return (
        last_n_days(facts, as_of, days)
        .filter((F.col("status_code") >= 400) & (F.col("error_type") != ""))
        .groupBy(F.col("error_type").alias("reason"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("reason"))
        .limit(top)
    )


def recent_errors(
    errors: DataFrame, as_of: datetime, days: int = 0, newest: int = RECENT_ERRORS
) -> DataFrame:
    """Newest error rows first; equal times are ordered by id."""
    return (
        last_n_days(errors, as_of, days)
        .orderBy(F.desc("ts"), F.desc("id"))
        .limit(newest)
        .drop("dt")
    )


def error_view(errors: DataFrame) -> DataFrame:
    """Error rows as shown: 'N/A' for a missing request or upstream body."""
    shown = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("N/A"))
    return errors.withColumns(
        {name: shown(name) for name in ("request_body", "upstream_response")}
    )
