"""The request pipeline as streams: classified once, then loaded into its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from swellframe.operators.facts import classify, countable, error_rows, request_facts
from swellframe.operators.reports import backend_days
from swellframe.sources import tables


def classified_stream(
    access_log: DataFrame, allowed_apps: Sequence[str] = (), default_key: str = ""
) -> DataFrame:
    """Access log stream as a stateless stream of classified requests."""
    return classify(access_log, allowed_apps, default_key)


def load_requests(landed: DataFrame, path: str) -> None:
    """Adds the request facts that the day table does not have yet."""
    tables.append_missing(request_facts(landed), path, tables.REQUESTS)


def load_errors(landed: DataFrame, path: str) -> None:
    """Adds the error rows that the day table does not have yet."""
    tables.append_missing(error_rows(landed), path, tables.ERROR_LOGS)


def load_locations(landed: DataFrame, path: str, source: str) -> None:
    """Merges the countable requests of one landing folder into the location counters."""
    tables.merge_version(
        landed.sparkSession, path, tables.LOCATIONS, source,
        lambda counters: tables.merge_locations(counters, countable(landed)),
    )


def load_backend_days(landed: DataFrame, path: str, source: str) -> None:
    """Merges the requests of one landing folder into the counts per day and backend."""
    tables.merge_version(
        landed.sparkSession, path, tables.BACKEND_DAYS, source,
        lambda counts: tables.merge_sums(
            counts, backend_days(request_facts(landed)), ["dt", "backend"], ["success", "failed"]
        ),
    )
