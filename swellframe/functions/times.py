"""Epoch conversion, request time windows and report cut-offs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# Time text pattern (up to the very end: "$" would allow a line break), epoch of the zero time, and window lengths.
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
)
WHOLE_NUMBER = r"^[+-]?[0-9]+\z"
ZERO_TIME_EPOCH = -62135596800
HOUR_SECONDS = 3600
DEFAULT_WINDOW_SECONDS = 24 * 3600
LONGEST_WINDOW_SECONDS = 7 * 24 * 3600
RETENTION_DAYS = 30


def _instant(text: Column) -> Column:
    """Instant of RFC 3339 text, null for any other text.

    The pattern comes first because a cast alone also takes dates and other forms. A
    comma before the fraction is rare, so the text is rewritten only where it has one.
    """
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp")).when(
        F.contains(text, F.lit(",")) & dotted.rlike(RFC3339), dotted.try_cast("timestamp")
    )


def to_epoch(text: Column) -> Column:
    """Unix seconds of RFC 3339 text; the zero time where it cannot be read."""
    return F.coalesce(F.unix_seconds(_instant(text)), F.lit(ZERO_TIME_EPOCH))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ read as UTC.

    Built from date parts: a cast to TIMESTAMP would depend on the session zone.
    """
    fraction = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    minutes = (F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)) * 60
    return (minutes + F.minute(ts)) * 60000000 + fraction


def epoch_to_rfc3339(number: Column) -> Column:
    """RFC 3339 text in UTC of a whole number of Unix seconds, else null."""
    seconds = F.when(number.rlike(WHOLE_NUMBER), number.try_cast("bigint"))
    of_day = F.pmod(seconds, F.lit(86400))
    day = F.floor(seconds / 86400).try_cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    # Calendar years 0 to 9999; outside them the text would not be RFC 3339.
    in_calendar = seconds.between(-62167219200, 253402300799)
    return F.when(
        in_calendar,
        F.concat(
            F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"),
            F.lit("T"),
            two(F.floor(of_day / 3600)),
            F.lit(":"),
            two(F.floor(F.pmod(of_day, F.lit(3600)) / 60)),
            F.lit(":"),
            two(F.pmod(of_day, F.lit(60))),
            F.lit("Z"),
        ),
    )


def _requested_micros(text: Column) -> Column:
    """Sub-second part, in microseconds, of a requested time (0 for epochs)."""
    instant = F.when(~text.rlike(WHOLE_NUMBER), F.unix_micros(_instant(text)))
    return F.coalesce(F.pmod(instant, F.lit(1000000)), F.lit(0))


def _requested_seconds(text: Column) -> Column:
    """Unix seconds of a requested time: epoch number, RFC 3339, or zero time."""
    number = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
    return F.coalesce(number, to_epoch(text))


def window_seconds(start: Column, end: Column, event_ts: Column) -> tuple[Column, Column]:
    """(start, end) in Unix seconds before alignment, fractions floored.

    A missing start is the time of the request itself, a missing end is 24 hours
    after the start; empty text counts as missing.
    """
    start, end = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    begins = F.when(start.isNull(), F.floor(epoch_micros(event_ts) / 1000000)).otherwise(
        _requested_seconds(start)
    )
    ends = F.when(end.isNull(), F.try_add(begins, F.lit(DEFAULT_WINDOW_SECONDS))).otherwise(
        _requested_seconds(end)
    )
    return begins, ends


def aligned_window(start: Column, end: Column, event_ts: Column) -> tuple[Column, Column]:
    """(start, end) in Unix seconds, start floored and end raised to the hour.

    The default end is taken from the unaligned start, so 10:30 without an end
    gives 10:00 to 11:00 next day. The window is cut to seven days. An end before
    the start is kept as it is.
    """
    begins, ends = window_seconds(start, end, event_ts)
    start_text, end_text = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    start_fraction = F.when(
        start_text.isNull(), F.pmod(epoch_micros(event_ts), F.lit(1000000))
    ).otherwise(_requested_micros(start_text))
    fraction = F.when(end_text.isNull(), start_fraction).otherwise(_requested_micros(end_text))
    hour = F.lit(HOUR_SECONDS)
    # A fraction only matters to the end, where it reaches into the next hour.
    past_hour = F.pmod(ends, hour)
    low = F.try_subtract(begins, F.pmod(begins, hour))
    high = F.when((past_hour == 0) & (fraction == 0), ends).otherwise(
        F.try_add(ends, hour - past_hour)
    )
    return low, F.least(high, F.try_add(low, F.lit(LONGEST_WINDOW_SECONDS)))


def cutoff(as_of: datetime, days: int) -> Column:
    """Constant TIMESTAMP_NTZ ``days`` before ``as_of``, in whole seconds."""
    bound = as_of.replace(microsecond=0) - timedelta(days=days)
    return F.lit(bound.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def cutoff_date(as_of: datetime, days: int) -> Column:
    """Constant DATE on which :func:`cutoff` falls."""
    bound = as_of.replace(microsecond=0) - timedelta(days=days)
    return F.lit(bound.strftime("%Y-%m-%d")).cast("date")
