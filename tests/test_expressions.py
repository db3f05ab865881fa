"""Rounding, parsing, time windows, query text and cache keys."""

from __future__ import annotations

import math
import random
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from swellframe.functions import grid, numbers, query_text, request_text, times
from swellframe.operators.reports import days_requested

NOW = datetime(2024, 3, 5, 10, 30, 0, 250000)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "value, precision, want",
    [
        (1.23456, 2, 1.23),
        (1.23556, 2, 1.24),
        (-1.23456, 2, -1.23),
        (10.5, 0, 11.0),
        (-10.5, 0, -11.0),
        (1.005, 2, 1.0),
        (0.49999999999999994, 0, 0.0),
        (1e300, 2, 1e300),
        (float("-inf"), 2, float("-inf")),
    ],
)
def test_round_half_away(spark, value, precision, want):
    (got,) = one(spark, numbers.round_half_away(F.lit(value), precision))
    assert got == pytest.approx(want, rel=1e-15)


def test_round_equals_exact_arithmetic(spark):
    pick = random.Random(7)
    values = [pick.uniform(-200, 200) for _ in range(500)]
    values += [n / 200 for n in range(-300, 300)] + [2.0**e + d for e in range(45, 54) for d in (0.25, 0.5, 1.5)]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(
        "v", numbers.round_half_away(F.col("v"), 2).alias("cents"), numbers.round_half_away(F.col("v")).alias("whole")
    )

    def exact(scaled):
        return float(Decimal(scaled).quantize(Decimal(1), ROUND_HALF_UP))

    for row in rows.collect():
        assert row.cents == exact(row.v * 100) / 100
        assert row.whole == exact(row.v)


def test_round_gives_no_negative_zero_and_keeps_nan(spark):
    zero, nan = one(
        spark,
        numbers.round_half_away(F.lit(-0.001), 2),
        numbers.round_half_away(F.lit(float("nan")), 2),
    )
    assert math.copysign(1, zero) == 1 and math.isnan(nan)


@pytest.mark.parametrize(
    "value, want",
    [(0.0, True), (180.0, True), (-180.0, True), (181.0, False), (-181.0, False),
     (float("nan"), False)],
)
def test_coordinate_range(spark, value, want):
    assert one(spark, grid.valid_coordinate(F.lit(value))) == (want,)


@pytest.mark.parametrize(
    "text, lenient, strict",
    [
        ("1.5", 1.5, 1.5),
        ("-.5e1", -5.0, -5.0),
        ("5.", 5.0, 5.0),
        (" 1.5 ", 0.0, None),
        ("1.5d", 0.0, None),
        ("1_0", 0.0, None),
        ("", 0.0, None),
        ("abc", 0.0, None),
        ("0x1p-2", 0.25, 0.25),
        ("inf", math.inf, math.inf),
        ("1e999", math.inf, None),
    ],
)
def test_parse_float(spark, text, lenient, strict):
    got = one(spark, numbers.parse_float_lenient(F.lit(text)), numbers.parse_float_strict(F.lit(text)))
    assert got == (lenient, strict)


def window(spark, start, end):
    as_text = lambda value: F.lit(value).cast("string")
    return one(
        spark,
        *times.aligned_window(as_text(start), as_text(end), F.lit(NOW.isoformat(" ")).cast("timestamp_ntz")),
    )


HOUR = 3600
TEN = 1709632800  # 2024-03-05T10:00:00Z


def test_window_defaults(spark):
    assert window(spark, str(TEN), None) == (TEN, TEN + 24 * HOUR)
    assert window(spark, None, None) == (TEN, TEN + 25 * HOUR)
    assert window(spark, "", "") == (TEN, TEN + 25 * HOUR)
    assert window(spark, str(TEN + 1800), None) == (TEN, TEN + 25 * HOUR)


def test_window_is_cut_to_seven_days(spark):
    assert window(spark, str(TEN), str(TEN + 10 * 24 * HOUR)) == (TEN, TEN + 7 * 24 * HOUR)


def test_window_times_as_text(spark):
    start, end = "2024-03-05T15:59:59.9+05:30", "2024-03-05T12:00:00.000001Z"
    assert window(spark, start, end) == (TEN, TEN + 3 * HOUR)
    assert window(spark, "2024-03-05T10:59:59,9Z", "2024-03-05T12:00:00Z") == (TEN, TEN + 2 * HOUR)


def test_window_of_unreadable_and_reversed_times(spark):
    zero = times.ZERO_TIME_EPOCH
    assert window(spark, "yesterday", str(TEN)) == (zero, zero + 7 * 24 * HOUR)
    assert window(spark, "2024-03-05", "x") == (zero, zero)
    assert window(spark, str(TEN), str(TEN - 5 * HOUR)) == (TEN, TEN - 5 * HOUR)
    # Out of range of a 64-bit number, and at its end: no error either way.
    assert window(spark, "99999999999999999999", None)[0] == zero
    window(spark, str(2**63 - 1), str(-(2**63)))


def test_to_epoch_takes_rfc3339_only(spark):
    texts = ["2024-03-05T10:00:00Z", "2024-03-05T10:00:00.999Z", "2024-03-05", "2024-03-05 10:00:00Z", ""]
    got = one(spark, *[times.to_epoch(F.lit(text)) for text in texts])
    assert got == (TEN, TEN, *[times.ZERO_TIME_EPOCH] * 3)


def test_epoch_to_rfc3339(spark):
    got = one(spark, *[times.epoch_to_rfc3339(F.lit(t)) for t in (str(TEN), "-1", "x", "", "9" * 18)])
    assert got == ("2024-03-05T10:00:00Z", "1969-12-31T23:59:59Z", None, None, None)


def test_epoch_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ts = F.lit("2024-03-10 02:30:00.5").cast("timestamp_ntz")
        assert one(spark, times.epoch_micros(ts)) == (1710037800500000,)
        assert one(spark, times.to_epoch(F.lit("2024-03-05T10:00:00Z"))) == (TEN,)
        assert one(spark, times.epoch_to_rfc3339(F.lit(str(TEN)))) == ("2024-03-05T10:00:00Z",)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "query, want",
    [
        ("lat=1&lng=2", ("1", "2")),
        ("lat=1&lat=9&lng=", ("1", "")),
        ("lng=a%2Cb+c", (None, "a,b c")),
        ("l%61t=5&lng", ("5", "")),
        ("lat=%zz&lat=7", ("7", None)),
        ("lat=1;lng=2&lng=3", (None, "3")),
        ("xlat=1&&lng=a=b", (None, "a=b")),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_query_values(spark, query, want):
    rows = spark.createDataFrame([(query,)], "query STRING")
    assert tuple(query_text.with_query_values(rows).select("q.lat", "q.lng").first()) == want


def test_filter_params_keeps_order_and_repeats(spark):
    text = " windSpeed,nope,swellHeight ,windSpeed,,"
    assert one(spark, request_text.filter_params(F.lit(text))) == ("windSpeed,swellHeight,windSpeed",)


def test_cache_keys(spark):
    got = one(
        spark,
        request_text.weather_key(
            F.lit(0.125), F.lit(-0.001), F.lit("b,a"), F.lit("noaa"), F.lit(3600), F.lit(7200)
        ),
        request_text.tide_key(
            F.lit("tides"), F.lit(1.015), F.lit(2.675), F.lit(0), F.lit(1), F.lit(None).cast("string")
        ),
    )
    assert got == ("weather:0.12:-0.00:b,a:noaa:3600:7200", "tides:1.01:2.67:0:1:")


def test_labels_radius_and_days(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, *[request_text.tide_label(c) for c in (F.lit(True), F.lit(False), null)]) == (
        "high", "low", "low",
    )
    assert one(spark, *[numbers.marker_radius(F.lit(n)) for n in (1, 12, 400)]) == (5, 12, 20)
    assert [days_requested(text) for text in ("7", "x", None, "-1")] == [7, 0, 0, -1]
