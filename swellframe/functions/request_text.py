"""Normalised request parameters and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellframe.functions.numbers import fixed_two

# The weather parameters that may be asked for.
WEATHER_PARAMS = (
    "swellHeight",
    "swellPeriod",
    "swellDirection",
    "secondarySwellHeight",
    "secondarySwellPeriod",
    "secondarySwellDirection",
    "windDirection",
    "windSpeed",
)
WHITE_SPACE = " \t\n\r\f\x0b\x85\xa0"


def wanted_params(params: Column) -> Column:
    """Allowed names in a comma-separated list, order and repeats kept."""
    allowed = F.array(*[F.lit(name) for name in WEATHER_PARAMS])
    names = F.transform(
        F.split(F.coalesce(params, F.lit("")), ","),
        lambda name: F.btrim(name, F.lit(WHITE_SPACE)),
    )
    return F.filter(names, lambda name: F.array_contains(allowed, name))


def filter_params(params: Column) -> Column:
    """Comma-separated list reduced to the allowed names; empty if none is."""
    return F.array_join(wanted_params(params), ",")


def _key(*parts: Column) -> Column:
    # concat_ws skips nulls, which would shift the fields of a key.
    return F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])


def weather_key(
    lat: Column, lng: Column, params: Column, source: Column, start: Column, end: Column
) -> Column:
    """Cache key of a weather request. Params keep their order."""
    return _key(F.lit("weather"), fixed_two(lat), fixed_two(lng), params, source, start, end)


def tide_key(
    kind: Column, lat: Column, lng: Column, start: Column, end: Column, datum: Column
) -> Column:
    """Cache key of a tide request; ``kind`` is ``tides`` or ``sealevel``."""
    return _key(kind, fixed_two(lat), fixed_two(lng), start, end, datum)


def tide_label(high: Column) -> Column:
    """'high' or 'low' of a flag; a missing flag is low."""
    return F.when(F.coalesce(high, F.lit(False)), "high").otherwise("low")
