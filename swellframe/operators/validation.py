"""Request validation per kind of route.

``q`` is the struct of query values of ``with_query_values``. Each check returns ``STRUCT<status_code, error_type, message>`` for the first rule a
request breaks, and null for a request that may go on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellframe.functions.grid import valid_coordinate
from swellframe.functions.numbers import parse_float_strict
from swellframe.functions.query_text import given
from swellframe.functions.request_text import wanted_params

# Error types, messages, and the accepted source and datums.
INVALID_COORDINATES = "Invalid Coordinates"
NOT_NUMBERS = "lat and lng must be valid numbers"
OUT_OF_RANGE = "coordinates must be between -180 and 180"
COORDINATES_REQUIRED = "latitude and longitude are required"
UNSUPPORTED_SOURCE = ("Unsupported Source", "Only 'noaa' source is supported so far")
NO_VALID_PARAMS = ("No Valid Params", "No valid parameters requested")
INVALID_DATUM = ("Invalid Datum", "Invalid datum. Allowed values: LAT, MSL, MLLW")
ONLY_SOURCE = "noaa"
DATUMS = ("", "LAT", "MSL", "MLLW")

REJECTION = "STRUCT<status_code: INT, error_type: STRING, message: STRING>"


def rejection(status_code: int | Column, error_type: str | Column, message: str | Column) -> Column:
    """One rejection; plain values are taken as constants."""
    column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        column(status_code).cast("int").alias("status_code"),
        column(error_type).alias("error_type"),
        column(message).alias("message"),
    ).cast(REJECTION)


def _bad_request(error_type: str, message: str) -> Column:
    return rejection(400, error_type, message)


def _numeric_coordinates(q: Column) -> Column:
    """The two checks shared by the routes that parse coordinates strictly."""
    lat, lng = parse_float_strict(q["lat"]), parse_float_strict(q["lng"])
    return F.when(
        lat.isNull() | lng.isNull(), _bad_request(INVALID_COORDINATES, NOT_NUMBERS)
    ).when(
        ~valid_coordinate(lat) | ~valid_coordinate(lng),
        _bad_request(INVALID_COORDINATES, OUT_OF_RANGE),
    )


def _coordinates_given(q: Column) -> Column:
    """The presence check of the routes that pass coordinates on as text."""
    missing = (given(q["latitude"]) == "") | (given(q["longitude"]) == "")
    return F.when(missing, _bad_request(INVALID_COORDINATES, COORDINATES_REQUIRED))


def weather_source(q: Column) -> Column:
    """Requested source. Only an absent one gets the default: '' stays ''."""
    return F.coalesce(q["source"], F.lit(ONLY_SOURCE))


def validate_weather(q: Column) -> Column:
    """Numbers, then range, then source, then at least one known parameter."""
    return F.coalesce(
        _numeric_coordinates(q),
        F.when(weather_source(q) != ONLY_SOURCE, _bad_request(*UNSUPPORTED_SOURCE)),
        F.when(F.size(wanted_params(q["params"])) == 0, _bad_request(*NO_VALID_PARAMS)),
    )


def validate_tide(q: Column) -> Column:
    """Numbers, then range. The datum is passed on unchecked."""
    return _numeric_coordinates(q)


def validate_openwaters(q: Column) -> Column:
    """Coordinates present, then a known datum (case matters)."""
    return F.coalesce(
        _coordinates_given(q),
        F.when(~given(q["datum"]).isin(*DATUMS), _bad_request(*INVALID_DATUM)),
    )


def validate_geocode(q: Column) -> Column:
    """Coordinates present; text that is no number counts as 0 later on."""
    return _coordinates_given(q)
