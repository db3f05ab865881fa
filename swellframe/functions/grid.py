"""Coordinates and the 0.01 degree grid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellframe.functions.numbers import round_half_away

# Grid resolution in decimals, and the limit of both coordinates.
CELL_DECIMALS = 2
COORDINATE_LIMIT = 180.0


def grid_cell(coordinate: Column) -> Column:
    """Snap one coordinate to the grid (about 1.1 km); -0.0 becomes 0.0."""
    return round_half_away(coordinate, CELL_DECIMALS)


def valid_coordinate(value: Column) -> Column:
    """Both latitude and longitude run from -180 to 180; NaN is outside."""
    return F.abs(value) <= COORDINATE_LIMIT


def countable_location(status_code: Column, lat: Column, lng: Column) -> Column:
    """Whether a request adds to the lifetime counter of its cell."""
    return (
        (status_code < 400)
        & (lat != 0)
        & (lng != 0)
        & valid_coordinate(lat)
        & valid_coordinate(lng)
    )
