"""Place names for coordinates, by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellframe.functions.grid import grid_cell
from swellframe.functions.numbers import parse_float_lenient
from swellframe.functions.query_text import given

PLACE = ("locality", "city", "countryName", "countryCode")
CELL = ["lat_cell", "lng_cell"]


def geocode_coordinates(q: Column) -> tuple[Column, Column]:
    """(lat, lng) that a geocode request asks for; text that is no number counts as 0."""
    return (
        parse_float_lenient(given(q["latitude"])),
        parse_float_lenient(given(q["longitude"])),
    )


def with_cell(points: DataFrame) -> DataFrame:
    """Points with the cell of their ``lat`` and ``lng``.

    Cells are joined as numbers, so the cells of -0.001 and 0.001 are one cell.
    """
    return points.withColumns(
        {"lat_cell": grid_cell(F.col("lat")), "lng_cell": grid_cell(F.col("lng"))}
    )


def custom_location_join(points: DataFrame, overrides: DataFrame) -> DataFrame:
    """Points with the place of a matching override, nulls without a match.

    ``overrides`` has one ``name`` per cell. A match gives the locality alone.
    """
    named = overrides.select(*CELL, F.col("name").alias("locality"))
    nothing = {name: F.lit(None).cast("string") for name in PLACE[1:]}
    return (
        with_cell(points).join(named, CELL, "left").withColumns(nothing)
    )


def first_seen_cell(answers: DataFrame) -> DataFrame:
    """Per cell, its first successful upstream answer in order of ``ts, id``.

    ``answers`` holds successful answers only and is read twice: the first time of each
    cell comes from a hash aggregate over all of them, and only the answers of that time
    are then put in order of their ids. A hot cell sends one row per task.
    """
    first_ts = answers.groupBy(*CELL).agg(F.min("ts").alias("first_ts"))
    tied = answers.join(first_ts, CELL).filter(F.col("ts") == F.col("first_ts"))
    first = F.min_by(F.struct("id", F.struct(*PLACE).alias("place")), "id")
    return tied.groupBy(*CELL, "first_ts").agg(first.alias("first")).select(
        *CELL,
        "first_ts",
        F.col("first.id").alias("first_id"),
        *[F.col(f"first.place.{name}").alias(name) for name in PLACE],
    )


def merge_first_answers(stored: DataFrame, more: DataFrame) -> DataFrame:
    """First answers of two tables as one: per cell the earliest by ``first_ts, first_id``, so
    that a late but earlier answer takes the stored one's place."""
    answer = F.struct("first_ts", "first_id", F.struct(*PLACE).alias("place"))
    merged = stored.unionByName(more).groupBy(*CELL).agg(F.min(answer).alias("first"))
    return merged.select(
        *CELL, "first.first_ts", "first.first_id", *[F.col(f"first.place.{name}").alias(name) for name in PLACE]
    )


def _place(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{name}").alias(name) for name in PLACE])


def geocode_resolve(requests: DataFrame, overrides: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """Place of every geocode request and where it came from.

    ``firsts`` are the cells' first answers where they are stored; else those of ``requests``.

    Order: override of the cell, then the first answer seen for the cell, then the
    request's own answer. ``requests`` has ``answered`` and the own place fields; the
    request that brings a cell's first answer has source ``upstream``, and one without
    any answer has none.
    """
    cells = with_cell(requests)
    named = overrides.select(*CELL, F.col("name").alias("override_name"))
    marked = cells.join(named, CELL, "left")
    # Cells with an override never reach the upstream service.
    if firsts is None:
        firsts = first_seen_cell(marked.filter("answered AND override_name IS NULL"))
    first = firsts.select(
        *CELL, "first_ts", "first_id", _place("").alias("first_place")
    )
    seen_before = F.struct("ts", "id") > F.struct("first_ts", "first_id")
    joined = marked.join(first, CELL, "left")
    override = F.struct(
        F.col("override_name").alias(PLACE[0]),
        *[F.lit(None).cast("string").alias(name) for name in PLACE[1:]],
    )
    source = (
        F.when(F.col("override_name").isNotNull(), "override")
        .when(F.col("first_ts").isNotNull() & seen_before, "cache")
        .when(F.col("answered"), "upstream")
    )
    place = (
        F.when(F.col("source") == "override", override)
        .when(F.col("source") == "cache", F.col("first_place"))
        .when(F.col("source") == "upstream", _place(""))
    )
    return (
        joined.withColumn("source", source)
        .withColumn("place", place)
        .select("id", "ts", *CELL, "source", "place.*")
    )
