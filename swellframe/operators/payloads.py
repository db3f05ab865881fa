"""Nested upstream JSON bodies to dense points.

A body is decoded, checked and reshaped on its own row with native expressions, so
none of this shuffles; rows are only multiplied at the end by ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from swellframe.functions.numbers import json_number
from swellframe.functions.plain import with_plain_column
from swellframe.functions.request_text import tide_label, wanted_params
from swellframe.functions.times import HOUR_SECONDS, ZERO_TIME_EPOCH, to_epoch
from swellframe.operators.upstream import PARSE_ERROR

# Weather fields with the short names of their dense columns.
WEATHER_FIELDS = {
    "swellHeight": "h1",
    "swellDirection": "d1",
    "swellPeriod": "p1",
    "secondarySwellHeight": "h2",
    "secondarySwellDirection": "d2",
    "secondarySwellPeriod": "p2",
    "windDirection": "wd",
    "windSpeed": "ws",
}


@dataclass(frozen=True)
class Payload:
    """One kind of body: the array of records in it, or none for a flat body.

    Text leaves are read as VARIANT, because a STRING leaf of ``from_json`` takes
    any JSON value as text, while here a number in a text field spoils the body.
    """

    record: str
    array: str | None = None
    texts: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()

    @property
    def schema(self) -> str:
        record = f"STRUCT<{self.record}>"
        return f"STRUCT<{self.array}: ARRAY<{record}>>" if self.array else record


# The shapes of the upstream bodies.
PAYLOADS = {
    "weather": Payload(
        "time: VARIANT, " + ", ".join(f"{f}: STRUCT<noaa: DOUBLE>" for f in WEATHER_FIELDS),
        "hours",
        ("time",),
        tuple(f"{f}.noaa" for f in WEATHER_FIELDS),
    ),
    "tide_extremes": Payload(
        "height: DOUBLE, time: VARIANT, type: VARIANT", "data", ("time", "type"), ("height",)
    ),
    "sea_level": Payload("sg: DOUBLE, time: VARIANT", "data", ("time",), ("sg",)),
    "ow_extremes": Payload(
        "time: VARIANT, level: DOUBLE, high: BOOLEAN", "extremes", ("time",), ("level",), ("high",)
    ),
    "ow_timeline": Payload("time: VARIANT, level: DOUBLE", "timeline", ("time",), ("level",)),
    "geocode": Payload(
        "locality: VARIANT, city: VARIANT, countryName: VARIANT, countryCode: VARIANT",
        None,
        ("locality", "city", "countryName", "countryCode"),
    ),
}

STRICT_JSON = (
    "map('columnNameOfCorruptRecord', '_bad', 'allowNonNumericNumbers', 'false', "
    "'allowSingleQuotes', 'false')"
)


MARK = "_mark"


def _mark(body: str) -> str:
    """SQL for a text that a body does not hold by chance: a hash of the whole body."""
    return f"CAST(xxhash64({body}) AS STRING)"


def _parsed(body: str, kind: str) -> str:
    """SQL for a body as ``STRUCT<d: ARRAY<document>, _bad>``, the document second of three.

    The body stands in an array between two records that hold its mark. Text around the
    document is then an error, or gives more or fewer elements, or other marks, whatever
    frame the text closes. A bare null gives a null element.
    """
    payload = PAYLOADS[kind].schema.removesuffix(">") + f", {MARK}: STRING>"
    schema = f"d ARRAY<{payload}>, _bad STRING"
    mark = f"""'{{"{MARK}":"', {_mark(body)}, '"}}'"""
    framed = f"""concat('{{"d":[', {mark}, ',', {body}, ',', {mark}, ']}}')"""
    return f"""from_json({framed}, '{schema}', {STRICT_JSON})"""


def _accepted(document: str, kind: str, body: str) -> str:
    """SQL for whether a parsed body is one whole document of the right types.

    Only the first and the last element hold the mark. A record is spoiled by a text leaf
    that is not text, or a number past the range.
    """
    payload = PAYLOADS[kind]
    checks = [
        f"coalesce(schema_of_variant(record.{path}) NOT IN ('STRING', 'VOID'), false)"
        for path in payload.texts
    ] + [f"coalesce(abs(record.{path}) = double('inf'), false)" for path in payload.numbers]
    inner, spoiled = f"get({document}.d, 1)", " OR ".join(checks)
    records = f"{inner}.{payload.array}" if payload.array else f"array({inner})"
    return f"""coalesce({document}._bad IS NULL AND size({document}.d) = 3
      AND get({document}.d, 0).{MARK} = {_mark(body)} AND get({document}.d, 2).{MARK} = {_mark(body)}
      AND NOT coalesce(exists({records}, record -> {spoiled}), false), false)"""


def decodable(body: str, kind: str, kinds: Sequence[str] = tuple(PAYLOADS)) -> Column:
    """Whether the column ``body`` decodes as the payload named in the column ``kind``.

    Each branch puts the parsed value into a one-element array, so that the body is
    parsed only once.
    """
    branches = " ".join(
        f"WHEN '{name}' THEN get(transform(array({_parsed(body, name)}), "
        f"document -> {_accepted('document', name, body)}), 0)"
        for name in kinds
    )
    return F.expr(f"coalesce(CASE {kind} {branches} END, false)")


def decode(payloads: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``payloads`` with the parsed ``doc`` and the flag ``decoded``."""
    return (
        with_plain_column(payloads, "_parsed", F.expr(_parsed(body, kind)))
        .withColumn("decoded", F.expr(_accepted("_parsed", kind, body)))
        .withColumn("doc", F.get(F.col("_parsed.d"), F.lit(1)))
        .drop("_parsed")
    )


def _records(kind: str) -> Column:
    """Records of the decoded ``doc`` with plain leaves, an empty array if there are none.

    Text leaves become strings and missing numbers 0.0. That is a step of its own
    because an expression in a lambda is evaluated anew for each use.
    """
    payload = PAYLOADS[kind]
    records = F.coalesce(
        F.col(f"doc.{payload.array}"), F.array().cast(f"ARRAY<STRUCT<{payload.record}>>")
    )

    def plain(record: Column) -> Column:
        leaves = [record[name].cast("string").alias(name) for name in payload.texts]
        for path in payload.numbers:
            name, *inner = path.split(".")
            leaf = record[name][inner[0]] if inner else record[name]
            leaves.append(F.coalesce(leaf, F.lit(0.0)).alias(name))
        return F.struct(*leaves, *[record[name].alias(name) for name in payload.flags])

    return F.transform(records, plain)


def _weather_points(params: Column) -> Column:
    def point(hour: Column) -> Column:
        values = [
            F.when(F.array_contains(params, field), hour[field]).alias(short)
            for field, short in WEATHER_FIELDS.items()
        ]
        return F.struct(to_epoch(hour["time"]).alias("ts"), *values)

    return F.transform(_records("weather"), point)


def _tide_points(kind: str, height: str, label) -> Column:
    def point(record: Column) -> Column:
        return F.struct(
            to_epoch(record["time"]).alias("ts"),
            record[height].alias("h"),
            label(record).alias("t"),
        )

    return F.transform(_records(kind), point)


NO_LABEL = lambda record: F.lit(None).cast("string")


def _timeline_candidates() -> Column:
    """Points on the hour of their own offset; unreadable times count as such."""

    def timed(record: Column) -> Column:
        return F.struct(
            to_epoch(record["time"]).alias("ts"),
            record["level"].alias("h"),
            F.substring(record["time"], 15, 5).alias("past_hour"),
        )

    return F.filter(
        F.transform(_records("ow_timeline"), timed),
        lambda point: (point["ts"] == ZERO_TIME_EPOCH) | (point["past_hour"] == "00:00"),
    )


def points(payloads: DataFrame, kind: str, params: str = "params") -> DataFrame:
    """Decodable payloads with their dense points in the array ``points``.

    ``params`` names the comma-separated fields asked for, used by weather only.
    """
    good = decode(payloads, kind).filter("decoded")
    if kind == "weather":
        wanted = good.withColumn("_wanted", wanted_params(F.col(params)))
        dense = wanted.withColumn("points", _weather_points(F.col("_wanted"))).drop("_wanted")
    elif kind == "tide_extremes":
        kept = lambda record: F.nullif(record["type"], F.lit(""))
        dense = good.withColumn("points", _tide_points(kind, "height", kept))
    elif kind == "sea_level":
        dense = good.withColumn("points", _tide_points(kind, "sg", NO_LABEL))
    elif kind == "ow_extremes":
        flagged = lambda record: tide_label(record["high"])
        dense = good.withColumn("points", _tide_points(kind, "level", flagged))
    elif kind == "ow_timeline":
        # A point is dropped when it falls in the hour of the last one kept. A dropped
        # point always shares that hour, so looking one candidate back is enough.
        hour = lambda point: F.floor(point["ts"] / HOUR_SECONDS)
        zero_hour = F.lit(ZERO_TIME_EPOCH // HOUR_SECONDS)
        candidates = good.withColumn("_on_hour", _timeline_candidates())
        dense = candidates.withColumn(
            "points",
            F.transform(
                F.filter(
                    F.col("_on_hour"),
                    lambda point, i: hour(point)
                    != F.coalesce(hour(F.get(F.col("_on_hour"), i - 1)), zero_hour),
                ),
                lambda point: F.struct(
                    point["ts"], point["h"], F.lit(None).cast("string").alias("t")
                ),
            ),
        ).drop("_on_hour")
    else:
        raise ValueError(f"no dense points for payload kind {kind!r}")
    return dense.drop("doc", "decoded")


def dense_rows(payloads: DataFrame, kind: str, keys: list[str], params: str = "params") -> DataFrame:
    """One row per dense point: the key columns, ``pos`` and the point's fields."""
    # An inner explode would add a filter on the array's size, and build the array twice.
    exploded = points(payloads, kind, params).select(
        *keys, F.posexplode_outer("points").alias("pos", "point")
    )
    return exploded.filter("pos IS NOT NULL").select(*keys, "pos", "point.*")


def pack_dense(payloads: DataFrame, kind: str, keys: list[str], params: str = "params") -> DataFrame:
    """One ``{"data": [...]}`` document per decodable payload, point order kept.

    Missing values are left out of a point, and no points give an empty array.
    """
    numeric = list(WEATHER_FIELDS.values()) if kind == "weather" else ["h"]
    others = ["ts"] if kind == "weather" else ["ts", "t"]
    order = ["ts", *numeric, *others[1:]]
    texts = F.transform(
        "points",
        lambda point: F.struct(
            *[
                (json_number(point[name]) if name in numeric else point[name]).alias(name)
                for name in order
            ]
        ),
    )
    packed = F.to_json(F.struct(texts.alias("data")))
    # Number texts lose their quotes; quotes inside a text field are escaped and stay.
    quoted = rf'"({"|".join(numeric)})":"([^"]*)"'
    document = F.regexp_replace(packed, F.lit(quoted), F.lit('"$1":$2'))
    return points(payloads, kind, params).select(*keys, document.alias("document"))


def geocode_rows(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """The four place fields of a decodable geocode body, null where empty."""
    return (
        decode(payloads, "geocode")
        .filter("decoded")
        .select(
            *keys,
            *[
                F.nullif(F.col(f"doc.{name}").cast("string"), F.lit("")).alias(name)
                for name in PAYLOADS["geocode"].texts
            ],
        )
    )


def corrupt_payloads(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads of any ``kind`` that do not decode, as failed requests, in one pass.

    Only the geocode route keeps the body that could not be read.
    """
    kept = F.when(F.col("kind") == "geocode", F.col("body")).otherwise("")
    return payloads.filter(~decodable("body", "kind")).select(
        *keys,
        "kind",
        F.lit(500).alias("status_code"),
        F.lit(PARSE_ERROR).alias("error_type"),
        kept.alias("upstream_response"),
    )


def corrupt_rows(payloads: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Payloads that do not decode, as failed requests.

    Only the geocode route keeps the body that could not be read.
    """
    kept = F.col("body") if kind == "geocode" else F.lit("")
    return (
        decode(payloads, kind)
        .filter("NOT decoded")
        .select(
            *keys,
            F.lit(500).alias("status_code"),
            F.lit(PARSE_ERROR).alias("error_type"),
            kept.alias("upstream_response"),
        )
    )
