"""The given ``events`` table read as an access log of the marine API.

``ACCESS_LOG_SQL`` is in the part of SQL that Spark and DuckDB share, so that the checked
queries and the SQL that checks them start from the same rows. The number ``k`` in an
event's props decides which oddity its request has. ``regular`` requests ask for one place
over and over, so that their cache keys repeat; ``kt`` is ``k`` for what goes into a key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Report time, and the configuration of the checks made on requests.
AS_OF = datetime(2024, 1, 31)
ALLOWED_APPS = ("app1", "app2")

_DECIMAL = (
    "CASE WHEN {m} < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs({m}) / 1000) AS BIGINT) AS STRING)"
    " || '.' || lpad(CAST(abs({m}) % 1000 AS STRING), 3, '0')"
)

ACCESS_LOG_SQL = f"""
base AS (
  SELECT event_id AS id, ts, user_id AS u, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CAST(((EXTRACT(YEAR FROM ts) - 1970) * 365 + floor((EXTRACT(YEAR FROM ts) - 1969) / 4)
      + EXTRACT(DOY FROM ts) - 1) * 86400 + EXTRACT(HOUR FROM ts) * 3600
      + EXTRACT(MINUTE FROM ts) * 60 + floor(EXTRACT(SECOND FROM ts)) AS BIGINT) AS epoch_s,
    substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) AS clock
  FROM events),
kinds AS (
  SELECT *, u % 5 <> 1 AND k >= 22 AS regular,
    CASE WHEN u % 5 <> 1 AND k >= 22 THEN 0 ELSE k END AS kt
  FROM base),
placed AS (
  SELECT *,
    CASE WHEN k = 77 THEN '/dashboard/api/stats'
      WHEN event_type = 'view' THEN '/v2/weather/point'
      WHEN event_type = 'click' THEN '/v2/tide/extremes/point'
      WHEN event_type = 'purchase' THEN '/v2/tide/sea-level/point'
      WHEN event_type = 'signup' AND k % 2 = 0 THEN '/tides/timeline'
      WHEN event_type = 'signup' THEN '/tides/extremes'
      ELSE '/data/reverse-geocode-client' END AS path,
    CASE WHEN regular THEN 1200 ELSE (u % 25) * 370 - 4500 + k % 10 END AS lat_m,
    CASE WHEN regular THEN 8000 ELSE ((u % 6) * 31 - 75) * 1000 + k % 7 END AS lng_m
  FROM kinds),
parts AS (
  SELECT *,
    CASE WHEN path LIKE '/v2/%' THEN 'stormglass'
      WHEN path LIKE '/tides/%' THEN 'openwaters'
      WHEN path LIKE '/data/%' THEN 'geocode' ELSE 'none' END AS family,
    CASE WHEN k = 3 THEN NULL WHEN k = 0 THEN '0' WHEN k = 2 THEN '200' WHEN k = 4 THEN 'abc'
      WHEN k = 5 THEN '1.5d' WHEN k = 12 THEN '1.5' || chr(10) WHEN k = 15 AND path LIKE '/tides/%' THEN 'nan' WHEN k = 13 THEN '' WHEN k = 14 THEN ' 1.5'
      ELSE {_DECIMAL.format(m='lat_m')} END AS lat_text,
    CASE WHEN k = 3 THEN NULL WHEN k IN (0, 1) THEN '0'
      ELSE {_DECIMAL.format(m='lng_m')} END AS lng_text,
    CASE WHEN path <> '/v2/weather/point' THEN NULL
      WHEN kt % 5 = 0 THEN 'swellHeight,swellPeriod'
      WHEN kt % 5 = 1 THEN 'swellHeight,windSpeed,bogus'
      WHEN kt % 5 = 2 THEN 'windDirection, secondarySwellHeight,secondarySwellPeriod'
      WHEN kt % 5 = 3 AND kt % 2 = 1 THEN 'bogus,'
      WHEN kt % 5 = 3 THEN 'windSpeed,swellHeight,windSpeed'
      ELSE 'swellHeight,swellDirection,swellPeriod,secondarySwellHeight,secondarySwellDirection,'
        || 'secondarySwellPeriod,windDirection,windSpeed' END AS params,
    CASE WHEN path <> '/v2/weather/point' THEN NULL WHEN k = 7 THEN 'icon' WHEN k = 17 THEN ''
      WHEN k % 3 = 0 THEN 'noaa' ELSE NULL END AS source,
    CASE WHEN kt % 4 = 0 THEN NULL WHEN kt % 4 = 1 THEN CAST(epoch_s AS STRING)
      WHEN kt % 4 = 2 THEN clock || '.5Z' ELSE 'garbage' END AS start_text,
    CASE WHEN kt % 6 = 0 THEN NULL WHEN kt % 6 = 1 THEN CAST(epoch_s + 18000 AS STRING)
      WHEN kt % 6 = 2 THEN CAST(epoch_s + 864000 AS STRING) WHEN kt % 6 = 3 THEN clock || '-02:30'
      WHEN kt % 6 = 4 THEN 'soon' ELSE CAST(epoch_s - 7200 AS STRING) END AS end_text,
    CASE WHEN path = '/v2/weather/point' OR path LIKE '/data/%' THEN NULL
      WHEN k = 11 THEN 'bad' WHEN kt % 3 = 1 THEN 'MLLW' WHEN kt % 3 = 2 THEN '' ELSE NULL END AS datum,
    CASE WHEN k = 19 THEN NULL WHEN k % 10 = 9 THEN 'intruder' WHEN u % 3 = 0 THEN 'app1'
      WHEN u % 3 = 1 THEN NULL ELSE 'app2' END AS app_id_header,
    CASE WHEN k = 19 THEN NULL WHEN u % 3 = 1 THEN 'app2' WHEN u % 3 = 2 THEN 'zzz'
      ELSE NULL END AS app_id_query,
    CASE WHEN k = 21 THEN '' WHEN u % 2 = 0 THEN 'hk' ELSE NULL END AS authorization_header,
    CASE WHEN k <> 21 AND u % 2 = 1 THEN 'qk' ELSE NULL END AS key_query,
    CASE WHEN k % 10 = 6 THEN 429 WHEN k % 10 = 8 THEN 503 WHEN k = 51 THEN 403 WHEN k = 52 THEN 401
      WHEN k = 53 THEN NULL WHEN k = 54 THEN 302 ELSE 200 END AS upstream_status
  FROM placed),
access_log AS (
  SELECT *, CASE WHEN k = 78 THEN 'POST' ELSE 'GET' END AS method,
    COALESCE(CASE WHEN family = 'stormglass' THEN 'lat=' ELSE 'latitude=' END
        || replace(replace(lat_text, ' ', '%20'), chr(10), '%0A') || '&', '')
      || COALESCE(CASE WHEN family = 'stormglass' THEN 'lng=' ELSE 'longitude=' END || lng_text, '')
      || CASE WHEN k = 31 THEN '&lat=99.5' ELSE '' END
      || COALESCE('&params=' || replace(replace(params, ', ', ',+'), 'Speed,', 'Speed%2C'), '')
      || COALESCE('&source=' || source, '')
      || COALESCE('&start=' || start_text, '') || COALESCE('&end=' || end_text, '')
      || COALESCE('&datum=' || datum, '') || COALESCE('&app_id=' || app_id_query, '')
      || COALESCE('&key=' || key_query, '') AS query,
    CASE WHEN k % 8 = 0 THEN 'ping' ELSE '' END AS request_body,
    CASE WHEN upstream_status IS NULL THEN NULL
      WHEN upstream_status <> 200 THEN '{{"errors":"limit"}}'
      WHEN k = 61 THEN '{{"data":['
      WHEN k = 62 THEN '{{"hours":[{{"time":7}}],"data":[{{"time":7}}],"extremes":[{{"time":7}}],'
        || '"timeline":[{{"time":7}}],"city":7}}'
      WHEN k = 63 THEN ''
      WHEN k = 65 THEN '{{}}],"x":[1'
      WHEN k = 64 THEN 'null'
      WHEN family = 'geocode' THEN '{{"locality":"Bay ' || CAST(u % 7 AS STRING) || '","city":"City '
        || CAST(id % 3 AS STRING) || '","countryName":"","countryCode":"ID"}}'
      WHEN path = '/v2/weather/point' THEN '{{"hours":[{{"time":"' || clock || 'Z","windSpeed":{{"noaa":1.5}}}}]}}'
      WHEN family = 'openwaters' THEN '{{"extremes":[],"timeline":null}}'
      ELSE '{{}}' END AS upstream_body
  FROM parts)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt anew: a file of few row groups would keep a few tasks busy with all."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").hint("rebalance")


def mapped(source: DataFrame) -> DataFrame:
    """Events, batch or stream, as access log rows with the parts they are made of."""
    text = ACCESS_LOG_SQL.replace("{", "{{").replace("}", "}}")
    text = text.replace("FROM events)", "FROM {events})")
    return source.sparkSession.sql(f"WITH {text} SELECT * FROM access_log", events=source)


LOG_COLUMNS = (
    "id", "ts", "method", "path", "query", "app_id_header", "authorization_header",
    "request_body", "upstream_status", "upstream_body",
)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log made from the events of ``sf_dir``."""
    return mapped(events(spark, sf_dir)).select(*LOG_COLUMNS)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override names made from the nations, as CSV-like text rows."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        (F.col("n_nationkey") * F.lit(0.37) - F.lit(4.5)).cast("string").alias("lat"),
        (F.col("n_nationkey") % 6 * 31 - 75).cast("string").alias("lon"),
        F.col("n_name").alias("name"),
        F.col("n_nationkey").cast("bigint").alias("line"),
    )


# ---- upstream bodies ---------------------------------------------------------

def _clock(seconds: Column) -> Column:
    """'yyyy-MM-ddTHH:mm:ss' of Unix seconds, in UTC whatever the session zone."""
    stamp = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)")
    )
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return text


def _time_text(k: Column, seconds: Column) -> Column:
    return (
        F.when(k == 23, F.lit("n/a"))
        .when(k % 7 == 3, F.concat(_clock(seconds + 19800), F.lit("+05:30")))
        .when(k % 11 == 5, F.concat(_clock(seconds), F.lit(".250Z")))
        .otherwise(F.concat(_clock(seconds), F.lit("Z")))
    )


def _spoil(body: Column, k: Column, wrong: str) -> Column:
    """Cut bodies short, or replace them by one with a wrong type, for some ``k``."""
    return (
        F.when(k % 25 == 24, F.substring(body, F.lit(1), F.length(body) - 2))
        .when(k % 25 == 22, F.lit(wrong))
        .when(k == 40, F.lit("{}"))
        .otherwise(body)
    )


def _leaf(value: Column) -> Column:
    return F.struct(value.cast("double").alias("noaa"))


def _up_to(count: Column) -> Column:
    """0 .. count-1, empty for a count of 0."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def _few(k: Column) -> Column:
    return k % 4


def _day_or_week(k: Column) -> Column:
    """Hours of an answer: a week for some, a day for others, a few for the rest."""
    return F.when(k == 33, 168).when(k % 10 == 7, 24).otherwise(_few(k))


def _body(kind: str, steps_of: Callable[[Column], Column] = _few) -> Column:
    """The body of one kind of payload, made from the parts of an event."""
    k, value, epoch = F.col("k"), F.col("value"), F.col("epoch_s")
    steps = _up_to(steps_of(k))
    if kind == "weather":
        hour = lambda i: F.struct(
            _time_text(k, epoch + i * 3600).alias("time"),
            _leaf(value + i).alias("swellHeight"),
            _leaf(value * 2).alias("swellDirection"),
            F.when((k + i) % 5 != 0, _leaf(value / 4)).alias("swellPeriod"),
            _leaf(value - i).alias("secondarySwellHeight"),
            F.struct(F.when((k + i) % 3 != 0, i.cast("double")).alias("noaa")).alias(
                "secondarySwellDirection"
            ),
            _leaf(i + 0.5).alias("secondarySwellPeriod"),
            _leaf(i).alias("windDirection"),
            _leaf(value).alias("windSpeed"),
        )
        body, wrong = F.struct(F.transform(steps, hour).alias("hours")), '{"hours":[{"time":5}]}'
    elif kind == "tide_extremes":
        extreme = lambda i: F.struct(
            (value - i).alias("height"),
            _time_text(k, epoch + i * 3600).alias("time"),
            F.when(i == 0, "high").when(i == 1, "low").when(i == 2, "").alias("type"),
        )
        body = F.struct(F.transform(steps, extreme).alias("data"))
        wrong = '{"data":[{"height":"1.5"}]}'
    elif kind == "sea_level":
        level = lambda i: F.struct(
            F.when((k + i) % 4 != 0, value + i).alias("sg"),
            _time_text(k, epoch + i * 3600).alias("time"),
        )
        body, wrong = F.struct(F.transform(steps, level).alias("data")), '{"data":{}}'
    elif kind == "ow_extremes":
        extreme = lambda i: F.struct(
            _time_text(k, epoch + i * 3600).alias("time"),
            (value + i).alias("level"),
            F.when(i > 0, i % 2 == 1).alias("high"),
        )
        body = F.struct(F.transform(steps, extreme).alias("extremes"))
        wrong = '{"extremes":[{"high":"yes"}]}'
    elif kind == "ow_timeline":
        half_hour = epoch - epoch % 3600
        shift = F.when(k % 9 == 4, 19800).otherwise(0)
        zone = F.when(k % 9 == 4, "+05:30").otherwise("Z")

        def point(j: Column) -> Column:
            i = F.floor(j / 2)
            clock = _clock(half_hour + i * 1800 + shift)
            time = F.when((k % 13 == 6) & (i % 2 == 0), "n/a").otherwise(F.concat(clock, zone))
            return F.struct(time.alias("time"), (value + j).alias("level"))

        # Every time occurs twice, so that the second one has to be dropped.
        body = F.struct(F.transform(_up_to(k % 4 * 4), point).alias("timeline"))
        wrong = '{"timeline":[{"level":true}]}'
    else:
        body = F.struct(
            F.concat(F.lit("Bay "), F.col("u") % 7).alias("locality"),
            F.when(k % 2 == 0, F.concat(F.lit("City "), k % 3)).otherwise("").alias("city"),
            F.when(k % 3 == 0, "Indonesia").alias("countryName"),
            F.lit("ID").alias("countryCode"),
        )
        wrong = '{"city":7}'
    return _spoil(F.to_json(body), k, wrong)


def payloads(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """A body of each of ``kinds`` per event: ``id, k, params, kind, body``."""
    return _payloads(spark, sf_dir, {kind: _body(kind) for kind in kinds})


def long_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather bodies as of :func:`payloads`, of up to a week of hours."""
    return _payloads(spark, sf_dir, {"weather": _body("weather", _day_or_week)})


def _payloads(spark: SparkSession, sf_dir: str, made: dict[str, Column]) -> DataFrame:
    k = F.col("k")
    rows = mapped(events(spark, sf_dir)).select("id", "k", "u", "value", "epoch_s")
    bodies = [F.struct(F.lit(kind).alias("kind"), body.alias("body")) for kind, body in made.items()]
    each = bodies[0].alias("each") if len(bodies) == 1 else F.explode(F.array(*bodies)).alias("each")
    return rows.select("id", "k", each).select(
        "id",
        "k",
        F.when(k % 2 == 0, "swellHeight, windSpeed,swellPeriod")
        .otherwise("secondarySwellDirection,secondarySwellHeight,secondarySwellPeriod,"
                   "swellDirection,windDirection,none")
        .alias("params"),
        "each.*",
    )
