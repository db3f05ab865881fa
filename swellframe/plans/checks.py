"""DuckDB SQL that gives the result of each query by another way.

The SQL starts from the same access log rows (``ACCESS_LOG_SQL``), but knows each
request's parts and oddities instead of parsing its query text and bodies.
"""

from __future__ import annotations

from swellframe.plans.mapping import ACCESS_LOG_SQL

FLOAT = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
ZERO_TIME = -62135596800


def _cell(x: str) -> str:
    return f"(round(({x}) * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) + CAST(0 AS DOUBLE))"


# Time text to Unix seconds; the given texts are 'clock' + '.5Z', 'clock' + '-02:30', or
# no time at all.
def _epoch(text: str) -> str:
    return f"""CASE WHEN {text} LIKE '%.5Z' THEN epoch_s
      WHEN {text} LIKE '%-02:30' THEN epoch_s + 9000 ELSE {ZERO_TIME} END"""


FACTS_SQL = f"""{ACCESS_LOG_SQL},
named AS (
  SELECT *,
    CASE family WHEN 'stormglass' THEN 'Stormglass' WHEN 'openwaters' THEN 'OpenWaters'
      ELSE 'BigDataCloud' END AS route_backend,
    CASE path WHEN '/v2/weather/point' THEN 'weather' WHEN '/v2/tide/extremes/point' THEN 'tide_extremes'
      WHEN '/v2/tide/sea-level/point' THEN 'sea_level' WHEN '/tides/extremes' THEN 'ow_extremes'
      WHEN '/tides/timeline' THEN 'ow_timeline' ELSE 'geocode' END AS kind,
    COALESCE(NULLIF(app_id_header, ''), app_id_query, '') AS app_id,
    COALESCE(authorization_header, '') <> '' OR COALESCE(key_query, '') <> '' AS has_key,
    CASE WHEN regexp_full_match(lat_text, {FLOAT}) OR lat_text = 'nan'
      THEN TRY_CAST(lat_text AS DOUBLE) END AS lat_num,
    CASE WHEN regexp_full_match(lng_text, {FLOAT}) THEN TRY_CAST(lng_text AS DOUBLE) END AS lng_num,
    k NOT IN (61, 62, 63, 65) AND upstream_status = 200 AS decodable
  FROM access_log WHERE family <> 'none' AND method = 'GET'),
checked AS (
  SELECT *,
    CASE WHEN family = 'stormglass' THEN
      CASE WHEN lat_num IS NULL OR lng_num IS NULL THEN 'numbers'
        WHEN abs(lat_num) > 180 OR abs(lng_num) > 180 THEN 'range'
        WHEN kind = 'weather' AND COALESCE(source, 'noaa') <> 'noaa' THEN 'source'
        WHEN kind = 'weather' AND params = 'bogus,' THEN 'params' END
    ELSE
      CASE WHEN COALESCE(lat_text, '') = '' OR COALESCE(lng_text, '') = '' THEN 'required'
        WHEN family = 'openwaters' AND COALESCE(datum, '') NOT IN ('', 'LAT', 'MSL', 'MLLW') THEN 'datum'
      END END AS flaw,
    app_id IN ('app1', 'app2') AS authorized
  FROM named),
reasons AS (
  SELECT *,
    CASE flaw WHEN 'source' THEN 'Unsupported Source' WHEN 'params' THEN 'No Valid Params'
      WHEN 'datum' THEN 'Invalid Datum' WHEN 'numbers' THEN 'Invalid Coordinates'
      WHEN 'range' THEN 'Invalid Coordinates' WHEN 'required' THEN 'Invalid Coordinates' END AS flaw_type,
    CASE flaw WHEN 'source' THEN 'Only ''noaa'' source is supported so far'
      WHEN 'params' THEN 'No valid parameters requested'
      WHEN 'datum' THEN 'Invalid datum. Allowed values: LAT, MSL, MLLW'
      WHEN 'numbers' THEN 'lat and lng must be valid numbers'
      WHEN 'range' THEN 'coordinates must be between -180 and 180'
      WHEN 'required' THEN 'latitude and longitude are required' END AS flaw_message,
    CASE WHEN upstream_status IS NULL THEN 500 WHEN upstream_status <> 200 THEN upstream_status
      WHEN NOT decodable THEN 500 END AS failed_status,
    CASE WHEN upstream_status IS NULL THEN route_backend || ' Connection Error'
      WHEN upstream_status = 200 AND NOT decodable THEN 'Parse Error'
      WHEN upstream_status = 200 THEN NULL
      WHEN family = 'stormglass' AND upstream_status IN (401, 403) THEN 'Stormglass Auth Error'
      WHEN family = 'stormglass' AND upstream_status = 429 THEN 'Stormglass Rate Limit'
      ELSE route_backend || ' HTTP ' || upstream_status END AS failed_type,
    CASE WHEN upstream_status IS NULL THEN 'Failed to fetch from ' || route_backend
      WHEN upstream_status = 200 AND NOT decodable
      THEN 'Failed to parse ' || route_backend || ' response' END AS failed_message
  FROM checked),
outcomes AS (
  SELECT *,
    CASE WHEN NOT authorized THEN 401 WHEN family = 'stormglass' AND NOT has_key THEN 403
      WHEN flaw IS NOT NULL THEN 400 ELSE COALESCE(failed_status, 200) END AS status_code,
    CASE WHEN NOT authorized THEN 'Unauthorized App ID'
      WHEN family = 'stormglass' AND NOT has_key THEN 'Missing API Key'
      WHEN flaw IS NOT NULL THEN flaw_type
      WHEN failed_status >= 400 THEN failed_type ELSE '' END AS error_type,
    CASE WHEN NOT authorized THEN 'Unauthorized: invalid or missing App ID'
      WHEN family = 'stormglass' AND NOT has_key THEN 'No API key provided'
      WHEN flaw IS NOT NULL THEN flaw_message ELSE failed_message END AS message,
    CASE WHEN NOT authorized OR (family = 'stormglass' AND NOT has_key) THEN 'Unknown'
      ELSE route_backend END AS backend,
    -- 'lat' goes before 'latitude', and the first 'lat' counts.
    CASE WHEN k = 31 AND family <> 'stormglass' THEN CAST(99.5 AS DOUBLE)
      WHEN COALESCE(lat_text, '') <> '' AND COALESCE(lng_text, '') <> ''
      THEN COALESCE(lat_num, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS raw_lat,
    CASE WHEN COALESCE(lat_text, '') <> '' AND COALESCE(lng_text, '') <> ''
      THEN COALESCE(lng_num, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS raw_lng
  FROM reasons),
requests AS (
  SELECT id, ts, backend, status_code, error_type,
    CASE WHEN NOT isnan(raw_lat) AND (raw_lat <> 0 OR raw_lng <> 0) THEN {_cell('raw_lat')} END AS lat,
    CASE WHEN raw_lat <> 0 OR raw_lng <> 0 THEN {_cell('raw_lng')} END AS lng
  FROM outcomes),
errors AS (
  SELECT id, ts, method, path, query, status_code, request_body,
    CASE WHEN message IS NULL THEN upstream_body ELSE '{{"error":"' || message || '"}}' END AS response_body,
    CASE WHEN message IS NULL THEN upstream_body
      WHEN error_type = 'Parse Error' AND kind = 'geocode' THEN upstream_body ELSE '' END AS upstream_response,
    backend, error_type
  FROM outcomes WHERE status_code >= 400),
countable AS (
  SELECT id, ts, {_cell('raw_lat')} AS lat, {_cell('raw_lng')} AS lng
  FROM outcomes
  WHERE status_code < 400 AND raw_lat <> 0 AND raw_lng <> 0
    AND raw_lat BETWEEN -180 AND 180 AND raw_lng BETWEEN -180 AND 180)
"""

WEEK = "ts >= TIMESTAMP '2024-01-24 00:00:00'"


def _on_parts(query: str) -> str:
    return f"WITH {ACCESS_LOG_SQL} {query}"


def _on_facts(query: str) -> str:
    return f"WITH {FACTS_SQL} {query}"


def _verdict(kinds: str) -> str:
    return _on_facts(
        "SELECT id, CASE WHEN flaw IS NOT NULL THEN 400 END AS status_code, "
        f"flaw_type AS error_type, flaw_message AS message FROM reasons WHERE kind IN ({kinds})"
    )


# ---- time windows ------------------------------------------------------------

# Start and end in microseconds, so that fractions reach into the next hour.
WINDOW_STEPS = f"""
begun AS (
  SELECT *,
    CASE WHEN start_text IS NULL THEN epoch_us(ts)
      WHEN kt % 4 = 1 THEN epoch_s * 1000000
      WHEN kt % 4 = 2 THEN epoch_s * 1000000 + 500000
      ELSE {ZERO_TIME} * 1000000 END AS start_us
  FROM access_log),
ended AS (
  SELECT *,
    CASE WHEN end_text IS NULL THEN start_us + 86400000000
      WHEN kt % 6 = 1 THEN (epoch_s + 18000) * 1000000 WHEN kt % 6 = 2 THEN (epoch_s + 864000) * 1000000
      WHEN kt % 6 = 3 THEN (epoch_s + 9000) * 1000000 WHEN kt % 6 = 4 THEN {ZERO_TIME} * 1000000
      ELSE (epoch_s - 7200) * 1000000 END AS end_us
  FROM begun),
aligned AS (
  SELECT *,
    CAST(floor(start_us / 3600000000) AS BIGINT) * 3600 AS start_s,
    CAST(ceil(end_us / 3600000000) AS BIGINT) * 3600 AS end_hour_s
  FROM ended)
"""
WINDOW_SQL = f"{ACCESS_LOG_SQL}, {WINDOW_STEPS}"

PARAMS_SQL = """CASE WHEN kt % 5 = 0 THEN 'swellHeight,swellPeriod'
  WHEN kt % 5 = 1 THEN 'swellHeight,windSpeed'
  WHEN kt % 5 = 2 THEN 'windDirection,secondarySwellHeight,secondarySwellPeriod'
  WHEN params = 'bogus,' THEN '' ELSE params END"""

# Keys of the valid requests whose responses are cached.
KEYS_SQL = f"""SELECT a.id, CASE o.kind WHEN 'weather' THEN 'weather' WHEN 'sea_level' THEN 'sealevel' ELSE 'tides' END
        || ':' || printf('%.2f', o.lat_num) || ':' || printf('%.2f', o.lng_num) || ':'
        || CASE WHEN o.kind = 'weather' THEN wanted || ':noaa:' ELSE '' END
        || a.start_s || ':' || least(a.end_hour_s, a.start_s + 604800)
        || CASE WHEN o.kind = 'weather' THEN '' ELSE ':' || COALESCE(o.datum, '') END AS cache_key
      FROM aligned a JOIN (SELECT *, {PARAMS_SQL} AS wanted FROM checked) o ON a.id = o.id
      WHERE o.family = 'stormglass' AND o.flaw IS NULL"""

# ---- payloads ----------------------------------------------------------------

# One row per step of a body, without the bodies that do not decode.
STEPS_SQL = f"""{ACCESS_LOG_SQL},
steps AS (
  SELECT *, unnest(range(0, k % 4)) AS i
  FROM access_log WHERE k % 25 NOT IN (22, 24) AND k <> 40),
timed AS (
  SELECT *, CASE WHEN k = 23 THEN {ZERO_TIME} ELSE epoch_s + i * 3600 END AS step_s FROM steps)
"""


def _wanted(even: bool, value: str) -> str:
    return f"CASE WHEN k % 2 = {0 if even else 1} THEN CAST({value} AS DOUBLE) END"


def _steps(columns: str) -> str:
    return f"WITH {STEPS_SQL} SELECT id, CAST(i AS INT) AS pos, step_s AS ts, {columns} FROM timed"


TIMELINE_SQL = f"""WITH {ACCESS_LOG_SQL},
listed AS (
  SELECT *, unnest(range(0, k % 4 * 4)) AS j
  FROM access_log WHERE k % 25 NOT IN (22, 24) AND k <> 40),
stamped AS (
  SELECT id, j, value + j AS h, k % 13 = 6 AND (j // 2) % 2 = 0 AS unreadable,
    epoch_s - epoch_s % 3600 + (j // 2) * 1800 AS point_s,
    CASE WHEN k % 9 = 4 THEN 19800 ELSE 0 END AS shift
  FROM listed),
hours AS (
  SELECT id, j, h, CASE WHEN unreadable THEN {ZERO_TIME} ELSE point_s END AS ts,
    CASE WHEN unreadable THEN {ZERO_TIME} ELSE point_s - point_s % 3600 END AS hour_s
  FROM stamped WHERE unreadable OR (point_s + shift) % 3600 = 0),
marked AS (
  SELECT *, lag(hour_s, 1, {ZERO_TIME}) OVER (PARTITION BY id ORDER BY j) AS before_s FROM hours)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS INT) AS pos,
  ts, h, CAST(NULL AS VARCHAR) AS t
FROM marked WHERE hour_s <> before_s
"""

# Which bodies of each kind do not decode: those cut short, and those of a wrong type.
CORRUPT_SQL = _on_parts(
    """SELECT id, kind, 500 AS status_code, 'Parse Error' AS error_type,
      CASE WHEN kind <> 'geocode' THEN '' WHEN k % 25 = 22 THEN '{"city":7}'
        ELSE substr(body, 1, length(body) - 2) END AS upstream_response
    FROM (
      SELECT *, '{"locality":"Bay ' || u % 7 || '","city":"'
          || CASE WHEN k % 2 = 0 THEN 'City ' || k % 3 ELSE '' END || '",'
          || CASE WHEN k % 3 = 0 THEN '"countryName":"Indonesia",' ELSE '' END
          || '"countryCode":"ID"}' AS body
      FROM access_log),
      (VALUES ('weather'), ('tide_extremes'), ('sea_level'), ('ow_extremes'), ('ow_timeline'),
        ('geocode')) AS kinds(kind)
    WHERE k % 25 IN (22, 24)"""
)

# ---- geocode -----------------------------------------------------------------

GEO_SQL = f"""{FACTS_SQL},
overrides AS (
  SELECT lat_cell, lng_cell, arg_max(n_name, n_nationkey) AS name FROM (
    SELECT {_cell("n_nationkey * CAST(0.37 AS DOUBLE) - CAST(4.5 AS DOUBLE)")} AS lat_cell,
      CAST(n_nationkey % 6 * 31 - 75 AS DOUBLE) AS lng_cell, n_name, n_nationkey FROM nation)
  GROUP BY lat_cell, lng_cell),
points AS (
  SELECT id, ts, u, k, {_cell('COALESCE(lat_num, CAST(0 AS DOUBLE))')} AS lat_cell,
    {_cell('COALESCE(lng_num, CAST(0 AS DOUBLE))')} AS lng_cell, decodable AS answered,
    CASE WHEN decodable AND k <> 64 THEN 'Bay ' || u % 7 END AS locality,
    CASE WHEN decodable AND k <> 64 THEN 'City ' || id % 3 END AS city,
    CAST(NULL AS VARCHAR) AS countryName,
    CASE WHEN decodable AND k <> 64 THEN 'ID' END AS countryCode
  FROM outcomes WHERE kind = 'geocode' AND backend = 'BigDataCloud' AND status_code <> 400)
"""

FIRST_SQL = """SELECT * FROM (
    SELECT lat_cell, lng_cell, ts AS first_ts, id AS first_id, locality, city, countryName, countryCode,
      row_number() OVER (PARTITION BY lat_cell, lng_cell ORDER BY ts, id) AS n
    FROM {points} WHERE answered) WHERE n = 1"""

# ---- response lifetimes ------------------------------------------------------

# One request at a time per key, carrying the time of the last stored response.
CHAIN_SQL = """
arrivals AS (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts, id) AS n FROM reaching),
chain AS (
  SELECT id, ts, cache_key, success, n, FALSE AS hit,
    CASE WHEN success THEN ts END AS written
  FROM arrivals WHERE n = 1
  UNION ALL
  SELECT a.id, a.ts, a.cache_key, a.success, a.n,
    COALESCE(a.ts < c.written + INTERVAL 1 HOUR, FALSE),
    CASE WHEN COALESCE(a.ts < c.written + INTERVAL 1 HOUR, FALSE) THEN c.written
      WHEN a.success THEN a.ts ELSE c.written END
  FROM chain c JOIN arrivals a ON a.cache_key = c.cache_key AND a.n = c.n + 1),
labelled AS (
  SELECT id, ts, cache_key, success, CASE WHEN hit THEN 'HIT' ELSE 'MISS' END AS cache FROM chain)
"""
REACHING_SQL = f"""keys AS ({KEYS_SQL}),
reaching AS (
  SELECT o.id, o.ts, keys.cache_key, o.status_code = 200 AS success
  FROM outcomes o JOIN keys ON o.id = keys.id WHERE o.status_code <> 400 AND o.backend <> 'Unknown'),
{CHAIN_SQL}"""
TTL_SQL = f"RECURSIVE {FACTS_SQL}, {WINDOW_STEPS}, {REACHING_SQL}"

# Where the place of each geocode request comes from.
SOURCED_SQL = f"""named_points AS (
  SELECT p.*, o.name FROM points p
  LEFT JOIN overrides o ON p.lat_cell = o.lat_cell AND p.lng_cell = o.lng_cell),
firsts AS ({FIRST_SQL.format(points="(SELECT * FROM named_points WHERE name IS NULL)")}),
sourced AS (
  SELECT p.id, p.ts, p.lat_cell, p.lng_cell, p.name, f.locality, f.city, f.countryName, f.countryCode,
    CASE WHEN p.name IS NOT NULL THEN 'override'
      WHEN f.first_ts < p.ts OR (f.first_ts = p.ts AND f.first_id < p.id) THEN 'cache'
      WHEN f.first_id = p.id THEN 'upstream' END AS source
  FROM named_points p LEFT JOIN firsts f ON p.lat_cell = f.lat_cell AND p.lng_cell = f.lng_cell)"""
SERVED_SQL = f"""RECURSIVE {GEO_SQL}, {WINDOW_STEPS}, {REACHING_SQL}, {SOURCED_SQL},
served AS (
  SELECT id FROM labelled WHERE cache = 'HIT'
  UNION ALL SELECT id FROM sourced WHERE source IN ('override', 'cache')),
served_requests AS (
  SELECT r.* REPLACE (CASE WHEN s.id IS NOT NULL THEN 200 ELSE r.status_code END AS status_code,
    CASE WHEN s.id IS NOT NULL THEN '' ELSE r.error_type END AS error_type)
  FROM requests r LEFT JOIN served s ON r.id = s.id)"""

NUMBER_TEXT_SQL = f"""{ACCESS_LOG_SQL},
texts AS (
  SELECT id, CASE WHEN k = 90 THEN '1e999' WHEN k % 9 = 6 THEN lat_text || 'e2'
    ELSE COALESCE(lat_text, '') END AS text
  FROM access_log),
numbered AS (
  SELECT id, text, CASE WHEN text <> '1e999' AND regexp_full_match(text, {FLOAT})
    THEN TRY_CAST(text AS DOUBLE) END AS number
  FROM texts)
"""

LIFETIME_SQL = "SELECT lat, lng, count(*) AS count FROM countable GROUP BY lat, lng"
STATS_SQL = """SELECT backend, CAST(sum(CASE WHEN status_code < 400 THEN 1 ELSE 0 END) AS BIGINT) AS success,
  CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM requests"""
REASONS_SQL = """SELECT error_type AS reason, count(*) AS count FROM requests
  WHERE status_code >= 400 AND error_type <> ''{more} GROUP BY error_type ORDER BY 2 DESC, 1 LIMIT 10"""

CHECKS: dict[str, str] = {
    "src_custom_locations": f"""
      SELECT lat_cell, CAST(lng_cell AS DOUBLE) AS lng_cell, arg_max(s_name, s_suppkey) AS name FROM (
        SELECT *, CASE WHEN s_suppkey % 10 = 4 THEN CAST(0 AS DOUBLE)
            ELSE CAST(s_suppkey % 40 * 125 - 900 AS DOUBLE) END AS lat_cell,
          s_suppkey % 3 - 1 AS lng_cell
        FROM supplier WHERE s_suppkey % 10 <> 7)
      GROUP BY lat_cell, lng_cell""",
    "src_access_log": _on_parts(
        "SELECT id, ts, method, path, query, app_id_header, authorization_header, request_body, "
        "upstream_status, upstream_body FROM access_log"
    ),
    "src_payloads": _on_parts(
        "SELECT id, k % 25 NOT IN (22, 24) AS decoded, "
        "CASE WHEN k = 40 OR k % 25 IN (22, 24) THEN NULL ELSE 'Bay ' || u % 7 END AS locality "
        "FROM access_log"
    ),
    "sink_requests": _on_facts("SELECT *, CAST(ts AS DATE) AS dt FROM requests"),
    "sink_error_logs": _on_facts("SELECT *, CAST(ts AS DATE) AS dt FROM errors"),
    "sink_locations": _on_facts(LIFETIME_SQL),
    "round_half_away": """
      SELECT event_id, round((value - 25) / 8) + CAST(0 AS DOUBLE) AS whole,
        round((value - 25) / 8 * 10) / 10 + CAST(0 AS DOUBLE) AS tenths,
        round((value - 25) / 7 * 100) / 100 + CAST(0 AS DOUBLE) AS cents
      FROM events""",
    "parse_float_lenient": f"""WITH {NUMBER_TEXT_SQL}
      SELECT id, text, CASE WHEN text = '1e999' THEN NULL ELSE COALESCE(number, 0) END AS number,
        text = '1e999' AS overflow FROM numbered""",
    "parse_float_strict": f"""WITH {NUMBER_TEXT_SQL}
      SELECT id, text, number, number IS NOT NULL AS valid FROM numbered""",
    "grid_cell": _on_parts(
        f"SELECT id, {_cell('lat_m / CAST(1000 AS DOUBLE)')} AS lat_cell, "
        f"{_cell('lng_m / CAST(1000 AS DOUBLE)')} AS lng_cell FROM access_log"
    ),
    "time_window_parse": f"""WITH {WINDOW_SQL}
      SELECT id, CAST(floor(start_us / 1000000) AS BIGINT) AS start_s,
        CAST(floor(end_us / 1000000) AS BIGINT) AS end_s FROM aligned""",
    "time_window_align": f"""WITH {WINDOW_SQL}
      SELECT id, start_s, least(end_hour_s, start_s + 604800) AS end_s FROM aligned""",
    "extract_coords": f"""WITH {FACTS_SQL}
      SELECT id, CASE WHEN NOT isnan(raw_lat) THEN raw_lat END AS lat, raw_lng AS lng FROM outcomes
      UNION ALL
      SELECT id, CAST(lat_text AS DOUBLE), CAST(lng_text AS DOUBLE) FROM access_log
      WHERE family = 'none' OR method <> 'GET'""",
    "filter_params": _on_facts(
        f"SELECT id, {PARAMS_SQL} AS params FROM named WHERE kind = 'weather'"
    ),
    "cache_key": f"""WITH {FACTS_SQL}, {WINDOW_STEPS}
      {KEYS_SQL}""",
    "to_epoch": _on_parts(
        f"SELECT id, {_epoch('start_text')} AS start_s, {_epoch('end_text')} AS end_s FROM access_log"
    ),
    "epoch_to_rfc3339": _on_parts(
        """SELECT id, CASE WHEN kt % 4 = 1 THEN strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%dT%H:%M:%SZ')
          END AS start_time,
        CASE WHEN kt % 6 = 1 THEN strftime(make_timestamp((epoch_s + 18000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
          WHEN kt % 6 = 2 THEN strftime(make_timestamp((epoch_s + 864000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
          WHEN kt % 6 = 5 THEN strftime(make_timestamp((epoch_s - 7200) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
          END AS end_time FROM access_log"""
    ),
    "bool_to_label": _on_parts(
        "SELECT id, CASE WHEN k % 5 <> 0 AND value > 10 THEN 'high' ELSE 'low' END AS label FROM access_log"
    ),
    "marker_radius": _on_facts(
        f"SELECT *, CAST(greatest(5, least(20, count)) AS BIGINT) AS radius FROM ({LIFETIME_SQL})"
    ),
    "valid_coordinate": _on_parts(
        f"""SELECT id, CASE WHEN lat_text IS NULL OR lat_text = 'nan' THEN FALSE WHEN regexp_full_match(lat_text, {FLOAT})
          THEN abs(TRY_CAST(lat_text AS DOUBLE)) <= 180 ELSE TRUE END AS valid FROM access_log"""
    ),
    "authorize_app": _on_parts(
        """SELECT id, COALESCE(NULLIF(app_id_header, ''), app_id_query, '') AS app_id,
          COALESCE(NULLIF(app_id_header, ''), app_id_query, '') IN ('app1', 'app2') AS authorized
        FROM access_log"""
    ),
    "resolve_api_key": _on_parts(
        """SELECT id, COALESCE(authorization_header, '') <> '' OR COALESCE(key_query, '') <> '' AS has_key
        FROM access_log"""
    ),
    "validate_weather": _verdict("'weather'"),
    "validate_tide": _verdict("'tide_extremes', 'sea_level'"),
    "validate_openwaters": _verdict("'ow_extremes', 'ow_timeline'"),
    "validate_geocode": _verdict("'geocode'"),
    "classify_upstream": _on_facts(
        "SELECT id, failed_status AS status_code, failed_type AS error_type, "
        "failed_message AS message FROM reasons"
    ),
    "request_fact": _on_facts("SELECT * FROM requests"),
    "countable_location": _on_facts("SELECT * FROM countable"),
    "dense_weather": _steps(
        f"{_wanted(True, 'value + i')} AS h1, {_wanted(False, 'value * 2')} AS d1, "
        f"{_wanted(True, 'CASE WHEN (k + i) % 5 <> 0 THEN value / 4 ELSE 0 END')} AS p1, "
        f"{_wanted(False, 'value - i')} AS h2, "
        f"{_wanted(False, 'CASE WHEN (k + i) % 3 <> 0 THEN i ELSE 0 END')} AS d2, "
        f"{_wanted(False, 'i + 0.5')} AS p2, {_wanted(False, 'i')} AS wd, {_wanted(True, 'value')} AS ws"
    ),
    "dense_tide_extremes": _steps(
        "value - i AS h, CASE i WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS t"
    ),
    "dense_sea_level": _steps(
        "CASE WHEN (k + i) % 4 <> 0 THEN value + i ELSE 0 END AS h, CAST(NULL AS VARCHAR) AS t"
    ),
    "dense_ow_extremes": _steps(
        "value + i AS h, CASE WHEN i % 2 = 1 THEN 'high' ELSE 'low' END AS t"
    ),
    "dense_ow_timeline": TIMELINE_SQL,
    "geocode_project": _on_parts(
        """SELECT id, CASE WHEN k <> 40 THEN 'Bay ' || u % 7 END AS locality,
          CASE WHEN k <> 40 AND k % 2 = 0 THEN 'City ' || k % 3 END AS city,
          CASE WHEN k <> 40 AND k % 3 = 0 THEN 'Indonesia' END AS "countryName",
          CASE WHEN k <> 40 THEN 'ID' END AS "countryCode"
        FROM access_log WHERE k % 25 NOT IN (22, 24)"""
    ),
    "pack_dense": f"""WITH {STEPS_SQL}
      SELECT a.id, '{{"data":[' || COALESCE(p.points, '') || ']}}' AS document
      FROM access_log a LEFT JOIN (
        SELECT id, string_agg('{{"ts":' || step_s || ',"h":'
          || CASE WHEN value + i = floor(value + i) THEN CAST(CAST(value + i AS BIGINT) AS VARCHAR)
            ELSE CAST(value + i AS VARCHAR) END
          || ',"t":"' || CASE WHEN i % 2 = 1 THEN 'high' ELSE 'low' END || '"}}', ',' ORDER BY i) AS points
        FROM timed GROUP BY id) p ON a.id = p.id
      WHERE a.k % 25 NOT IN (22, 24)""",
    "route_corrupt": CORRUPT_SQL,
    "custom_location_join": f"""WITH {GEO_SQL}
      SELECT p.id, p.lat_cell, p.lng_cell, o.name AS locality, CAST(NULL AS VARCHAR) AS city,
        CAST(NULL AS VARCHAR) AS "countryName", CAST(NULL AS VARCHAR) AS "countryCode"
      FROM points p LEFT JOIN overrides o ON p.lat_cell = o.lat_cell AND p.lng_cell = o.lng_cell""",
    "geocode_resolve": f"""WITH {GEO_SQL},
      {SOURCED_SQL}
      SELECT id, ts, lat_cell, lng_cell, source,
        CASE source WHEN 'override' THEN name WHEN 'cache' THEN locality WHEN 'upstream' THEN locality
          END AS locality,
        CASE WHEN source IN ('cache', 'upstream') THEN city END AS city,
        CASE WHEN source IN ('cache', 'upstream') THEN countryName END AS "countryName",
        CASE WHEN source IN ('cache', 'upstream') THEN countryCode END AS "countryCode"
      FROM sourced""",
    "route_backend_join": _on_facts(
        "SELECT id, path, route_backend AS backend, kind, family = 'stormglass' AS needs_key FROM named"
    ),
    "ttl_dedup": f"WITH {TTL_SQL} SELECT * FROM labelled",
    "ttl_dedup_requests": f"WITH {TTL_SQL} SELECT * FROM labelled",
    "served_request_fact": f"WITH {SERVED_SQL} SELECT * FROM served_requests",
    "served_backend_stats": f"WITH {SERVED_SQL} "
    f"{STATS_SQL.replace('FROM requests', 'FROM served_requests')} GROUP BY backend",
    "ttl_upstream_calls": f"""WITH {TTL_SQL}
      SELECT cache_key, count(*) AS requests, count(*) FILTER (WHERE cache = 'HIT') AS hits,
        count(*) FILTER (WHERE cache = 'MISS') AS upstream_calls
      FROM labelled GROUP BY cache_key""",
    "first_seen_cell": f"""WITH {GEO_SQL}
      SELECT lat_cell, lng_cell, first_ts, first_id, locality, city, countryName AS "countryName",
        countryCode AS "countryCode" FROM ({FIRST_SQL.format(points='points')})""",
    "lifetime_locations": _on_facts(LIFETIME_SQL),
    "windowed_locations": _on_facts(
        f"SELECT lat, lng, count(*) AS count FROM requests WHERE {WEEK} "
        "AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY lat, lng"
    ),
    "backend_stats": _on_facts(f"{STATS_SQL} GROUP BY backend"),
    "backend_stats_week": _on_facts(f"{STATS_SQL} WHERE {WEEK} GROUP BY backend"),
    "overall_totals": _on_facts(
        """SELECT count(*) FILTER (WHERE status_code < 400) AS success,
          count(*) FILTER (WHERE status_code >= 400) AS failed, count(*) AS total FROM requests"""
    ),
    "failure_reasons": _on_facts(REASONS_SQL.format(more="")),
    "failure_reasons_week": _on_facts(REASONS_SQL.format(more=f" AND {WEEK}")),
    "last_n_days": _on_facts(f"SELECT id, ts, status_code FROM requests WHERE {WEEK}"),
    "recent_errors": _on_facts(
        f"""SELECT * REPLACE (COALESCE(NULLIF(request_body, ''), 'N/A') AS request_body,
            COALESCE(NULLIF(upstream_response, ''), 'N/A') AS upstream_response)
          FROM errors WHERE {WEEK} ORDER BY ts DESC, id DESC LIMIT 50"""
    ),
    "retention": _on_facts(
        """SELECT 'requests' AS log, id, ts, status_code FROM requests
            WHERE ts >= TIMESTAMP '2024-01-11 12:30:00'
          UNION ALL SELECT 'error_logs', id, ts, status_code FROM errors
            WHERE ts >= TIMESTAMP '2024-01-11 12:30:00'"""
    ),
    "backfill_timestamp": _on_facts(
        """SELECT id, CASE WHEN id % 7 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS ts, backend
        FROM requests"""
    ),
    "evolve_schema": _on_facts(
        """SELECT id, CASE WHEN id % 3 < 2 THEN ts END AS ts, backend, status_code, error_type,
          CASE WHEN id % 3 = 0 THEN lat END AS lat, CASE WHEN id % 3 = 0 THEN lng END AS lng FROM requests"""
    ),
    "stream_requests": _on_facts("SELECT * FROM requests"),
    "stream_retention": _on_facts(
        "SELECT id, ts, status_code FROM requests WHERE ts >= TIMESTAMP '2024-01-11 12:30:00'"
    ),
    "stream_errors": _on_facts("SELECT * FROM errors"),
    "stream_locations": _on_facts(LIFETIME_SQL),
    "stream_ttl_dedup": f"WITH {TTL_SQL} SELECT id, cache_key, success, cache FROM labelled",
    "stream_backend_stats": _on_facts(f"{STATS_SQL} GROUP BY backend"),
}
CHECKS["authorize_app_by_table"] = CHECKS["authorize_app"]

def _number(x: str) -> str:
    """Text of a number in a document: whole ones without a fraction."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


WEATHER_SQL = f"""WITH {ACCESS_LOG_SQL},
answers AS (SELECT * FROM access_log WHERE k % 25 NOT IN (22, 24)),
hours AS (
  SELECT *, CASE WHEN k = 23 THEN {ZERO_TIME} ELSE epoch_s + i * 3600 END AS hour_s FROM (
    SELECT id, k, value, epoch_s,
      unnest(range(0, CASE WHEN k = 33 THEN 168 WHEN k % 10 = 7 THEN 24 ELSE k % 4 END)) AS i
    FROM answers WHERE k <> 40)),
points AS (
  SELECT id, i, CASE WHEN k % 2 = 0 THEN '{{"ts":' || hour_s || ',"h1":' || {_number('(value + i)')} || ',"p1":'
      || {_number('(CASE WHEN (k + i) % 5 <> 0 THEN value / 4 ELSE 0 END)')} || ',"ws":' || {_number('value')} || '}}'
    ELSE '{{"ts":' || hour_s || ',"d1":' || {_number('(value * 2)')} || ',"h2":' || {_number('(value - i)')}
      || ',"d2":' || CASE WHEN (k + i) % 3 <> 0 THEN i ELSE 0 END || ',"p2":' || i || '.5,"wd":' || i || '}}' END AS point
  FROM hours),
packed AS (SELECT id, string_agg(point, ',' ORDER BY i) AS points FROM points GROUP BY id)
SELECT a.id, '{{"data":[' || COALESCE(p.points, '') || ']}}' AS document
FROM answers a LEFT JOIN packed p ON a.id = p.id"""

SERVED_ERRORS = "(SELECT * FROM errors WHERE id NOT IN (SELECT id FROM served))"
SERVED_CELLS = f"""SELECT lat, lng, count(*) AS count FROM (
  SELECT o.id, {_cell('raw_lat')} AS lat, {_cell('raw_lng')} AS lng
  FROM outcomes o LEFT JOIN served s ON o.id = s.id
  WHERE (o.status_code < 400 OR s.id IS NOT NULL) AND raw_lat <> 0 AND raw_lng <> 0
    AND raw_lat BETWEEN -180 AND 180 AND raw_lng BETWEEN -180 AND 180)
GROUP BY lat, lng"""
SHOWN_ERRORS = """SELECT * REPLACE (COALESCE(NULLIF(request_body, ''), 'N/A') AS request_body,
    COALESCE(NULLIF(upstream_response, ''), 'N/A') AS upstream_response)
  FROM {errors} {where} ORDER BY ts DESC, id DESC LIMIT 50"""
MIDDAY_WEEK = "ts >= TIMESTAMP '2024-01-24 12:00:00'"
WINDOWED_SQL = """SELECT lat, lng, count(*) AS count FROM {facts} WHERE {week}
  AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY lat, lng"""


def _on_served(query: str) -> str:
    return f"WITH {SERVED_SQL} {query}"


CHECKS |= {
    "uncached_request_fact": f"""WITH {GEO_SQL}, {SOURCED_SQL}
      SELECT r.* REPLACE (CASE WHEN s.id IS NOT NULL THEN 200 ELSE r.status_code END AS status_code,
        CASE WHEN s.id IS NOT NULL THEN '' ELSE r.error_type END AS error_type)
      FROM requests r LEFT JOIN (SELECT id FROM sourced WHERE source = 'override') s ON r.id = s.id""",
    "served_lifetime_locations": _on_served(SERVED_CELLS),
    "served_windowed_locations": _on_served(WINDOWED_SQL.format(facts="served_requests", week=WEEK)),
    "served_failure_reasons": _on_served(REASONS_SQL.format(more="").replace("FROM requests", "FROM served_requests")),
    "served_recent_errors": _on_served(SHOWN_ERRORS.format(errors=SERVED_ERRORS, where=f"WHERE {WEEK}")),
    "first_seen_cell_stored": CHECKS["first_seen_cell"],
    "windowed_locations_by_day": _on_facts(WINDOWED_SQL.format(facts="requests", week=MIDDAY_WEEK)),
    "failure_reasons_by_day": _on_facts(REASONS_SQL.format(more=f" AND {MIDDAY_WEEK}")),
    "recent_errors_by_day": _on_facts(SHOWN_ERRORS.format(errors="errors", where="")),
    "evolve_error_logs": _on_facts(
        """SELECT * REPLACE (CASE WHEN id % 3 = 2 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS ts,
          CASE WHEN id % 3 = 0 THEN upstream_response END AS upstream_response) FROM errors"""
    ),
    "stream_served_requests": _on_served("SELECT * FROM served_requests"),
    "stream_served_errors": _on_served(f"SELECT * FROM {SERVED_ERRORS}"),
    "stream_served_locations": _on_served(SERVED_CELLS),
    "stream_served_reasons": _on_served(
        REASONS_SQL.format(more=f" AND {MIDDAY_WEEK}").replace("FROM requests", "FROM served_requests")
    ),
    "src_custom_locations_whole": """
      WITH lines AS (
        SELECT *, s_suppkey % 6 AS file,
          CASE s_suppkey % 6 WHEN 3 THEN 2 WHEN 4 THEN 4
            WHEN 1 THEN CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 3 END
            WHEN 2 THEN CASE WHEN s_suppkey % 5 = 0 THEN 4 ELSE 3 END ELSE 3 END AS fields
        FROM supplier)
      SELECT CAST(s_suppkey % 40 * 125 - 900 AS DOUBLE) AS lat_cell,
        CAST(s_suppkey % 3 - 1 AS DOUBLE) AS lng_cell,
        arg_max(s_name || ', "sea"', file * 1000000000000 + s_suppkey) AS name
      FROM lines WHERE fields >= 3
        AND file IN (SELECT file FROM lines GROUP BY file HAVING min(fields) = max(fields))
      GROUP BY 1, 2""",
    "pack_weather": WEATHER_SQL,
    "retention_by_cut_off": CHECKS["retention"],
}
