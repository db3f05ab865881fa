"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from swellframe.functions import grid, numbers, query_text, request_text, times
from swellframe.operators import (
    admission,
    facts,
    geocode,
    payloads,
    reports,
    response_cache,
    served,
    upstream,
    validation,
)
from swellframe.plans import mapping
from swellframe.plans.mapping import ALLOWED_APPS, AS_OF
from swellframe.sources import access_log as log_source
from swellframe.sources import custom_locations, tables
from swellframe.sources.workspace import fresh_folder, written, written_compiled
from swellframe.streaming import landing
from swellframe.streaming import requests as request_streams
from swellframe.streaming import response_cache as cache_stream
from swellframe.streaming import served as served_stream

Query = Callable[[SparkSession, str], DataFrame]

# Retention runs at a time that puts its cut-off inside the given month.
RETENTION_AS_OF = datetime(2024, 2, 10, 12, 30)
WINDOW_DAYS = 7
# A report time that cuts a day in two.
MIDDAY = datetime(2024, 1, 31, 12)
# Rows of a file of an arriving log.
FILE_ROWS = 100_000


# ---- inputs ------------------------------------------------------------------

def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapped(mapping.events(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.classify(mapping.access_log(spark, sf_dir), ALLOWED_APPS)


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.request_facts(classified(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.countable(classified(spark, sf_dir))


def override_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom_locations.override_table(mapping.overrides(spark, sf_dir))


def on_route(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Access log rows of some kinds of route, with their query values."""
    routed = facts.with_route(mapping.access_log(spark, sf_dir))
    return query_text.with_query_values(routed.filter(F.col("kind").isin(*kinds)))


# ---- sources and sinks -------------------------------------------------------

def src_custom_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV of supplier places, with short rows, bad numbers and cells named twice."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    lat = F.when(key % 10 == 4, "south").otherwise((key % 40 * 125 - 900).cast("string"))
    line = F.when(key % 10 == 7, F.concat(lat, F.lit(", 1"))).otherwise(
        F.concat_ws(", ", lat, key % 3 - 1, F.col("s_name"))
    )
    folder = fresh_folder(spark, "custom-locations")
    # Ordered files: between rows of one cell the last line counts.
    suppliers.select(key, line.alias("line")).repartitionByRange("s_suppkey").sortWithinPartitions(
        "s_suppkey"
    ).select("line").write.text(folder)
    return custom_locations.read_custom_locations(spark, folder)


def src_custom_locations_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of supplier places, of which the ragged ones load nothing.

    Files differ in their number of fields: three, four, two, or not the same in all rows.
    """
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, file = F.col("s_suppkey"), F.col("s_suppkey") % 6
    place = F.concat_ws(", ", key % 40 * 125 - 900, key % 3 - 1)
    named = F.concat(place, F.lit(',"'), F.col("s_name"), F.lit(', ""sea"" "'))
    line = (
        F.when((file == 1) & (key % 5 == 0), place)
        .when((file == 2) & (key % 5 == 0), F.concat(named, F.lit(",more")))
        .when(file == 3, place)
        .when(file == 4, F.concat(named, F.lit(",more")))
        .otherwise(named)
    )
    folder = fresh_folder(spark, "custom-locations")
    rows = suppliers.select(key, file.alias("file"), line.alias("line")).repartition("file")
    rows.sortWithinPartitions("file", "s_suppkey").select("line", "file").write.partitionBy("file").text(folder)
    return custom_locations.read_whole_files(spark, folder)


def src_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "access-log")
    mapping.access_log(spark, sf_dir).write.parquet(folder)
    return log_source.read_access_log(spark, folder)


def src_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "payloads")
    rows = mapping.payloads(spark, sf_dir, "geocode")
    rows.select("id", "kind", "params", "body").write.parquet(folder)
    return payloads.decode(log_source.read_payloads(spark, folder), "geocode").select(
        "id", "decoded", F.col("doc.locality").cast("string").alias("locality")
    )


def sink_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "requests")
    tables.append_by_day(request_rows(spark, sf_dir), folder)
    return tables.read_by_day(spark, folder, tables.REQUESTS)


def sink_error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "error-logs")
    tables.append_by_day(facts.error_rows(classified(spark, sf_dir)), folder)
    return tables.read_by_day(spark, folder, tables.ERROR_LOGS)


def sink_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counters of the first half of the month, then merged with the rest."""
    counted = written_compiled(cells(spark, sf_dir), "cells")
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    folder = fresh_folder(spark, "locations")
    for source, part in (("first", F.col("ts") < half), ("rest", F.col("ts") >= half)):
        batch = counted.filter(part)
        tables.merge_version(
            spark, folder, tables.LOCATIONS, source,
            lambda counters, batch=batch: tables.merge_locations(counters, batch),
        )
    return tables.read_version(spark, folder, tables.LOCATIONS)


# ---- scalar expressions ------------------------------------------------------

def round_half_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value") - F.lit(25.0)
    return mapping.events(spark, sf_dir).select(
        "event_id",
        numbers.round_half_away(value / 8).alias("whole"),
        numbers.round_half_away(value / 8, 1).alias("tenths"),
        numbers.round_half_away(value / 7, 2).alias("cents"),
    )


def _number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    text = F.when(F.col("k") % 9 == 6, F.concat("lat_text", F.lit("e2"))).otherwise(
        F.coalesce("lat_text", F.lit(""))
    )
    return rows.select("id", F.when(F.col("k") == 90, "1e999").otherwise(text).alias("text"))


def parse_float_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _number_text(spark, sf_dir)
    parsed = numbers.parse_float_lenient(F.col("text"))
    return rows.select(
        "id", "text", parsed.alias("number"), (parsed == float("inf")).alias("overflow")
    ).withColumn("number", F.when(~F.col("overflow"), F.col("number")))


def parse_float_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _number_text(spark, sf_dir)
    parsed = numbers.parse_float_strict(F.col("text"))
    return rows.select("id", "text", parsed.alias("number"), parsed.isNotNull().alias("valid"))


def grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.col("lat_m") / F.lit(1000.0)
    lng = F.col("lng_m") / F.lit(1000.0)
    return parts(spark, sf_dir).select(
        "id", grid.grid_cell(lat).alias("lat_cell"), grid.grid_cell(lng).alias("lng_cell")
    )


def time_window_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = times.window_seconds(F.col("start_text"), F.col("end_text"), F.col("ts"))
    return parts(spark, sf_dir).select("id", start.alias("start_s"), end.alias("end_s"))


def time_window_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = times.aligned_window(F.col("start_text"), F.col("end_text"), F.col("ts"))
    return parts(spark, sf_dir).select("id", start.alias("start_s"), end.alias("end_s"))


def extract_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.extract_coords(mapping.access_log(spark, sf_dir))
    lat = F.nanvl("lat", F.lit(None).cast("double"))
    return rows.select("id", lat.alias("lat"), "lng")


def filter_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = on_route(spark, sf_dir, "weather")
    wanted = request_text.filter_params(F.col("q.params"))
    return rows.select("id", wanted.alias("params"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the requests that reach the cache: those that pass validation."""
    rows = on_route(spark, sf_dir, *facts.CACHED_KINDS)
    q, kind = F.col("q"), F.col("kind")
    valid = rows.filter(
        F.when(kind == "weather", validation.validate_weather(q))
        .otherwise(validation.validate_tide(q))
        .isNull()
    )
    return valid.select("id", facts.request_key(kind, q, F.col("ts")).alias("cache_key"))


def to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(
        "id",
        times.to_epoch(F.coalesce("start_text", F.lit(""))).alias("start_s"),
        times.to_epoch(F.coalesce("end_text", F.lit(""))).alias("end_s"),
    )


def epoch_to_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(
        "id",
        times.epoch_to_rfc3339(F.col("start_text")).alias("start_time"),
        times.epoch_to_rfc3339(F.col("end_text")).alias("end_time"),
    )


def bool_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.when(F.col("k") % 5 != 0, F.col("value") > 10)
    return parts(spark, sf_dir).select("id", request_text.tide_label(high).alias("label"))


def marker_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = reports.lifetime_locations(cells(spark, sf_dir))
    return reports.location_report(request_rows(spark, sf_dir), counters, AS_OF, 0)


# ---- predicates and classification -------------------------------------------

def valid_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = numbers.parse_float_lenient(F.coalesce("lat_text", F.lit("nan")))
    return parts(spark, sf_dir).select("id", grid.valid_coordinate(lat).alias("valid"))


def authorize_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = mapping.access_log(spark, sf_dir)
    return admission.authorize_app(log, ALLOWED_APPS).select("id", "app_id", "authorized")


def authorize_app_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allow list as a table: 'app' and the number of a region."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    allowed = regions.select(F.concat(F.lit(" app"), F.col("r_regionkey")).alias("app_id"))
    log = mapping.access_log(spark, sf_dir)
    return admission.authorize_app_by_table(log, allowed).select("id", "app_id", "authorized")


def resolve_api_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.resolve_api_key(mapping.access_log(spark, sf_dir)).select("id", "has_key")


def _verdicts(rows: DataFrame, check) -> DataFrame:
    return rows.withColumn("verdict", check(F.col("q"))).select("id", "verdict.*")


def validate_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(on_route(spark, sf_dir, "weather"), validation.validate_weather)


def validate_tide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(on_route(spark, sf_dir, "tide_extremes", "sea_level"), validation.validate_tide)


def validate_openwaters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(
        on_route(spark, sf_dir, "ow_extremes", "ow_timeline"), validation.validate_openwaters
    )


def validate_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(on_route(spark, sf_dir, "geocode"), validation.validate_geocode)


def classify_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.with_route(mapping.access_log(spark, sf_dir))
    body_ok = payloads.decodable("upstream_body", "kind")
    failure = upstream.classify_upstream(F.col("route_backend"), F.col("upstream_status"), body_ok)
    return rows.select("id", failure.alias("failure")).select("id", "failure.*")


def request_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_rows(spark, sf_dir).drop("dt")


def countable_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


# ---- payloads ----------------------------------------------------------------

def _dense(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return payloads.dense_rows(mapping.payloads(spark, sf_dir, kind), kind, ["id"])

    return query


def geocode_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.geocode_rows(mapping.payloads(spark, sf_dir, "geocode"), ["id"])


def pack_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.pack_dense(
        mapping.payloads(spark, sf_dir, "ow_extremes"), "ow_extremes", ["id"]
    )


def pack_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather documents of up to a week of hours, with the fields that were asked for."""
    return payloads.pack_dense(mapping.long_weather(spark, sf_dir), "weather", ["id"])


def route_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecodable bodies of every kind of payload."""
    bodies = written(mapping.payloads(spark, sf_dir, *payloads.PAYLOADS), "bodies")
    return payloads.corrupt_payloads(bodies, ["id"])


# ---- joins and cache ---------------------------------------------------------

def custom_location_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = served.geocode_points(classified(spark, sf_dir)).select("id", "lat", "lng")
    joined = geocode.custom_location_join(points, override_names(spark, sf_dir))
    return joined.select("id", "lat_cell", "lng_cell", *geocode.PLACE)


def geocode_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The narrow answers are stored, so that the log is classified only once.
    answers = written_compiled(served.geocode_answers(classified(spark, sf_dir)), "geocode-answers")
    return geocode.geocode_resolve(answers, override_names(spark, sf_dir))


def first_seen_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = geocode.with_cell(served.geocode_answers(classified(spark, sf_dir)).filter("answered"))
    answers = written_compiled(answers, "geocode-answers")
    return geocode.first_seen_cell(answers)


def route_backend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = facts.with_route(mapping.access_log(spark, sf_dir))
    return routed.select("id", "path", F.col("route_backend").alias("backend"), "kind", "needs_key")


def stored_cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow requests that reach the cache, stored: the log is classified only once."""
    return written_compiled(facts.cache_requests(classified(spark, sf_dir)), "cache-requests")


def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_cache.ttl_labels(stored_cache_requests(spark, sf_dir))


def ttl_dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels, with all but the shortest runs solved by joins, as for a hot key."""
    return response_cache.ttl_labels(stored_cache_requests(spark, sf_dir), folded_run=2)


def ttl_upstream_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_cache.upstream_calls(ttl_dedup(spark, sf_dir))


def served_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written_compiled(classified(spark, sf_dir), "classified")
    return served.service_facts(rows, override_names(spark, sf_dir))


def served_request_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in which requests answered from what is stored are successes."""
    return served_rows(spark, sf_dir).drop("dt")


def served_backend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.backend_stats(served_rows(spark, sf_dir), AS_OF)


def service_rows(spark: SparkSession, sf_dir: str, use_cache: bool = True) -> DataFrame:
    rows = written_compiled(classified(spark, sf_dir), "classified")
    return written(served.service_rows(rows, override_names(spark, sf_dir), use_cache), "service-rows")


def uncached_request_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a service without a cache: overrides alone are answered from what is stored."""
    return facts.request_facts(service_rows(spark, sf_dir, use_cache=False)).drop("dt")


def served_lifetime_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lifetime_locations(facts.countable(service_rows(spark, sf_dir)))


def served_windowed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.request_facts(service_rows(spark, sf_dir))
    return reports.windowed_locations(rows, AS_OF, WINDOW_DAYS)


def served_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_reasons(facts.request_facts(service_rows(spark, sf_dir)), AS_OF)


def served_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = facts.error_rows(service_rows(spark, sf_dir))
    return reports.error_view(reports.recent_errors(errors, AS_OF, WINDOW_DAYS))


def first_seen_cell_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers kept as a table, into which answers come in any order and some twice."""
    answers = served.geocode_answers(classified(spark, sf_dir)).filter("answered")
    answers = written_compiled(geocode.with_cell(answers), "geocode-answers")
    folder, part = fresh_folder(spark, "first-answers"), F.pmod(F.xxhash64("id"), F.lit(3))
    for number in (2, 0, 2, 1, 0):
        more = geocode.first_seen_cell(answers.filter(part == number))
        tables.merge_version(
            spark, folder, tables.FIRST_ANSWERS, f"answers/step-{number}",
            lambda stored, more=more: geocode.merge_first_answers(stored, more),
        )
    return tables.read_version(spark, folder, tables.FIRST_ANSWERS)


# ---- reports, retention, schema ----------------------------------------------

def lifetime_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lifetime_locations(cells(spark, sf_dir))


def windowed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.windowed_locations(request_rows(spark, sf_dir), AS_OF, WINDOW_DAYS)


def backend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.backend_stats(request_rows(spark, sf_dir), AS_OF)


def backend_stats_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.backend_stats(request_rows(spark, sf_dir), AS_OF, WINDOW_DAYS)


def overall_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overall_totals(backend_stats(spark, sf_dir))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_reasons(request_rows(spark, sf_dir), AS_OF)


def failure_reasons_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_reasons(request_rows(spark, sf_dir), AS_OF, WINDOW_DAYS)


def last_n_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = reports.last_n_days(request_rows(spark, sf_dir), AS_OF, WINDOW_DAYS)
    return recent.select("id", "ts", "status_code")


def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = facts.error_rows(classified(spark, sf_dir))
    return reports.error_view(reports.recent_errors(errors, AS_OF, WINDOW_DAYS))


def _stored_days(spark: SparkSession, sf_dir: str, roll_up, schema: str) -> tuple[DataFrame, DataFrame]:
    """A roll-up by day kept with the day table of the facts."""
    folder, daily = fresh_folder(spark, "requests"), fresh_folder(spark, "daily")
    tables.append_by_day(request_rows(spark, sf_dir), folder)
    rows = tables.read_by_day(spark, folder, tables.REQUESTS)
    tables.merge_version(
        spark, daily, schema, "facts",
        lambda counts: tables.merge_sums(counts, roll_up(rows), [c for c in counts.columns if c != "count"], ["count"]),
    )
    return tables.read_version(spark, daily, schema), rows


def windowed_locations_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, rows = _stored_days(spark, sf_dir, reports.cell_days, tables.CELL_DAYS)
    return reports.windowed_locations_by_day(daily, rows, MIDDAY, WINDOW_DAYS)


def failure_reasons_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, rows = _stored_days(spark, sf_dir, reports.reason_days, tables.REASON_DAYS)
    return reports.failure_reasons_by_day(daily, rows, MIDDAY, WINDOW_DAYS)


def recent_errors_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors of a day table, read from the newest day back."""
    folder = fresh_folder(spark, "error-logs")
    tables.append_by_day(facts.error_rows(classified(spark, sf_dir)), folder)
    newest = tables.recent_days(spark, folder, tables.ERROR_LOGS, reports.RECENT_ERRORS)
    return reports.error_view(reports.recent_errors(newest, AS_OF))


def evolve_error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error logs of three ages, the older ones without the upstream answer, the oldest without
    times; these get the load time."""
    rows = written_compiled(facts.error_rows(classified(spark, sf_dir)).drop("dt"), "errors-of-ages")
    age = F.col("id") % 3
    united = tables.evolve_schema(
        rows.filter(age == 0),
        rows.filter(age == 1).drop("upstream_response"),
        rows.filter(age == 2).drop("ts", "upstream_response"),
    )
    return tables.backfill_timestamp(united, AS_OF).drop("dt")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logs after retention: what is left, by table and day."""
    both = written_compiled(classified(spark, sf_dir), "classified")
    left = []
    for name, rows, schema in (
        ("requests", facts.request_facts(both), tables.REQUESTS),
        ("error_logs", facts.error_rows(both), tables.ERROR_LOGS),
    ):
        folder = fresh_folder(spark, name)
        tables.append_by_day(rows, folder)
        tables.drop_expired(spark, folder, schema, RETENTION_AS_OF)
        kept = tables.read_by_day(spark, folder, schema)
        left.append(kept.select(F.lit(name).alias("log"), "id", "ts", "status_code"))
    return left[0].unionByName(left[1])


def retention_by_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logs after their cut-off has moved in two steps; no day is written again."""
    both = written_compiled(classified(spark, sf_dir), "classified")
    kept = []
    for name, rows, schema in (
        ("requests", facts.request_facts(both), tables.REQUESTS),
        ("error_logs", facts.error_rows(both), tables.ERROR_LOGS),
    ):
        folder = fresh_folder(spark, name)
        tables.append_by_day(rows, folder)
        for as_of in (RETENTION_AS_OF - timedelta(days=5), RETENTION_AS_OF):
            tables.move_cut_off(spark, folder, schema, as_of)
        left = tables.read_kept(spark, folder, schema)
        kept.append(left.select(F.lit(name).alias("log"), "id", "ts", "status_code"))
    return kept[0].unionByName(kept[1])


def backfill_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_rows(spark, sf_dir).withColumn(
        "ts", F.when(F.col("id") % 7 != 0, F.col("ts"))
    )
    return tables.backfill_timestamp(rows, AS_OF).select("id", "ts", "backend")


def evolve_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of three ages: without place, without time and place, and as today."""
    rows = written_compiled(request_rows(spark, sf_dir).drop("dt"), "requests-of-ages")
    age = F.col("id") % 3
    return tables.evolve_schema(
        rows.filter(age == 0),
        rows.filter(age == 1).drop("lat", "lng"),
        rows.filter(age == 2).drop("ts", "lat", "lng"),
    )


# ---- streams -----------------------------------------------------------------

def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log of ``sf_dir`` as a file stream."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet")
    events = reader.option("maxBytesPerTrigger", 2**30).parquet(sf_dir)
    # Dealt anew: a file of few row groups would keep a few tasks busy with all requests.
    events = events.repartition(2 * spark.sparkContext.defaultParallelism)
    return mapping.mapped(events).select(*mapping.LOG_COLUMNS)


def _loaded(rows: DataFrame, name: str, load) -> str:
    """Run a stream over all given input and load it; the folder of its table."""
    spark = rows.sparkSession
    folder, landed_in, state = (fresh_folder(spark, f"{name}{part}") for part in ("", "-landing", "-state"))
    landing.load_stream(rows, landed_in, state, lambda landed, source: load(landed, folder, source))
    return folder


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_streams.classified_stream(log_stream(spark, sf_dir), ALLOWED_APPS)
    load = lambda landed, folder, source: request_streams.load_requests(landed, folder)
    folder = _loaded(rows, "stream-requests", load)
    return tables.read_by_day(spark, folder, tables.REQUESTS).drop("dt")


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed requests after retention."""
    rows = request_streams.classified_stream(log_stream(spark, sf_dir), ALLOWED_APPS)
    load = lambda landed, folder, source: request_streams.load_requests(landed, folder)
    folder = _loaded(rows, "stream-retention", load)
    tables.drop_expired(spark, folder, tables.REQUESTS, RETENTION_AS_OF)
    return tables.read_by_day(spark, folder, tables.REQUESTS).select("id", "ts", "status_code")


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_streams.classified_stream(log_stream(spark, sf_dir), ALLOWED_APPS)
    load = lambda landed, folder, source: request_streams.load_errors(landed, folder)
    folder = _loaded(rows, "stream-errors", load)
    return tables.read_by_day(spark, folder, tables.ERROR_LOGS).drop("dt")


def stream_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_streams.classified_stream(log_stream(spark, sf_dir), ALLOWED_APPS)
    folder = _loaded(rows, "stream-locations", request_streams.load_locations)
    return tables.read_version(spark, folder, tables.LOCATIONS)


def _arriving(log: DataFrame, part: Column, source: str) -> DataFrame:
    """Adds a part of a stored log to the files in ``source``, and gives these as a stream.

    The part arrives in two micro-batches. The number of files grows with its rows, so that
    a task reads a bounded number of them.
    """
    rows = log.filter(part)
    batch = max(1, ceil(rows.count() / (2 * FILE_ROWS)))
    rows.repartition(2 * batch).write.mode("append").parquet(source)
    return log.sparkSession.readStream.schema(log.schema).option("maxFilesPerTrigger", batch).parquet(source)


def stream_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access log of several files that arrives in two parts, each in micro-batches."""
    log = written_compiled(mapping.access_log(spark, sf_dir), "arriving-log")
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    names = ("log-files", "stream-labels", "stream-labels-landing", "stream-labels-state")
    source, labels, landed_in, state = (fresh_folder(spark, name) for name in names)
    for part in (F.col("ts") < half, F.col("ts") >= half):
        files = _arriving(log, part, source)
        landing.load_stream(
            cache_stream.cache_request_stream(files, ALLOWED_APPS),
            landed_in,
            state,
            lambda landed, name: cache_stream.label_arrivals(landed, labels),
        )
    return tables.read_by_day(spark, labels, cache_stream.LABELS).select(
        "id", "cache_key", "success", "cache"
    )


def stream_backend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts per day and backend, added up over the days."""
    rows = request_streams.classified_stream(log_stream(spark, sf_dir), ALLOWED_APPS)
    folder = _loaded(rows, "stream-backend-days", request_streams.load_backend_days)
    days = tables.read_version(spark, folder, tables.BACKEND_DAYS)
    return days.groupBy("backend").agg(F.sum("success").alias("success"), F.sum("failed").alias("failed"))


def _served_tables(spark: SparkSession, sf_dir: str) -> str:
    """The folder of all tables after a log has arrived in two parts, each in micro-batches."""
    log = written_compiled(mapping.access_log(spark, sf_dir), "arriving-log")
    overrides = written(override_names(spark, sf_dir), "overrides")
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    names = ("log-files", "served-tables", "served-landing", "served-state")
    source, folder, landed_in, state = (fresh_folder(spark, name) for name in names)
    for part in (F.col("ts") < half, F.col("ts") >= half):
        files = _arriving(log, part, source)
        landing.load_stream(
            request_streams.classified_stream(files, ALLOWED_APPS),
            landed_in,
            state,
            lambda landed, step: served_stream.load_served(landed, overrides, folder, step),
        )
    return folder


def stream_served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _served_tables(spark, sf_dir)
    return tables.read_by_day(spark, f"{folder}/{served_stream.REQUESTS}", tables.REQUESTS).drop("dt")


def stream_served_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _served_tables(spark, sf_dir)
    return tables.read_by_day(spark, f"{folder}/{served_stream.ERRORS}", tables.ERROR_LOGS).drop("dt")


def stream_served_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _served_tables(spark, sf_dir)
    return tables.read_version(spark, f"{folder}/{served_stream.LOCATIONS}", tables.LOCATIONS)


def stream_served_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure reasons from the roll-up that the stream keeps."""
    folder = _served_tables(spark, sf_dir)
    daily = tables.read_version(spark, f"{folder}/{served_stream.REASONS}", tables.REASON_DAYS)
    rows = tables.read_by_day(spark, f"{folder}/{served_stream.REQUESTS}", tables.REQUESTS)
    return reports.failure_reasons_by_day(daily, rows, MIDDAY, WINDOW_DAYS)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        src_custom_locations,
        src_access_log,
        src_payloads,
        sink_requests,
        sink_error_logs,
        sink_locations,
        round_half_away,
        parse_float_lenient,
        parse_float_strict,
        grid_cell,
        time_window_parse,
        time_window_align,
        extract_coords,
        filter_params,
        cache_key,
        to_epoch,
        epoch_to_rfc3339,
        bool_to_label,
        marker_radius,
        valid_coordinate,
        authorize_app,
        authorize_app_by_table,
        resolve_api_key,
        validate_weather,
        validate_tide,
        validate_openwaters,
        validate_geocode,
        classify_upstream,
        request_fact,
        countable_location,
        geocode_project,
        pack_dense,
        route_corrupt,
        custom_location_join,
        geocode_resolve,
        route_backend_join,
        ttl_dedup,
        ttl_dedup_requests,
        served_request_fact,
        served_backend_stats,
        ttl_upstream_calls,
        first_seen_cell,
        lifetime_locations,
        windowed_locations,
        backend_stats,
        backend_stats_week,
        overall_totals,
        failure_reasons,
        failure_reasons_week,
        last_n_days,
        recent_errors,
        retention,
        backfill_timestamp,
        evolve_schema,
        stream_requests,
        stream_retention,
        stream_errors,
        stream_locations,
        stream_ttl_dedup,
        stream_backend_stats,
        uncached_request_fact,
        served_lifetime_locations,
        served_windowed_locations,
        served_failure_reasons,
        served_recent_errors,
        first_seen_cell_stored,
        windowed_locations_by_day,
        failure_reasons_by_day,
        recent_errors_by_day,
        evolve_error_logs,
        stream_served_requests,
        stream_served_errors,
        stream_served_locations,
        stream_served_reasons,
        src_custom_locations_whole,
        pack_weather,
        retention_by_cut_off,
    )
} | {
    "dense_weather": _dense("weather"),
    "dense_tide_extremes": _dense("tide_extremes"),
    "dense_sea_level": _dense("sea_level"),
    "dense_ow_extremes": _dense("ow_extremes"),
    "dense_ow_timeline": _dense("ow_timeline"),
}
