"""Overrides, place names, log tables, retention and stream restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from swellframe.operators import geocode
from swellframe.sources import custom_locations, tables
from swellframe.streaming import landing
from swellframe.streaming import requests as streams

TS = datetime(2024, 3, 5, 10, 30)


def test_custom_locations_file(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_text(
        "12.341, 45.679, Old Pier\n12.3551, 45.6812, North Cove\n"
        '1.0, 2.0\nsouth, 3.0, Nowhere \n12.342, 45.68, Later\n4, 5,\n'
        '6,7,"Joe ""Big"" Bay"\n8,9," Two\nLines "\n'
    )
    rows = custom_locations.read_custom_locations(spark, str(path)).collect()
    assert {(r.lat_cell, r.lng_cell): r.name for r in rows} == {
        (12.34, 45.68): "Later",
        (12.36, 45.68): "North Cove",
        (0.0, 3.0): "Nowhere",
        (4.0, 5.0): "",
        (6.0, 7.0): 'Joe "Big" Bay',
        (8.0, 9.0): "Two\nLines",
    }


def test_missing_custom_locations_file(spark, tmp_path):
    assert custom_locations.read_custom_locations(spark, str(tmp_path / "none.csv")).count() == 0


def names_of(table):
    return {(r.lat_cell, r.lng_cell): r.name for r in table.collect()}


def test_a_ragged_file_loads_nothing(spark, tmp_path):
    files = {
        "a.csv": "1,1,one\n2,2,two\n",
        "b.csv": "1,1,short\n5,5\n",
        "c.csv": '1,1,long\n6,6,six,"more, and more"\n',
        "d.csv": '2,2," Two, ""2"" ",x\n\n7,7,"Seven\n7",y\n8,8,,z\n',
        "e.csv": "9,9\n9,8\n",
        "f.csv": '3,3,"a,b",c\n4,4,"a\n"",b,"\n',
        "g.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    expected = {(1.0, 1.0): "one", (2.0, 2.0): 'Two, "2"', (7.0, 7.0): "Seven\n7", (8.0, 8.0): ""}
    assert names_of(custom_locations.read_whole_files(spark, str(tmp_path))) == expected
    assert names_of(custom_locations.read_whole_files(spark, str(tmp_path / "b.csv"))) == {}
    assert names_of(custom_locations.read_whole_files(spark, str(tmp_path / "none.csv"))) == {}


PLACES = "id BIGINT, ts TIMESTAMP_NTZ, lat DOUBLE, lng DOUBLE, answered BOOLEAN, " + ", ".join(
    f"{name} STRING" for name in geocode.PLACE
)


def test_geocode_priority(spark):
    def row(id_, minutes, lat, answered, locality):
        return (id_, TS + timedelta(minutes=minutes), lat, 2.0, answered, locality, None, None, None)

    requests = spark.createDataFrame(
        [
            row(1, 0, 1.0, False, None),
            row(2, 1, 1.001, True, "first"),
            row(3, 2, 1.0, True, "second"),
            row(4, 3, 1.0, False, None),
            row(5, 0, 7.0, True, "ignored"),
            row(6, 0, -0.001, True, "zero"),
            row(7, 1, 0.001, True, "other"),
        ],
        PLACES,
    )
    overrides = spark.createDataFrame([(7.0, 2.0, "named")], "lat_cell DOUBLE, lng_cell DOUBLE, name STRING")
    rows = geocode.geocode_resolve(requests, overrides).collect()
    assert {r.id: (r.source, r.locality) for r in rows} == {
        1: (None, None),
        2: ("upstream", "first"),
        3: ("cache", "first"),
        4: ("cache", "first"),
        5: ("override", "named"),
        6: ("upstream", "zero"),
        7: ("cache", "zero"),
    }


def test_first_answers_come_from_a_hash_aggregate(spark):
    rows = spark.createDataFrame([(1, TS, 1.0, 2.0, True, "a", None, None, None)], PLACES)
    plan = geocode.first_seen_cell(geocode.with_cell(rows))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[lat_cell" in plan.replace("knownfloatingpointnormalized(normalizenanandzero(", "")


def fact_rows(spark, *times):
    return spark.createDataFrame(
        [(i, t, "b", 200, "", None, None, t.date()) for i, t in enumerate(times)], tables.REQUESTS
    )


def test_retention_rewrites_only_the_boundary_day(spark, tmp_path):
    path = str(tmp_path / "requests")
    days = [datetime(2024, 3, d, h) for d in (1, 2, 3) for h in (1, 13)]
    tables.append_by_day(fact_rows(spark, *days), path)
    as_of = datetime(2024, 4, 1, 12)
    tables.drop_expired(spark, path, tables.REQUESTS, as_of)
    kept = tables.read_by_day(spark, path, tables.REQUESTS)
    assert sorted(row.ts for row in kept.collect()) == days[3:]
    # Running it again, or when nothing of the boundary day is left, is safe.
    tables.drop_expired(spark, path, tables.REQUESTS, as_of)
    tables.drop_expired(spark, path, tables.REQUESTS, datetime(2024, 4, 1, 20))
    kept = tables.read_by_day(spark, path, tables.REQUESTS)
    assert sorted(row.ts for row in kept.collect()) == days[4:]


def test_counters_merge(spark):
    counters = spark.createDataFrame([(1.0, 2.0, 5), (3.0, 4.0, 1)], tables.LOCATIONS)
    batch = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (9.0, 9.0)], "lat DOUBLE, lng DOUBLE")
    merged = tables.merge_locations(counters, batch).collect()
    assert sorted(tuple(row) for row in merged) == [(1.0, 2.0, 7), (3.0, 4.0, 1), (9.0, 9.0, 1)]


def test_location_stream_goes_on_after_a_restart(spark, log_rows, tmp_path):
    source = str(tmp_path / "log")

    def add(*latitudes):
        rows = [
            {"ts": TS, "path": "/data/reverse-geocode-client", "upstream_status": 200,
             "upstream_body": "{}", "query": f"latitude={lat}&longitude=2"}
            for lat in latitudes
        ]
        log_rows(*rows).write.mode("append").parquet(source)

    table = str(tmp_path / "counters")

    def run(load=streams.load_locations):
        from swellframe.sources.access_log import stream_access_log

        rows = streams.classified_stream(stream_access_log(spark, source))
        landing.load_stream(
            rows, str(tmp_path / "landing"), str(tmp_path / "state"),
            lambda landed, step: load(landed, table, step),
        )
        return sorted(tuple(row) for row in tables.read_version(spark, table, tables.LOCATIONS).collect())

    add(1.0, 1.001, 3.0)
    assert run() == [(1.0, 2.0, 2), (3.0, 2.0, 1)]
    add(1.0)

    def stopped(landed, folder, step):
        streams.load_locations(landed, folder, step)
        raise RuntimeError("stopped after loading")

    with pytest.raises(RuntimeError):
        run(stopped)
    # The step is repeated with the same rows, and counts them once.
    assert run() == [(1.0, 2.0, 3), (3.0, 2.0, 1)]
    assert run() == [(1.0, 2.0, 3), (3.0, 2.0, 1)]
    assert len(tables.list_folders(spark, table)) <= 2


def test_retention_and_appends_on_a_streamed_table(spark, log_rows, tmp_path):
    from swellframe.sources.access_log import stream_access_log

    source, table = str(tmp_path / "log"), str(tmp_path / "requests")
    rows = [
        {"id": 100 * day + i, "ts": datetime(2024, 3, day, i % 24), "path": "/tides/timeline",
         "upstream_status": 200, "upstream_body": "{}", "query": "latitude=1&longitude=2"}
        for day in (1, 2, 3) for i in range(30)
    ]
    log_rows(*rows).repartition(4).write.parquet(source)
    landing.load_stream(
        streams.classified_stream(stream_access_log(spark, source)),
        str(tmp_path / "landing"), str(tmp_path / "state"),
        lambda landed, step: streams.load_requests(landed, table),
    )
    read = lambda: tables.read_by_day(spark, table, tables.REQUESTS)
    assert read().count() == 90 and len(read().inputFiles()) <= 6
    tables.drop_expired(spark, table, tables.REQUESTS, datetime(2024, 4, 1, 12))
    assert sorted({row.dt.day for row in read().collect()}) == [2, 3]
    before = read().count()
    tables.append_missing(fact_rows(spark, datetime(2024, 3, 9, 1)), table, tables.REQUESTS)
    tables.append_missing(fact_rows(spark, datetime(2024, 3, 9, 1)), table, tables.REQUESTS)
    assert read().count() == before + 1


def test_backend_days_are_kept(spark, tmp_path):
    table = str(tmp_path / "days")
    day = TS.date()
    for step, success in (("a", 2), ("b", 3), ("b", 4)):
        more = spark.createDataFrame([(day, "b", success, 1)], tables.BACKEND_DAYS)
        tables.merge_version(
            spark, table, tables.BACKEND_DAYS, step,
            lambda counts, more=more: tables.merge_sums(counts, more, ["dt", "backend"], ["success", "failed"]),
        )
    assert [tuple(r) for r in tables.read_version(spark, table, tables.BACKEND_DAYS).collect()] == [(day, "b", 6, 2)]


def day_table(spark, path):
    rows = [
        (day * 100 + hour, datetime(2024, 3, day, hour, 30), "b", 200, "", None, None, datetime(2024, 3, day).date())
        for day in range(1, 6)
        for hour in range(0, 24, 3)
    ]
    tables.append_by_day(spark.createDataFrame(rows, tables.REQUESTS), path)
    return rows


def test_reads_planned_before_a_cut_off_still_succeed(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = day_table(spark, path)
    ids_from = lambda bound: {row[0] for row in rows if row[1] >= bound}
    ids = lambda table: {row.id for row in table.collect()}
    read = lambda: tables.read_kept(spark, path, tables.REQUESTS)
    bounds = [datetime(2024, 3, 2, 9, 30), datetime(2024, 3, 4, 12), datetime(2024, 3, 5, 20)]
    planned, expected = [read()], [ids_from(datetime(2024, 3, 1))]
    for bound in bounds:
        tables.move_cut_off(spark, path, tables.REQUESTS, bound + timedelta(days=30))
        # The read planned before this step, and one after it.
        assert ids(planned[-1]) == expected[-1]
        assert ids(read()) == ids_from(bound)
        planned.append(read())
        expected.append(ids_from(bound))
    # Days before the cut-off of the step before are gone, and one cut-off is left.
    days = [name for _, name in tables.list_folders(spark, path) if name.startswith("dt=")]
    assert days == ["dt=2024-03-04", "dt=2024-03-05"]
    assert len(tables.list_folders(spark, f"{path}/_kept")) == 1


def test_a_cut_off_never_goes_back_and_hides_late_rows(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = day_table(spark, path)
    bound = datetime(2024, 3, 4, 12)
    for as_of in (bound, bound, bound - timedelta(days=2)):
        tables.move_cut_off(spark, path, tables.REQUESTS, as_of + timedelta(days=30))
    late = [(9001, datetime(2024, 3, 4, 11), "b", 200, "", None, None, bound.date()), (9002, bound, "b", 200, "", None, None, bound.date())]
    tables.append_missing(spark.createDataFrame(late, tables.REQUESTS), path, tables.REQUESTS)
    got = {row.id for row in tables.read_kept(spark, path, tables.REQUESTS).collect()}
    assert got == {row[0] for row in rows if row[1] >= bound} | {9002}


def test_a_cut_off_that_was_stopped_does_not_count(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = day_table(spark, path)
    (tmp_path / "requests" / "_kept" / "from-20240304T120000").mkdir(parents=True)
    assert tables.read_kept(spark, path, tables.REQUESTS).count() == len(rows)
    tables.move_cut_off(spark, path, tables.REQUESTS, datetime(2024, 3, 4, 12) + timedelta(days=30))
    assert tables.read_kept(spark, path, tables.REQUESTS).count() == len([r for r in rows if r[1] >= datetime(2024, 3, 4, 12)])
