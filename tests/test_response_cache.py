"""Response lifetimes against a loop over the requests in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from swellframe.operators import response_cache
from swellframe.operators.response_cache import ttl_labels, upstream_calls
from swellframe.plans import catalog
from swellframe.streaming.landing import load_stream
from swellframe.streaming.response_cache import LABELS, label_arrivals

START = datetime(2024, 3, 5, 9, 59, 30)
SCHEMA = "id BIGINT, ts TIMESTAMP_NTZ, cache_key STRING, success BOOLEAN"


def brute_force(rows, lifetime):
    labels, written = {}, {}
    for id_, ts, key, success in sorted(rows, key=lambda row: (row[1], row[0])):
        hit = key in written and ts < written[key] + lifetime
        labels[id_] = "HIT" if hit else "MISS"
        if not hit and success:
            written[key] = ts
    return labels


def random_rows(seed, count, keys, span_seconds, success_share, micros=True):
    pick = random.Random(seed)
    rows = []
    for id_ in range(count):
        offset = pick.uniform(0, span_seconds)
        ts = START + timedelta(seconds=offset if micros else int(offset))
        rows.append((id_, ts, f"k{pick.randrange(keys)}", pick.random() < success_share))
    pick.shuffle(rows)
    return rows


def labels_of(df):
    return {row.id: row.cache for row in df.collect()}


CASES = {
    "sparse": (random_rows(1, 300, 20, 200_000, 0.7), 3600),
    "dense": (random_rows(2, 600, 2, 40_000, 0.8), 3600),
    "one hot key": (random_rows(3, 900, 1, 90_000, 0.5), 3600),
    "equal times": (random_rows(4, 500, 2, 600, 0.4, micros=False), 60),
    "few successes": (random_rows(5, 400, 2, 50_000, 0.05), 3600),
    "exact multiples": (
        [(i, START + timedelta(seconds=30 * i), "k", i % 7 != 3) for i in range(300)], 60,
    ),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("folded_run", [8192, 20, 0])
def test_labels_equal_the_loop(spark, name, folded_run):
    rows, seconds = CASES[name]
    got = ttl_labels(spark.createDataFrame(rows, SCHEMA), seconds, folded_run)
    assert labels_of(got) == brute_force(rows, timedelta(seconds=seconds))


@pytest.mark.parametrize("bits", [1, 3])
def test_small_blocks_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(response_cache, "BLOCK_BITS", bits)
    for name in ("one hot key", "few successes"):
        rows, seconds = CASES[name]
        got = ttl_labels(spark.createDataFrame(rows, SCHEMA), seconds, folded_run=0)
        assert labels_of(got) == brute_force(rows, timedelta(seconds=seconds))


def test_next_success_over_a_year_of_one_key(spark, monkeypatch):
    """Slots over more than a year, most of them without a success, against a loop."""
    pick = random.Random(11)
    monkeypatch.setattr(response_cache, "BLOCK_BITS", 8)
    slots = {pick.randrange(-20_000_000, 20_000_000): pick.random() < 0.02 for _ in range(3000)}
    rows = [("k", 5, slot, slot * 10 + 3 if found else None) for slot, found in slots.items()]
    table = spark.createDataFrame(rows, "cache_key STRING, run BIGINT, slot BIGINT, first_found BIGINT")
    got = {row.slot: row.later for row in response_cache._first_in_later_slots(table).collect()}
    found = sorted(slot for slot, has in slots.items() if has)
    later = lambda slot: next((f * 10 + 3 for f in found if f > slot), None)
    assert got == {slot: later(slot) for slot in slots}


def test_no_window_holds_a_run_of_slots(spark):
    """Windows over rows are by slot or by block; only blocks of the highest level are by run."""
    rows = spark.createDataFrame([], "cache_key STRING, run BIGINT, slot BIGINT, first_found BIGINT")
    plan = response_cache._first_in_later_slots(rows)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    by_block = [line for line in windows if "block#" in line.rsplit("], [", 2)[1]]
    assert len(windows) == response_cache.BLOCK_LEVELS + 1
    assert len(by_block) == response_cache.BLOCK_LEVELS


def test_gap_of_exactly_one_lifetime_misses(spark):
    rows = [(i, START + timedelta(seconds=s), "k", True) for i, s in enumerate((0, 3599, 3600, 7199, 7200))]
    expected = {0: "MISS", 1: "HIT", 2: "MISS", 3: "HIT", 4: "MISS"}
    for folded_run in (8192, 0):
        assert labels_of(ttl_labels(spark.createDataFrame(rows, SCHEMA), folded_run=folded_run)) == expected


def test_failures_store_nothing(spark):
    rows = [(i, START + timedelta(seconds=i), "k", i == 2) for i in range(4)]
    labelled = ttl_labels(spark.createDataFrame(rows, SCHEMA))
    assert labels_of(labelled) == {0: "MISS", 1: "MISS", 2: "MISS", 3: "HIT"}
    assert tuple(upstream_calls(labelled).first()) == ("k", 4, 1, 3)


def test_no_requests_and_no_successes(spark):
    assert ttl_labels(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, START, "k", False) for i in range(3)]
    assert set(labels_of(ttl_labels(spark.createDataFrame(rows, SCHEMA))).values()) == {"MISS"}


def arrivals(spark, folder, parts):
    """Labels after requests have arrived in parts, each of several files and micro-batches."""
    source, table = str(folder / "in"), str(folder / "labels")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        load_stream(
            stream, str(folder / "landing"), str(folder / "state"),
            lambda landed, step: label_arrivals(landed, table),
        )
    return spark.read.schema(LABELS).parquet(table)


def test_ordered_arrivals_equal_the_loop(spark, tmp_path):
    rows = sorted(random_rows(6, 500, 5, 60_000, 0.6), key=lambda row: (row[1], row[0]))
    # The third key holds most of the requests.
    rows = [(i, ts, "k2" if i % 3 else key, ok) for i, ts, key, ok in rows]
    got = arrivals(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]])
    assert got.count() == len(rows)
    assert labels_of(got) == brute_force(rows, timedelta(hours=1))


def test_late_requests_are_labelled(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [(1, at(0), "k", True), (2, at(30), "k", True), (3, at(6000), "k", True)]
    late = [
        (4, at(20), "k", True), (5, at(-600), "k", True), (6, at(-590), "k", False),
        (7, at(6010), "k", False), (8, at(9000), "k", False), (9, at(50), "other", True),
    ]
    got = arrivals(spark, tmp_path, [first, late])
    assert labels_of(got) == {
        1: "MISS", 2: "HIT", 3: "MISS", 4: "HIT", 5: "MISS", 6: "HIT", 7: "HIT", 8: "MISS", 9: "MISS",
    }


def test_a_repeated_step_adds_nothing(spark, tmp_path):
    rows = random_rows(8, 60, 3, 9_000, 0.7)
    table = str(tmp_path / "labels")
    df = spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):
        label_arrivals(df, table)
    assert labels_of(spark.read.schema(LABELS).parquet(table)) == brute_force(rows, timedelta(hours=1))
    assert spark.read.schema(LABELS).parquet(table).count() == 60


def test_given_table_counts(spark):
    """Counts of the smallest given table, with every run solved by joins as well."""
    requests = catalog.stored_cache_requests(spark, "/root/testdata/sf0.001")
    assert labels_of(ttl_labels(requests)) == labels_of(ttl_labels(requests, folded_run=0))


def test_working_tables_can_be_deleted(spark):
    from swellframe.sources import tables
    from swellframe.sources.workspace import delete_working_tables, shared_folder

    delete_working_tables(spark)
    rows = random_rows(9, 200, 1, 30_000, 0.6)
    labels_of(ttl_labels(spark.createDataFrame(rows, SCHEMA), folded_run=0))
    folder = f"{shared_folder(spark)}/swellframe"
    assert len(tables.list_folders(spark, folder)) > 1
    delete_working_tables(spark)
    assert tables.list_folders(spark, folder) == []


def test_folder_without_a_setting(spark):
    from types import SimpleNamespace

    from swellframe.sources.workspace import shared_folder

    assert shared_folder(spark, "/given/") == "/given"
    settings = {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default)))
    assert shared_folder(unset) == "file:/shared/warehouse/_work"
