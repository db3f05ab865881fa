"""Decoding of upstream bodies and their dense points."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from swellframe.functions.times import ZERO_TIME_EPOCH
from swellframe.operators import payloads

TEN = 1709632800  # 2024-03-05T10:00:00Z


def bodies(spark, *texts, params="windSpeed"):
    rows = [(i, params, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id INT, params STRING, body STRING")


TIDE_BODIES = [
    ('{"data":[{"height":1.5,"time":"x","type":"high"}]}', True),
    ("{}", True),
    ('{"data":null}', True),
    ('{"data":[null]}', True),
    ("null", True),
    (' {"other":{"time":[1]},"data":[]} ', True),
    ('{"data":[{"height":null,"time":null}]}', True),
    ('{"data":[{"height":"1.5"}]}', False),
    ('{"data":[{"height":true}]}', False),
    ('{"data":[{"height":1e999}]}', False),
    ('{"data":[{"height":NaN}]}', False),
    ('{"data":[{"time":5}]}', False),
    ('{"data":[{"type":{"a":1}}]}', False),
    ('{"data":{}}', False),
    ('{"data":[1]}', False),
    ("[]", False),
    ("5", False),
    ("", False),
    ("  ", False),
    ('{"data":[', False),
    ('{"data":[]} tail', False),
    ('{"data":[]},{"data":[]}', False),
    ("{'data':[]}", False),
    (None, False),
]


def test_whole_body_is_rejected_for_one_wrong_value(spark):
    rows = bodies(spark, *[text for text, _ in TIDE_BODIES])
    decoded = payloads.decode(rows, "tide_extremes").orderBy("id").collect()
    assert [row.decoded for row in decoded] == [good for _, good in TIDE_BODIES]
    corrupt = payloads.corrupt_rows(rows, "tide_extremes", ["id"]).collect()
    assert sorted(row.id for row in corrupt) == [i for i, (_, good) in enumerate(TIDE_BODIES) if not good]
    assert {(r.status_code, r.error_type, r.upstream_response) for r in corrupt} == {(500, "Parse Error", "")}
    mixed = rows.withColumn("kind", F.lit("tide_extremes"))
    flags = mixed.select("id", payloads.decodable("body", "kind").alias("ok")).orderBy("id").collect()
    assert [row.ok for row in flags] == [good for _, good in TIDE_BODIES]


def test_dense_weather(spark):
    body = json.dumps(
        {"hours": [
            {"time": "2024-03-05T10:00:00+00:00", "swellHeight": {"noaa": 2.35},
             "swellDirection": {"noaa": 271.6}, "windSpeed": {"noaa": 3}},
            {"time": "never", "swellHeight": None},
        ]}
    )
    rows = payloads.dense_rows(bodies(spark, body, params="swellHeight, swellPeriod,x"), "weather", ["id"])
    got = [(r.pos, r.ts, r.h1, r.p1, r.d1, r.ws) for r in rows.orderBy("pos").collect()]
    assert got == [(0, TEN, 2.35, 0.0, None, None), (1, ZERO_TIME_EPOCH, 0.0, 0.0, None, None)]


def test_packed_documents(spark):
    rows = bodies(
        spark,
        '{"data":[{"height":0.83,"time":"2024-03-05T10:00:00Z","type":""},'
        '{"height":1.7,"time":"2024-03-05T16:00:00Z","type":"high"}]}',
        "{}",
        "[",
    )
    packed = payloads.pack_dense(rows, "tide_extremes", ["id"]).orderBy("id").collect()
    assert [(r.id, json.loads(r.document)) for r in packed] == [
        (0, {"data": [{"ts": TEN, "h": 0.83}, {"ts": TEN + 21600, "h": 1.7, "t": "high"}]}),
        (1, {"data": []}),
    ]


def test_sea_level_and_extremes(spark):
    sea = payloads.dense_rows(
        bodies(spark, '{"data":[{"sg":0.5,"time":"2024-03-05T10:00:00.9Z"},{}]}'), "sea_level", ["id"]
    )
    assert [tuple(r) for r in sea.orderBy("pos").collect()] == [
        (0, 0, TEN, 0.5, None), (0, 1, ZERO_TIME_EPOCH, 0.0, None),
    ]
    extremes = payloads.dense_rows(
        bodies(spark, '{"extremes":[{"level":1,"high":true},{"level":2,"high":false},{"level":3}]}'),
        "ow_extremes", ["id"],
    )
    assert [(r.h, r.t) for r in extremes.orderBy("pos").collect()] == [(1, "high"), (2, "low"), (3, "low")]


def brute_timeline(times_and_levels):
    """The kept points of a timeline, one after the other."""
    kept, last = [], ZERO_TIME_EPOCH
    for text, level, seconds in times_and_levels:
        if seconds == ZERO_TIME_EPOCH or text[14:19] == "00:00":
            hour = seconds - seconds % 3600
            if hour != last:
                kept.append((seconds, level))
                last = hour
    return kept


@pytest.mark.parametrize(
    "points",
    [
        [("2024-03-05T10:00:00Z", TEN), ("2024-03-05T10:00:00.5Z", TEN), ("2024-03-05T10:30:00Z", TEN + 1800)],
        [("bad", ZERO_TIME_EPOCH), ("2024-03-05T10:00:00Z", TEN), ("bad", ZERO_TIME_EPOCH),
         ("2024-03-05T10:00:00Z", TEN), ("2024-03-05T11:00:00Z", TEN + 3600), ("2024-03-05T10:00:00Z", TEN)],
        [("2024-03-05T15:30:00+05:30", TEN), ("2024-03-05T15:00:00+05:30", TEN - 1800),
         ("2024-03-05T09:00:00Z", TEN - 3600), ("2024-03-05T16:00:00+05:30", TEN + 1800)],
    ],
)
def test_timeline_keeps_one_point_an_hour(spark, points):
    body = json.dumps({"timeline": [{"time": t, "level": i} for i, (t, _) in enumerate(points)]})
    rows = payloads.dense_rows(bodies(spark, body), "ow_timeline", ["id"]).orderBy("pos").collect()
    expected = brute_timeline([(t, float(i), s) for i, (t, s) in enumerate(points)])
    assert [(r.ts, r.h) for r in rows] == expected


def test_geocode_fields(spark):
    rows = bodies(
        spark,
        '{"locality":"Old Quay","city":"","countryName":"Northland","countryCode":"NL","x":1}',
        '{"city":5}',
    )
    got = [tuple(r) for r in payloads.geocode_rows(rows, ["id"]).collect()]
    assert got == [(0, "Old Quay", None, "Northland", "NL")]
    assert payloads.corrupt_rows(rows, "geocode", ["id"]).first().upstream_response == '{"city":5}'


def test_a_body_is_parsed_once(spark):
    rows = payloads.dense_rows(bodies(spark, "{}"), "weather", ["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and "Exchange" not in plan
    assert "json_object_keys" not in plan


BROKEN_OUT = [
    '{}],"x":[1',
    '{"data":[]}],"z":[0',
    '{}],"d":[{}',
    "{},{}",
    "{}]}x",
    "{}]} ",
    '{},{"_mark":""}]}',
    '{}],"d":[{"_mark":"1"},{}',
    '{"_mark":"1"}],"d":[{"_mark":"1"},{},{"_mark":"1"}]}',
]


def test_a_body_may_have_a_key_like_the_mark(spark):
    rows = [(i, body, "sea_level") for i, body in enumerate(['{"_mark":{"a":[1]},"data":[]}', " null\n", "\t{}"])]
    rows = spark.createDataFrame(rows, "id INT, body STRING, kind STRING")
    assert payloads.corrupt_payloads(rows, ["id"]).count() == 0
    assert payloads.points(rows, "sea_level").count() == 3


@pytest.mark.parametrize("body", BROKEN_OUT)
def test_text_after_the_document(spark, body):
    rows = spark.createDataFrame([(1, body, "tide_extremes")], "id INT, body STRING, kind STRING")
    assert payloads.corrupt_payloads(rows, ["id"]).count() == 1
    assert payloads.corrupt_rows(rows, "tide_extremes", ["id"]).count() == 1


@pytest.mark.parametrize(
    ("value", "text"),
    [(100.0, "100"), (0.0, "0"), (-2.5, "-2.5"), (1e-5, "0.00001"), (12345678.5, "12345678.5"), (1e-7, "1e-7"),
     (1.5e-9, "1.5e-9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (-1.25e300, "-1.25e+300"),
     (123456789012345678.0, "123456789012345680"), (0.1, "0.1"), (1.2345678901234567e-6, "0.0000012345678901234567")],
)
def test_json_number(spark, value, text):
    from swellframe.functions.numbers import json_number

    df = spark.createDataFrame([(value,)], "x DOUBLE")
    assert df.select(json_number(df["x"])).first()[0] == text


def test_packed_weather_leaves_out_what_was_not_asked(spark):
    hours = ",".join(
        f'{{"time":"2024-03-05T{h:02d}:00:00Z","swellHeight":{{"noaa":{h}.0}},"windSpeed":{{"noaa":1.25}}}}' for h in range(24)
    )
    rows = spark.createDataFrame([(1, f'{{"hours":[{",".join([hours] * 7)}]}}', "swellHeight,swellPeriod")], "id INT, body STRING, params STRING")
    document = payloads.pack_dense(rows, "weather", ["id"]).first().document
    assert document.count('"ts"') == 168 and '"h1":23,"p1":0}' in document and "ws" not in document
