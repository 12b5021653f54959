import math

import pyarrow.parquet as pq
import pytest
from brute_time import instant
from pyspark.sql import functions as F

from geotrail.operators.instants import with_instants, zone_spans
from geotrail.plans.problems import TRUE_SPAN, p1_found

CASES = [
    # text, row offset, home zone
    ("2024-03-20T23:01:34.123456789+09:00", None, None),
    ("2024-03-20T23:01:34.1Z", 60.0, None),
    (" 2024-03-20T23:01:34+0530 ", None, None),
    ("2024-03-20T23:01:34-07", None, None),
    ("20241025T191821Z", None, None),
    ("29.10.2022 05:49:38", 120.0, "Europe/Berlin"),
    ("29.05.2023 01:46", None, "Asia/Tokyo"),
    ("2024/01/02 03:04:05", math.nan, "Asia/Kathmandu"),
    ("Sat, 27 May 2023 03:02:44 +1000", None, None),
    ("May 19, 2023, 12:41:29 PM UTC+9", None, None),
    ("Feb 16, 2025, 12:01:16 AM UTC-3:30", None, None),
    ("Mar 18, 2022, 5:24:19 PM UTC", None, None),
    ("2024-07-04 03:45:16 JST", None, "Europe/Berlin"),
    ("2023-10-29 02:30:00 Europe/Berlin", None, None),  # twice
    ("2023-10-29 02:30:00 CET", None, None),
    ("2023-10-29 02:30:00 CEST", None, None),
    ("2023-10-29T02:30:00+01:00[Europe/Berlin]", None, None),
    ("2023-03-26 02:30:00", None, "Europe/Berlin"),  # never
    ("2023-03-26 02:30:00", 60.0, "Europe/Berlin"),
    ("2023-03-26 01:59:59.999", None, "Europe/Berlin"),
    ("2023-03-26 03:00:00", None, "Europe/Berlin"),
    ("2023-10-29 03:00:00", None, "Europe/Berlin"),
    ("2024-04-07 02:30:00 Australia/Adelaide", None, None),
    ("2024-10-06 02:15:00 Australia/Adelaide", None, None),
    ("1689213702", None, None),
    (" 1689213702123 ", None, None),
    ("1689213702123456", None, None),
    ("123", None, "UTC"),
    ("9999999999", None, "UTC"),
    ("2024-02-30T10:00:00Z", None, None),
    ("2023-02-29 10:00:00", 0.0, None),
    ("2024-02-29 10:00:00", 0.0, None),
    ("2024-13-05T08:00:00.000+09:00", None, None),
    ("2025-04-11T25:61:00.000+09:00", None, None),
    ("2025-04-11T24:00:00+09:00", None, None),
    ("0000-00-00T00:00:00.000+09:00", None, None),
    ("May 19, 2023, 13:41:29 PM UTC+9", None, None),
    ("", None, "UTC"),
    ("   ", None, "UTC"),
    ("Invalid Date", None, "UTC"),
    ("NaN", 0.0, "UTC"),
    ("2024-01-01 00:00:00 Mars/Base", 0.0, "UTC"),
    ("2024-01-01 00:00:00 XYZ", 0.0, "UTC"),
    ("2024-01-01 00:00:00", None, None),
    (None, 0.0, "UTC"),
]


def test_cases_against_the_standard_library(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, o double, z string")
    got = {r["i"]: r["ms"] for r in with_instants(df, {"ms": "t"}, "o", "z", epoch_span=TRUE_SPAN).collect()}
    for i, (text, off, home) in enumerate(CASES):
        bad = text is not None and any(x in text for x in ("Mars", "XYZ", "13:41:29 PM"))
        assert got[i] == (None if bad else instant(text, off, home)), (text, off, home)


def test_whole_table_against_the_standard_library(spark, data):
    homes = {r["device_id"]: r["home_zone"] for r in pq.read_table(f"{data}/devices.parquet").to_pylist()}
    want = set()
    for r in pq.read_table(f"{data}/timeline.parquet").to_pylist():
        v = instant(r["start_time"], r["start_time_timezone_utc_offset_minutes"], homes.get(r["device_id"]))
        if v is not None:
            want.add(("segment", r["segment_id"], v))
    for r in pq.read_table(f"{data}/photo_sidecars.parquet").to_pylist():
        v = instant((r["photo_taken_time"] or {}).get("timestamp_text"), None, homes.get(r["device_id"]))
        if v is not None:
            want.add(("photo", r["photo_id"], v))
    assert {tuple(r) for r in p1_found(spark, data).collect()} == want


def test_clashing_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1, 2, 3, 4)] * 2, "t string, zone int, bucket int, __ms int, __wall int")
    out = with_instants(df, {"ms": "t", "again": F.col("t")}, None, F.lit("Asia/Tokyo"))
    assert out.columns == ["t", "zone", "bucket", "__ms", "__wall", "ms", "again"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 2, 3, 4, 1704034800000, 1704034800000)] * 2
    assert with_instants(df.limit(0), {"t": "t"}, None, None).count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Australia/Lord_Howe", "Asia/Kathmandu", "America/New_York"])
def test_spans_follow_each_other(zone):
    spans = zone_spans(zone, 2018, 2030)
    for (_, until, a), (start, _, b) in zip(spans, spans[1:]):
        assert start - until == b - a and a != b


def test_long_text(spark):
    df = spark.createDataFrame([("2024" * 100_000,), ("1" * 100_000,)], "t string")
    assert [r["ms"] for r in with_instants(df, {"ms": "t"}).collect()] == [None, None]


def test_years_near_and_far_against_the_standard_library(spark):
    rows = []
    for zone in ("Europe/Berlin", "America/New_York", "Asia/Tokyo", "Australia/Lord_Howe", "Africa/Monrovia", "Africa/Casablanca"):
        for year in (1970, 1971, 1972, 1975, 1983, 1999, 2012, 2017, 2031, 2035, 2044, 2060):
            rows += [(len(rows) + k, f"{year}-{m:02d}-{d:02d} {h}:30:00", zone) for k, (m, d, h) in enumerate(((1, 1, "12"), (3, 28, "02"), (7, 1, "12"), (10, 30, "02"), (12, 31, "23")))]
    df = spark.createDataFrame(rows, "i int, t string, z string")
    got = {r["i"]: r["ms"] for r in with_instants(df, {"ms": "t"}, None, "z").collect()}
    assert got == {i: instant(t, None, z) for i, t, z in rows}


def test_bare_numbers_of_any_year_within_the_span(spark):
    df = spark.createDataFrame([(t,) for t in ("1341136800", "1341136800123", "1341136800123456", "631152000", "2840140800", "86400", "99999999999999999999")], "t string")
    assert [r["ms"] for r in with_instants(df, {"ms": "t"}).collect()] == [1341136800000, 1341136800123, 1341136800123, 631152000000, 2840140800000, None, None]


def test_abbreviations_of_several_meanings(spark):
    rows = [("2024-06-01 12:00:00 CST", "Asia/Shanghai", None, 480), ("2024-06-01 12:00:00 CST", "America/Chicago", None, -360), ("2024-06-01 12:00:00 CST", "Europe/Berlin", None, None)]
    rows += [("2024-06-01 12:00:00 CST", None, None, None), ("2024-06-01 12:00:00 IST", "Asia/Kolkata", None, 330), ("2024-06-01 12:00:00 IST", "Europe/Dublin", 330.0, 60)]
    rows += [("2024-06-01 12:00:00 IST", "Asia/Tokyo", 120.0, 120), ("2024-06-01 12:00:00 IST", "Asia/Tokyo", 540.0, None), ("2024-06-01 12:00:00 BST", "Europe/London", 0.0, 60), ("2024-06-01 12:00:00 (PST)", "Asia/Manila", None, 480)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, z string, o double")
    got = {r["i"]: r["ms"] for r in with_instants(df, {"ms": "t"}, "o", "z").collect()}
    assert got == {i: None if r[3] is None else 1717243200000 - r[3] * 60_000 for i, r in enumerate(rows)}
