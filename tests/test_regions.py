"""The cascade from municipalities to prefectures."""

from geotrail.operators.filters import exclude_zones
from geotrail.operators.places import nearest_places, pairs_within
from geotrail.operators.regions import first_outline, locate


def test_prefecture_is_the_last_resort(spark):
    def square(x, y, size):
        return [[[[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]]]

    shape = "geometry array<array<array<array<double>>>>"
    munis = spark.createDataFrame([("01001", 1, 0, square(139.0, 35.0, 0.1))], f"code string, pref_code int, feature_idx int, {shape}")
    # The second prefecture also holds the municipality, and overlaps the third.
    prefs = spark.createDataFrame([(2, 0, square(138.9, 34.9, 0.5)), (3, 1, square(139.2, 35.2, 0.5))], f"code int, feature_idx int, {shape}")
    rows = [(1, 35.05, 139.05), (2, 35.11, 139.05), (3, 35.3, 139.3), (4, 35.6, 139.6), (5, 36.5, 139.0), (6, None, 139.0)]
    points = spark.createDataFrame(rows, "i int, lat double, lng double")
    got = {r["i"]: (r["code"], r["pref_code"], r["how"]) for r in locate(points, munis, prefectures=prefs).collect()}
    assert got == {1: ("01001", 1, "inside"), 2: ("01001", 1, "nearest"), 3: (None, 2, "prefecture"), 4: (None, 3, "prefecture"), 5: (None, 0, "none"), 6: (None, 0, "none")}
    without = {r["i"]: (r["pref_code"], r["how"]) for r in locate(points, munis).collect()}
    assert without[3] == without[4] == (0, "none")


def test_borders_holes_and_shapes_that_are_no_squares(spark):
    shape = "geometry array<array<array<array<double>>>>"
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    munis = [
        ("a", 1, 0, [[box(10.0, 50.0, 1.0)]]),
        ("b", 1, 1, [[box(11.0, 50.0, 1.0)]]),
        ("ring", 2, 2, [[box(20.0, 50.0, 2.0), box(20.5, 50.5, 1.0)]]),
        ("tri", 3, 3, [[[[30.0, 50.0], [31.0, 50.0], [30.0, 51.0], [30.0, 50.0]]], [[[33.0, 50.0], [34.0, 50.0], [33.0, 51.0], [33.0, 50.0]]]]),
        ("flat", 3, 4, [[[[40.0, 50.0], [41.0, 50.0]]]]),
        ("gone", 3, 5, None),
    ]
    regions = spark.createDataFrame(munis, f"code string, pref_code int, feature_idx int, {shape}")
    points = [(1, 50.5, 11.0, "a"), (2, 51.0, 10.5, "a"), (3, 50.0, 12.0, "b"), (4, 50.6, 20.6, "-"), (5, 50.5, 20.7, "ring"), (6, 50.2, 20.2, "ring"), (7, 50.5, 30.5, "tri"), (8, 50.49, 33.49, "tri"), (9, 50.6, 30.6, "-"), (10, 50.5, 12.01, "b"), (11, 50.5, 12.5, "-")]
    df = spark.createDataFrame([p[:3] for p in points], "i int, lat double, lng double")
    got = {r["i"]: (r["code"], r["how"]) for r in locate(df, regions).collect()}
    assert {i: c or "-" for i, (c, _) in got.items()} == {i: c for i, _, _, c in points}
    assert {i for i, (_, how) in got.items() if how == "nearest"} == {10} and got[1][1] == got[2][1] == got[5][1] == "inside"
    outline = {r["i"]: r["code"] for r in first_outline(df, regions).collect()}
    assert outline[4] == "ring" and outline[8] == "tri" and outline[1] == "a" and outline[11] is None
    assert locate(df.limit(0), regions).count() == 0 and {r["how"] for r in locate(df, regions.limit(0)).collect()} == {"none"}


def test_circles_across_the_meridian_and_the_pole(spark):
    df = spark.createDataFrame([(1, 0.0, -179.9999), (2, 0.0, 179.9), (3, 89.9999, -100.0), (4, 89.9, 10.0), (5, 0.0, 180.0), (6, 0.0, -180.0), (7, None, 180.0)], "i int, lat double, lng double")
    zones = spark.createDataFrame([(0.0, 179.9999, 50.0), (89.9999, 80.0, 40.0)], "zone_lat double, zone_lng double, radius_m double")
    assert sorted(r["i"] for r in exclude_zones(df, zones).collect()) == [2, 4, 7]
    right = spark.createDataFrame([(9, 0.0, 179.9999)], "j int, u double, v double")
    for radius in (15.0, 50.0, 20_000.0):
        got = {r["i"] for r in pairs_within(df, right, radius, ("lat", "lng"), ("u", "v")).collect()}
        assert got == ({5, 6} if radius == 15.0 else {1, 5, 6} if radius == 50.0 else {1, 2, 5, 6})


def test_nearest_places_however_far(spark, monkeypatch):
    import random

    from brute_geo import metres

    from geotrail.operators import places

    g = random.Random(6)
    rows = [(1, i, 35 + g.random() * 0.01, 139 + g.random() * 0.01) for i in range(60)] + [(1, 100 + i, g.uniform(-60, 60), g.uniform(-180, 180)) for i in range(15)]
    rows += [(2, 200, 1.0, 1.0), (2, 201, -60.0, -179.0), (3, 300, 5.0, 5.0), (4, 400, 1.0, 1.0), (4, 401, 1.0, 1.0), (4, 402, 1.0, 1.0), (5, 500, None, 1.0)]
    df = spark.createDataFrame(rows, "subject_id bigint, cluster_id bigint, lat double, lng double")
    want = []
    for s, i, *p in rows:
        near = sorted((round(metres(p, q), 3), j) for t, j, *q in rows if t == s and j != i and None not in q and None not in p)[:5]
        want += [(s, i, k, j) for k, (_, j) in enumerate(near, 1)]
    for most in (2000, 20, 1):
        monkeypatch.setattr(places, "FEW_PLACES", most)
        assert sorted((r["subject_id"], r["cluster_id"], r["rank"], r["near_id"]) for r in nearest_places(df).collect()) == sorted(want)
