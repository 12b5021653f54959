"""The behaviour that a history of a few days must show, from an export file to rankings."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geotrail.engine import History
from geotrail.operators import aggregates as A
from geotrail.operators import days as D
from geotrail.operators import filters as L
from geotrail.operators import routes as U
from geotrail.operators.stays import connected_components, stay_points
from geotrail.sources import timeline

# Three places of our own: a quay, a stall 130 m north of it, and a hut beyond the strait.
QUAY, STALL, HUT = "43.5081300°, 16.4401900°", "43.5093000°, 16.4401900°", "42.9602500°, 17.1361700°"


def segment(day, start, end, **what):
    return {"startTime": f"2023-{day}T{start}:00.000+01:00", "endTime": f"2023-{day}T{end}:00.000+01:00", "startTimeTimezoneUtcOffsetMinutes": 60, **what}


def visit(day, hour, place, pid=None, minutes=40):
    return segment(day, f"{hour:02d}:00", f"{hour:02d}:{minutes:02d}", visit={"probability": 0.7, "topCandidate": {"placeId": pid or "", "semanticType": "UNKNOWN", "placeLocation": {"latLng": place}}})


def move(day, t0, t1, km, kind, a=QUAY, b=HUT):
    return segment(day, t0, t1, activity={"start": {"latLng": a}, "end": {"latLng": b}, "distanceMeters": km * 1000.0, "topCandidate": {"type": kind}})


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    segments = [visit(f"03-{d:02d}", 9, QUAY, "quay") for d in range(2, 9)] + [visit(f"05-{d:02d}", 17, STALL) for d in (4, 5, 6)] + [visit(f"03-{d}", 19, HUT, "hut") for d in (11, 12, 13, 14)]
    segments.append(move("03-11", "13:20", "17:05", 96, "IN_FERRY"))
    path = [("43.50°, 16.44°", "13:20"), ("43.20°, 16.80°", "14:40"), ("42.96°, 17.13°", "17:05"), ("off the chart", "17:10")]
    segments.append({"startTime": "2023-03-11T13:20:00+01:00", "endTime": "2023-03-11T17:00:00+01:00", "startTimeTimezoneUtcOffsetMinutes": 60, "timelinePath": [{"point": p, "time": f"2023-03-11T{t}:00.000+01:00"} for p, t in path]})
    segments.append({"startTime": "2023-03-11T13:20:00+01:00", "timelineMemory": {}})
    segments.append(visit("03-05", 4, "at sea"))
    doc = {"semanticSegments": segments, "userLocationProfile": {"frequentPlaces": [{"placeId": "quay", "placeLocation": QUAY, "label": "WORK"}, {"placeId": "none", "placeLocation": "?", "label": "HOME"}]}, "rawSignals": []}
    folder = tmp_path_factory.mktemp("export")
    (folder / "timeline.json").write_text(json.dumps(doc))
    return timeline.normalize(timeline.read_documents(spark, str(folder)))


def history(tables):
    stays = stay_points(tables.visits).withColumn("muni_code", F.lit("m")).withColumn("pref_code", F.lit(1))
    return History(stays, tables.activities, tables.path_points, tables.frequent_places)


def test_tables(sample):
    assert (sample.visits.count(), sample.activities.count(), sample.path_points.count(), sample.frequent_places.count()) == (14, 1, 3, 1)
    r = sample.activities.first()
    assert (r["mode"], r["distance_m"], r["date_str"], r["hour"], r["dow"]) == ("IN_FERRY", 96000.0, "2023-03-11", 13, 6)
    assert sample.visits.where("place_id = ''").count() == 0


def test_stay_points_at_two_thresholds(sample):
    sizes = lambda m: sorted(r["count"] for r in stay_points(sample.visits, m).groupBy("cluster_id").count().collect())
    assert sizes(60.0) == [3, 4, 7] and sizes(150.0) == [4, 10]


def test_zone_hides_a_place_but_no_statistics(spark, sample):
    zones = spark.createDataFrame([(43.50813, 16.44019, 70.0)], "zone_lat double, zone_lng double, radius_m double")
    h = history(sample)
    assert [r["visits"] for r in h.ranking().collect()] == [7, 4, 3]
    assert [r["visits"] for r in h.zones(zones).ranking().collect()] == [4, 3]
    assert h.zones(zones).stats().first()["distance_m"] == 96000.0
    assert h.zones(zones).zones(None).ranking().count() == 3


def test_privacy_and_periods(sample):
    h = history(sample)
    assert h.privacy().stays().count() == 4 and h.privacy().moves().count() == 0
    assert h.period(2023, 5).stays().count() == 3 and h.period(month=3).stays().count() == 11 and h.up_to(2023, 4).stays().count() == 11
    assert h.privacy().ranking().first()["visits"] == 4


def test_routes_of_a_trip(spark, sample):
    moves = sample.activities.withColumn("subject_id", F.lit(1).cast("bigint"))
    points = sample.path_points.withColumn("subject_id", F.lit(1).cast("bigint")).withColumn("point_idx", F.col("pt_idx"))
    modes = U.point_modes(points, moves)
    assert {r["mode"] for r in modes.collect()} == {"IN_FERRY"}
    segments = U.run_segments(U.route_runs(modes))
    # Both pauses are longer than a run bears, so the trip is two runs that share the point between them.
    clock = lambda ms: f"{(ms // 60_000 + 60) // 60 % 24:02d}:{ms // 60_000 % 60:02d}"
    assert sorted((clock(r["start_ms"]), clock(r["end_ms"]), len(r["points"])) for r in segments.collect()) == [("13:20", "14:40", 2), ("14:40", "17:05", 2)]
    assert U.inferred_segments(moves, modes).count() == 0
    zone = spark.createDataFrame([(43.50, 16.44, 1500.0)], "zone_lat double, zone_lng double, radius_m double")
    seen = U.visible_moves(moves, U.trimmed_segments(segments, zone), zone).first()
    assert (clock(seen["start_ms"]), clock(seen["end_ms"]), seen["partial"], seen["start_cut"], seen["end_cut"]) == ("14:40", "17:05", True, True, False)
    both = zone.union(spark.createDataFrame([(42.96, 17.13, 1500.0), (43.2, 16.8, 40.0)], zone.schema))
    assert U.visible_moves(moves, U.trimmed_segments(segments, both), both).count() == 0


def test_days(sample):
    counts = D.day_counts(sample.visits, sample.activities)
    got = {r["date_str"]: (r["prev_day"], r["next_day"]) for r in D.recorded_days(counts).collect()}
    assert got["2023-03-11"] == ("2023-03-08", "2023-03-12")
    assert D.anniversary(counts, "2024-03-13").first()["date_str"] == "2023-03-13" and D.anniversary(counts, "2024-08-20").count() == 0
    grid = {r["date_str"]: r for r in D.calendar_grid(counts, 2023).collect()}
    assert len(grid) == 365 and (grid["2023-01-01"]["grid_col"], grid["2023-01-01"]["grid_row"]) == (1, 1) and grid["2023-03-11"]["level"] == 4


def test_days_of_photos_and_path_points_are_recorded(spark, data):
    from geotrail.functions.calendar import date_text
    from geotrail.plans import adapter
    from geotrail.plans import history as plans

    days = {(r["subject_id"], r["date_str"]) for r in plans.QUERIES["recorded_days"](spark, data).collect()}
    photos = adapter.photos(spark, data).select("subject_id", date_text(F.col("taken_ms")))
    points = adapter.path_points(spark, data).select("subject_id", "date_str")
    rest = [f(spark, data).select("subject_id", "date_str") for f in (adapter.visits, adapter.activities)]
    old = {tuple(r) for r in rest[0].union(rest[1]).collect()}
    assert days == old | {tuple(r) for r in photos.collect()} | {tuple(r) for r in points.collect()} and days > old


def test_empty_history(spark):
    t = timeline.empty(spark)
    assert t.visits.count() == 0
    regions = spark.createDataFrame([(1, "a"), (2, "b")], "code int, name string")
    stays = t.visits.withColumn("pref_code", F.lit(1)).withColumn("cluster_id", F.lit(0).cast("bigint"))
    assert [(r["stay_count"], r["first_ms"]) for r in A.first_level_coverage(stays, t.path_points.withColumn("pref_code", F.lit(1)), regions).collect()] == [(0, None)] * 2


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id"))
    edges = spark.range(198).where("id <> 99").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["id"]: r["label"] for r in connected_components(nodes, edges).collect()}
    assert all(got[i] == (0 if i <= 99 else 100 if i < 199 else 199) for i in range(200))


@pytest.mark.parametrize("order", ["reversed", "shuffled"])
def test_components_of_a_chain_in_any_order_of_ids(spark, order):
    import random

    n = 100 if order == "reversed" else 1000
    ids = [0, *range(n - 1, 0, -1)] if order == "reversed" else random.Random(7).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    got = connected_components(spark.range(n).select("id"), edges).collect()
    assert sorted((r["id"], r["label"]) for r in got) == [(i, 0) for i in range(n)]


def test_components_of_a_shuffled_chain_of_a_hundred_thousand(spark):
    import numpy as np

    ids = np.random.default_rng(3).permutation(100_000)
    cut = 60_000
    edges = spark.createDataFrame([(int(a), int(b)) for k, (a, b) in enumerate(zip(ids, ids[1:])) if k != cut], "a bigint, b bigint")
    want = np.empty(100_000, int)
    want[ids[: cut + 1]], want[ids[cut + 1 :]] = ids[: cut + 1].min(), ids[cut + 1 :].min()
    for task_edges in (2_000_000, 1_000):
        got = connected_components(spark.range(100_000).select("id"), edges, task_edges).toArrow()
        assert (want[got.column(0).to_numpy()] == got.column(1).to_numpy()).all() and got.num_rows == 100_000


def test_components_of_stars_rings_and_lone_nodes_by_rounds(spark):
    import random

    g = random.Random(2)
    edges = [(90, k) for k in range(80, 90)] + [(k, k + 1) for k in range(20)] + [(20, 0), (5, 5), (3, 4), (4, 3)] + [(g.randrange(100, 160), g.randrange(100, 160)) for _ in range(40)]
    parent = list(range(200))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for most in (0, 3, 1000):
        got = {r["id"]: r["label"] for r in connected_components(spark.range(200).select("id"), df, most).collect()}
        assert got == {i: root(i) for i in range(200)}


def test_zones_across_cells_and_null_places(spark):
    df = spark.createDataFrame([(1, 35.0, 139.0), (2, 35.02, 139.0), (3, None, 139.0), (4, 60.0, 10.0)], "i int, lat double, lng double")
    zones = spark.createDataFrame([(35.049, 139.0, 3300.0), (60.0, 10.02, 2000.0)], "zone_lat double, zone_lng double, radius_m double")
    assert sorted(r["i"] for r in L.exclude_zones(df, zones).collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(3))
def test_stay_points_against_plain_union(spark, seed):
    import math
    import random

    from brute_geo import metres

    g = random.Random(seed)
    base = (35.0, 69.0, -0.00002)[seed]
    # A dense blob, a thin trail, two blobs just apart, and ids shared over a distance.
    rows = [(base + g.random() * 0.0002, 10.0 + g.random() * 0.0002) for _ in range(60)]
    rows += [(base + 0.01, 10.0 + k * 0.0004 / math.cos(math.radians(base))) for k in range(25)]
    rows += [(base + 0.02 + g.random() * 0.0001, 10.0 + k + g.random() * 0.0001) for k in (0, 0.00055, 0.0009) for _ in range(15)]
    rows += [(base + g.random() * 0.005, 10.02 + g.random() * 0.005) for _ in range(60)]
    ids = [f"p{g.randrange(12)}" if g.random() < 0.1 else None for _ in rows]
    df = spark.createDataFrame([(1, i, a, b, p) for i, ((a, b), p) in enumerate(zip(rows, ids))], "subject_id bigint, visit_idx bigint, lat double, lng double, place_id string")
    for thr in (20.0, 50.0, 200.0):
        d = thr / 111_000 + 0.001
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                close = abs(rows[i][0] - rows[j][0]) <= d and abs(rows[i][1] - rows[j][1]) <= d and metres(rows[i], rows[j]) <= thr
                if close or (ids[i] and ids[i] == ids[j]):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
        got = {r["visit_idx"]: r["cluster_id"] for r in stay_points(df, thr).collect()}
        assert got == {i: root(i) for i in range(len(rows))}


def test_visible_moves_meet_many_pieces(spark):
    """One subject, moves of any length across hundreds of pieces; one has an end that no clock shows, which no list of hours could hold."""
    rng, t, rows = random.Random(3), 0, []
    for i in range(700):
        t += rng.choice([0, 0, 1_000, 40_000, 200_000, 1_500_000])
        rows.append((1, i, t, 43.0 + rng.randrange(5) / 100, 16.0 + rng.randrange(5) / 100, rng.choice(["BUS", "BUS", "TRAM"])))
    points = spark.createDataFrame(rows, "subject_id bigint, point_idx bigint, t_ms bigint, lat double, lng double, mode string")
    spans = [(a := rng.randrange(t), a + rng.choice([0, 30_000, 3_600_000, t])) for _ in range(150)] + [(rows[5][2], rows[90][2]), (t // 2, 9_000_000_000_000_000), (t, 0)]
    moves = [(1, k, "BUS", "d", a, b, 1.0, 10.0, 10.0, 10.0, 10.0) for k, (a, b) in enumerate(spans)]
    moves = spark.createDataFrame(moves, "subject_id bigint, activity_idx bigint, mode string, date_str string, start_ms bigint, end_ms bigint, distance_m double, start_lat double, start_lng double, end_lat double, end_lng double")
    zone = spark.createDataFrame([(43.02, 16.02, 300.0), (43.04, 16.0, 300.0)], "zone_lat double, zone_lng double, radius_m double")
    pieces = U.trimmed_segments(U.run_segments(U.route_runs(points)), zone)
    got = {r["activity_idx"]: r for r in U.visible_moves(moves, pieces, zone).collect()}
    metres = lambda p, q: 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin(math.radians(q["lat"] - p["lat"]) / 2) ** 2 + math.cos(math.radians(p["lat"])) * math.cos(math.radians(q["lat"])) * math.sin(math.radians(q["lng"] - p["lng"]) / 2) ** 2))
    pieces, partial = pieces.collect(), 0
    for k, (a, b) in enumerate(spans):
        met = [s for s in pieces if s["start_ms"] <= b and s["end_ms"] >= a] if a <= b else []
        if not any(s["trimmed"] for s in met):
            assert (got[k]["partial"], got[k]["start_ms"], got[k]["end_ms"], got[k]["distance_m"]) == (False, a, b, 1.0)
            continue
        seen = [p for s in met if len(p := [x for x in s["points"] if a <= x["t"] <= b]) >= 2]
        assert (k in got) == bool(seen)
        if seen:
            partial += 1
            assert (got[k]["partial"], got[k]["start_ms"], got[k]["end_ms"]) == (True, seen[0][0]["t"], seen[-1][-1]["t"])
            assert got[k]["distance_m"] == pytest.approx(sum(metres(p, q) for s in seen for p, q in zip(s, s[1:])), abs=0.002)
    assert partial > 40


def test_zones_shuffle_no_table(spark, data):
    """Stays of a day timeline stay where they were read; before, each test against the three zones moved the whole table."""
    from geotrail.plans import adapter

    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    stays, zones = adapter.visits(spark, data), adapter.zones(spark)
    hidden = L.flag_near(stays, "lat", "lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), "hidden")
    for df in (hidden, L.exclude_zones(stays, zones)):
        assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    # The same flags as by the way for many centres, overlapping zones and places without coordinates included.
    odd = stays.select("lat", "lng").union(spark.createDataFrame([(None, 135.0), (35.0, None), (35.3, 135.3)], "lat double, lng double"))
    twice = zones.union(zones)
    many = spark.createDataFrame(twice.collect(), twice.schema)
    flags = [sorted(map(str, L.flag_near(odd, "lat", "lng", z, "zone_lat", "zone_lng", F.col("radius_m"), "hidden").collect())) for z in (twice, many)]
    assert flags[0] == flags[1] and any("hidden=True" in r for r in flags[0]) and len(flags[0]) == odd.count()


def test_day_summary_joins_moves_once(spark, data):
    """Only what is visible of each move is joined by a shuffle; before, so was each test against the zones."""
    from geotrail.plans import routes as plans

    assert plans.QUERIES["day_summary"](spark, data)._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") <= 1


def test_day_summary_joins_no_table(spark, data):
    """Moves keep their columns while what is visible of them is looked up; before, they were read again and joined by a shuffle and two sorts."""
    from geotrail.plans import routes as plans

    plan = plans.QUERIES["day_summary"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("activity_idx" in line for line in joins)


def test_visible_moves_without_times_or_path(spark):
    """Days apart, half metres in a sum of millions, moves without a time, turned round, of a subject without a path, and one identifier twice."""
    day = 86_400_000
    at = [*range(0, 200_000, 10_000), *range(40 * day, 40 * day + 200_000, 10_000)]
    rows = [(1, i, t, 43.0 + (i % 2) * 0.000_01, 16.0 + (150 if i == 20 else 0), "BUS") for i, t in enumerate(at)]
    points = spark.createDataFrame(rows, "subject_id bigint, point_idx bigint, t_ms bigint, lat double, lng double, mode string")
    zone = spark.createDataFrame([(43.0, -165.0, 50.0)], "zone_lat double, zone_lng double, radius_m double")
    spans = [(1, 0, 40 * day + 200_000), (1, 40 * day, 41 * day), (1, None, 5), (1, 5, None), (1, 9, 3), (2, 0, 40 * day)]
    near = (43.0, -165.0)
    moves = [(s, k // 2 * 2, "BUS", "d", a, b, 1.0, *near, 10.0, 10.0) for k, (s, a, b) in enumerate(spans)]
    moves = spark.createDataFrame(moves, "subject_id bigint, activity_idx bigint, mode string, date_str string, start_ms bigint, end_ms bigint, distance_m double, start_lat double, start_lng double, end_lat double, end_lng double")
    pieces = U.trimmed_segments(U.run_segments(U.route_runs(points)), zone)
    got = sorted((r["start_ms"], r["end_ms"], r["distance_m"]) for r in U.visible_moves(moves, pieces, zone).collect())
    step = 6_371_000.0 * math.radians(0.000_01)
    metres = lambda p, q: 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin(math.radians(q[3] - p[3]) / 2) ** 2 + math.cos(math.radians(p[3])) * math.cos(math.radians(q[3])) * math.sin(math.radians(q[4] - p[4]) / 2) ** 2))
    late = metres(rows[20], rows[21]) + 18 * step
    assert late > 9_000_000
    assert got == [(0, 40 * day + 190_000, pytest.approx(19 * step + metres(rows[19], rows[20]) + late, abs=0.001)), (40 * day, 40 * day + 190_000, pytest.approx(late, abs=0.001))]


def test_numbers_of_json_texts(spark):
    """Bare numbers are told from every other text, and both ways give what the JSON parser gives."""
    from geotrail.plans import adapter

    numbers = ["0", "7", "-7", "123456789", "2147483647", "-0", "07", "+7", "7 ", " 7", "null", '"7"', "7\n", "7, \"k\": 8", "7}", "7, \"x\": {\"k\": 1}", "\u0667"]
    texts = [f'{{"k": {n}}}' for n in numbers] + ['{"k":7}', '{"k": 7}\n', ' {"k": 7}', '{"j": 7}', "", "{", None]
    df = spark.createDataFrame([(t,) for t in texts], "props string")
    whole = F.get_json_object("props", "$.k").cast("int")
    for t, got, want in df.select("props", adapter._number("props"), whole).collect():
        assert got == want, t
    # Most texts are bare, so the parser must not be asked for them.
    assert df.where("props = '{\"k\": 7}'").select(adapter._number("props").alias("k"), F.lit(7).alias("want")).where("k = want").count() == 1
    assert "RLIKE" in df.select(adapter._number("props"))._jdf.queryExecution().optimizedPlan().toString()
