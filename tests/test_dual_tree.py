import random

import numpy as np
import pyarrow.parquet as pq
from brute_geo import inside, lat_lng, metres, photo_place
from pyspark.sql import functions as F

from geotrail.functions.coords import with_geo_numbers, with_lat_lng
from geotrail.operators.dual_tree import containment_join, distance_join, haversine_m, near_pairs
from geotrail.operators.shred import readable_place
from geotrail.plans.problems import p2_found

TEXTS = [
    "35.1°, 139.2°", "geo:35.1,139.2", "(35.1; 139.2)", "139.2°E, 35.1°N", "35.1° N, 139.2° E", "35.1° S, 139.2° W", "lat=35.1, lng=139.2", "lng=139.2, lat=35.1", "+35.1°,+139.2°",
    " 35.1 °,  139.2 ° ", "35.1º, 139.2º", "35.1°, ", "35.1°", "35.1°, 139.2°, 78.5", "NaN°, NaN°", "unknown", "", None, "0°, 0°", "91.0, 10.0", "10.0, 181.0", "35.1° N, 36.1° N", "-35.1,-139.2",
]


def test_coordinate_texts(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "i int, t string, w int")
    rows = with_lat_lng(df, F.col("t")).collect()
    for r in rows:
        want = lat_lng(TEXTS[r["i"]])
        assert ((r["lat"], r["lng"]) if r["lat"] is not None else None) == want, r
        assert readable_place(TEXTS[r["i"]]) == (want is not None)


def test_photo_numbers(spark):
    rows = [(35.1, 139.2), (351000000.0, 1392000000.0), (351000000.5, 1392000000.0), (None, 1.0), (1.0, None), (0.0, 0.0), (float("nan"), 1.0), (0.0, 1400000000.0)]
    got = with_geo_numbers(spark.createDataFrame(rows, "a double, b double"), F.col("a"), F.col("b")).collect()
    assert [(r["lat"], r["lng"]) if r["lat"] is not None else None for r in got] == [photo_place(*r) for r in rows]


def _cloud(n, seed, spread=0.01):
    r = random.Random(seed)
    hot = [(35 + r.random() * 0.2, 139 + r.random() * 0.2) for _ in range(5)]
    return [(i, *(hot[i % 5] if i % 3 == 0 else (35 + r.random() * spread, 139 + r.random() * spread))) for i in range(n)]


def _brute(a, b, m):
    return sorted((i, j) for i, x, y in a for j, u, v in b if metres((x, y), (u, v)) <= m)


def test_distance_join_at_any_leaf_size(spark):
    a, b = _cloud(300, 1), _cloud(260, 2)
    b += [(1000 + i, x, y) for i, (_, x, y) in enumerate(a[:40])]
    df = lambda rows: spark.createDataFrame(rows, "id bigint, lat double, lng double")
    want = _brute(a, b, 75.0)
    assert want
    for leaf in (7, 100_000):
        assert sorted(map(tuple, distance_join(df(a), df(b), 75.0, leaf_points=leaf).collect())) == want


def test_a_third_of_all_points_at_one_spot(spark):
    a = [(i, 10.0, 20.0) for i in range(60)] + [(100 + i, 10.0 + i * 0.01, 20.0) for i in range(1, 20)]
    b = [(i, 10.0, 20.0) for i in range(50)] + [(100, 10.0001, 20.0)]
    df = lambda rows: spark.createDataFrame(rows, "id bigint, lat double, lng double")
    assert sorted(map(tuple, distance_join(df(a), df(b), 75.0, leaf_points=10).collect())) == _brute(a, b, 75.0)


def test_seams_nulls_and_empty_sides(spark):
    df = lambda rows: spark.createDataFrame(rows, "id bigint, lat double, lng double, cell string, leaf int")
    a = df([(1, 0.0, 179.9999, "x", 1), (2, 89.9999, 10.0, "x", 1), (3, None, 1.0, "x", 1), (None, 1.0, 1.0, "x", 1), (4, float("nan"), 1.0, "x", 1), (5, 95.0, 1.0, "x", 1), (1, 0.0, 179.9999, "y", 1)])
    b = df([(7, 0.0, -179.9999, "z", 1), (8, 89.9999, -170.0, "z", 1)])
    assert sorted(map(tuple, distance_join(a, b, 75.0).collect())) == [(1, 7), (1, 7), (2, 8)]
    assert distance_join(a.limit(0), b, 75.0).count() == 0 and distance_join(a, b.limit(0), 75.0).count() == 0


def test_wide_radius_over_a_dense_city_keeps_tasks_small(spark):
    from geotrail.operators.dual_tree import _Deal, _near_leaves, cell_summaries, chord_of, quad_leaves

    r = random.Random(9)
    rows = [(i, 35.6 + r.random() * 0.1, 139.6 + r.random() * 0.1) for i in range(3000)] + [(5000 + i, 35.65, 139.65) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lng double").repartition(4)
    leaves = quad_leaves(cell_summaries([df, df]), 2, 200)
    assert leaves.count.sum() == 2 * len(rows) and len(leaves.starts) < 6 * 2 * len(rows) / 200
    pairs = _near_leaves(leaves, chord_of(5000.0))
    plan = _Deal(leaves, pairs, 200)
    lat, lng, ids = (np.array([x[k] for x in rows], float) for k in (1, 2, 0))
    cell = (np.floor((lat + 90) / 180 * 65536).astype(np.int64) << 16) | np.floor((lng + 180) / 360 * 65536).astype(np.int64)
    load = {}
    for side, deal in enumerate((plan.left, plan.right)):
        _, leaf, block, slot = deal(cell, ids.astype(np.int64), lat, lng, chord_of(5000.0) ** 2)
        for key in zip(leaf.tolist(), block.tolist(), slot.tolist()):
            load.setdefault(key, [0, 0])[side] += 1
    # Blocks of a spot are dealt out by hash, so they differ a little; right leaves fill a slot up to twice its size.
    assert max(a for a, _ in load.values()) <= 400 and max(b for _, b in load.values()) <= 500
    some = df.where("id % 40 = 0")
    assert sorted(map(tuple, distance_join(some, df, 5000.0, leaf_points=200).collect())) == _brute([x for x in rows if x[0] % 40 == 0], rows, 5000.0)


def test_regions_of_a_leaf_over_several_slots(spark):
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    rows = [(f"r{k}", (k * 7) % 40, [[box(0.1 * (k % 6), 0.1 * (k % 5), 1.0)]]) for k in range(40)]
    regions = spark.createDataFrame(rows, "key string, order int, geometry array<array<array<array<double>>>>")
    r = random.Random(4)
    points = [(i, r.random() * 1.6, r.random() * 1.6) for i in range(300)]
    points += points[:30]
    df = spark.createDataFrame(points, "id bigint, lat double, lng double")
    want = sorted(map(tuple, containment_join(df, regions).collect()))
    assert len(want) > 250 and sorted(map(tuple, containment_join(df, regions, task_edges=20).collect())) == want


def test_near_pairs_in_pieces():
    lat = np.full(300, 1.0)
    pairs = [p for p in near_pairs(lat, lat, lat, lat, 10.0)]
    assert sum(len(i) for i, _ in pairs) == 90_000
    assert haversine_m(0, 0, 0, 1) == haversine_m(0, 1, 0, 0)


def test_regions_with_holes_parts_and_borders(spark):
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    rows = [
        ("hole", 0, [[box(0.0, 0.0, 4.0), box(1.0, 1.0, 1.0)]]),
        ("parts", 1, [[box(10.0, 10.0, 1.0)], [box(12.0, 12.0, 1.0)]]),
        ("inner", 2, [[box(1.25, 1.25, 0.5)]]),
        ("over", 3, [[box(0.0, 0.0, 4.0)]]),
        ("none", 4, None),
        (None, 5, [[box(0.0, 0.0, 4.0)]]),
        ("flat", 6, [[[[0.0, 0.0], [1.0, 1.0]]]]),
    ]
    regions = spark.createDataFrame(rows, "key string, order int, geometry array<array<array<array<double>>>>")
    points = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 1.1, 1.1), (4, 10.5, 10.5), (5, 12.5, 12.5), (6, 11.5, 11.5), (7, 0.0, 2.0), (8, 50.0, 50.0), (9, None, 1.0)]
    df = spark.createDataFrame(points, "id bigint, lat double, lng double")
    want = {1: "hole", 2: "inner", 3: "over", 4: "parts", 5: "parts", 7: "hole"}
    for leaf in (2, 1000):
        assert {r["id"]: r["region_key"] for r in containment_join(df, regions, leaf_points=leaf).collect()} == want
    assert containment_join(df.limit(0), regions).count() == 0 and containment_join(df, regions.limit(0)).count() == 0


def test_whole_query_against_brute_force(spark, data):
    starts, photos, want = {}, {}, set()
    for r in pq.read_table(f"{data}/timeline.parquet").to_pylist():
        if r["activity"] is not None and r["visit"] is None and (p := lat_lng((r["activity"]["start_loc"] or {}).get("lat_lng"))):
            starts[r["segment_id"]] = p
    for r in pq.read_table(f"{data}/photo_sidecars.parquet").to_pylist():
        g = r["geo_data"] or {}
        if p := photo_place(g.get("latitude"), g.get("longitude")):
            photos[r["photo_id"]] = p
    shapes = [(m["code"], m["geometry"]) for m in sorted(pq.read_table(f"{data}/municipalities.parquet").to_pylist(), key=lambda m: m["feature_idx"])]
    boxes = []
    for code, g in shapes:
        xs, ys = zip(*[q for polygon in g for ring in polygon for q in ring])
        boxes.append((min(xs), max(xs), min(ys), max(ys), code, g))
    for s, p in starts.items():
        want |= {(s, "near", str(k)) for k, q in photos.items() if metres(p, q) <= 75}
        hits = [b[4] for b in boxes if b[0] <= p[1] <= b[1] and b[2] <= p[0] <= b[3] and inside(p, b[5])]
        want |= {(s, "inside", hits[0])} if hits else set()
    assert {tuple(r) for r in p2_found(spark, data).collect()} == want
