import json

from pyspark.sql import functions as F

from geotrail.functions import text as X
from geotrail.operators.photos import photos_by_place
from geotrail.sources import boundaries, photos, stores
from geotrail.streaming.sessions import daily_distance, point_sessions


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feature = lambda code, g: {"properties": {"code": code, "name": f"n{code}", "prefCode": 3, "N03_007": code, "N03_003": "Gun", "N03_004": "Town"}, "geometry": g}
    doc = {"features": [feature("7", {"type": "Polygon", "coordinates": [ring]}), feature("7", {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}), feature(None, {"type": "Polygon", "coordinates": [ring]})]}
    (tmp_path / "b.geojson").write_text(json.dumps(doc))
    b = boundaries.read_boundaries(spark, str(tmp_path)).orderBy("feature_idx").collect()
    assert [len(r["geometry"]) for r in b] == [1, 2, 1] and (b[0]["pref_code"], b[0]["centre"]["lat"]) == (3, 0.8)
    m = boundaries.merge_regional_files(spark, str(tmp_path)).collect()
    assert [(r["code"], r["name"], len(r["geometry"])) for r in m] == [("7", "GunTown", 3)]


def test_photo_folder(spark, tmp_path):
    d = tmp_path / "album"
    d.mkdir()
    side = {"geoData": {"latitude": 34.75, "longitude": 135.5}, "photoTakenTime": {"timestamp": "1705727400"}}
    for name, body in (("a.jpg", ""), ("a.jpg.json", json.dumps(side)), ("b.HEIC", ""), ("b.json", "{bad"), ("c.png", ""), ("c.png.supplemental.json", json.dumps({**side, "geoData": {"latitude": 0, "longitude": 0}})), ("note.txt", "")):
        (d / name).write_text(body or "x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in photos.scan_photos(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.jpg", "b.HEIC", "c.png"}
    assert (got["a.jpg"]["lat"], got["a.jpg"]["source"], got["a.jpg"]["taken_ms"], got["a.jpg"]["taken_is_fallback"]) == (34.75, "takeout", 1705727400000, False)
    assert got["b.HEIC"]["taken_is_fallback"] and not got["c.png"]["has_location"] and got["c.png"]["taken_ms"] == 1705727400000
    records = photos.scan_photos(spark, str(tmp_path))
    photos.write_manifest(records, str(tmp_path / "manifest"))
    assert photos.read_manifest(spark, str(tmp_path / "manifest"), "path string, mtime bigint").count() == 3
    assert photos.read_manifest(spark, str(tmp_path / "nothing"), "path string, mtime bigint").count() == 0


def test_stores(spark, tmp_path):
    (tmp_path / "zones.json").write_text(json.dumps([{"lat": 1.0, "lng": 2.0, "radiusMeters": 300}, {"lat": None, "lng": 2.0, "radiusMeters": 1}]))
    (tmp_path / "marks.json").write_text(json.dumps([{"name": "n", "tab": "map", "view": "v", "anchor": {"lat": 1.5, "lng": 2.5}, "createdAt": 5}]))
    assert [tuple(r) for r in stores.read_zones(spark, str(tmp_path / "zones.json")).collect()] == [(1.0, 2.0, 300.0)]
    assert stores.read_bookmarks(spark, str(tmp_path / "marks.json")).first()["anchor"]["lat"] == 1.5
    assert stores.read_zones(spark, str(tmp_path / "none.json")).count() == 0
    opened = spark.createDataFrame([(f"h{i % 12}", f"/p{i}", "n", 1, i) for i in range(30)], "hash string, path string, name string, size bigint, opened_ms bigint")
    assert [r["opened_ms"] for r in stores.recent_files(opened).collect()] == list(range(29, 19, -1))


def test_results_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    folder = str(tmp_path / "kept")
    assert [stores.cached_result(spark, folder, "k50", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert stores.cached_result(spark, folder, "k200", make).count() == 3 and len(made) == 2
    assert stores.clear_results(spark, folder) == 2 and stores.clear_results(spark, folder) == 0


def test_texts(spark):
    df = spark.createDataFrame([(59_000 * 60, 950.4, 900_000, "<a href='x'>&</a>", "ＡＢＣ")], "ms bigint, m double, n bigint, h string, w string")
    r = df.select(X.duration_text(F.col("ms")), X.distance_text(F.col("m")), X.size_text(F.col("n")), X.escape_html(F.col("h")), X.search_form("w"), X.gap_text(F.col("ms")), X.clock_text(F.col("ms"), F.lit(540))).first()
    assert tuple(r) == ("59min", "950 m", "879 KB", "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;", "abc", "59 min", "09:59")


def test_distances(spark, data):
    from geotrail.plans import adapter, routes

    df = spark.createDataFrame([(0.0,), (999.4,), (1000.0,), (1250.0,), (1750.0,), (12345.0,), (1234567.0,), (None,)], "m double")
    got = [r[0] for r in df.select(X.distance_text(F.col("m"))).collect()]
    assert got == ["0 m", "999 m", "1.0 km", "1.3 km", "1.8 km", "12.3 km", "1,234.6 km", None]
    assert routes.QUERIES["distance_format"](spark, data).count() == adapter.activities(spark, data).count()


def test_photos_of_every_place(spark):
    stays = spark.createDataFrame([(1, 1, 35.0, 139.0), (1, 1, 35.0003, 139.0), (1, 2, 36.0, 139.0), (2, 5, 35.0, 139.0)], "subject_id int, cluster_id bigint, lat double, lng double")
    shots = spark.createDataFrame([(1, 10, 35.0002, 139.0), (1, 11, 36.0, 139.0001), (1, 12, 36.1, 139.0), (2, 13, 36.0, 139.0), (1, 14, None, None)], "subject_id int, photo_idx bigint, lat double, lng double")
    assert sorted(map(tuple, photos_by_place(shots, stays, 50.0).collect())) == [(1, 10), (2, 11)]


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 10:{m:02d}:00", 35.0 + m / 1000, 139.0) for m in (0, 5, 19, 45, 50)] + [(2, "2024-01-01 11:00:00", 35.0, 139.0)]
    spark.createDataFrame(rows, "subject_id int, ts string, lat double, lng double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    want = sorted((r["subject_id"], r["points"]) for r in point_sessions(table).collect())
    assert want == [(1, 2), (1, 3), (2, 1)]
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = point_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["subject_id"], r["points"]) for r in spark.table("sessions").collect()) == want
    m = spark.createDataFrame([("2024-01-01 10:00:00", "WALKING", 5), ("2024-01-01 12:00:00", "WALKING", 6)], "ts string, mode string, distance_m bigint").withColumn("ts", F.to_timestamp("ts"))
    assert [(r["distance_m"], r["trips"]) for r in daily_distance(m).collect()] == [(11, 2)]


def jpeg(lat=None, lng=None, taken=None, offset=None, order="<"):
    """A picture with nothing in it but what a camera says."""
    import struct

    def block(entries, at):
        head, tail = struct.pack(order + "H", len(entries)), b""
        rest = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            head += struct.pack(order + "HHI", tag, kind, count)
            if len(value) <= 4:
                head += value.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", rest + len(tail))
                tail += value
        return head + b"\0" * 4 + tail

    def angle(v):
        v = abs(v)
        return b"".join(struct.pack(order + "II", *p) for p in ((int(v), 1), (int(v * 60) % 60, 1), (round(v * 3600 % 60 * 1000), 1000)))

    text = lambda t: (2, len(t) + 1, t.encode() + b"\0")
    gps = [(1, *text("N" if lat >= 0 else "S")), (2, 5, 3, angle(lat)), (3, *text("E" if lng >= 0 else "W")), (4, 5, 3, angle(lng))] if lat is not None else []
    exif = ([(0x9003, *text(taken))] if taken else []) + ([(0x9011, *text(offset))] if offset else [])
    at_exif = 8 + 2 + 24 + 4
    body_exif = block(exif, at_exif)
    first = [(0x8769, 4, 1, struct.pack(order + "I", at_exif)), (0x8825, 4, 1, struct.pack(order + "I", at_exif + len(body_exif)))]
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + block(first, 8) + body_exif + block(gps, at_exif + len(body_exif))
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda" + b"x" * 50


def test_what_cameras_write():
    from geotrail.sources.exif import read_exif

    for order in "<>":
        lat, lng, ms = read_exif(jpeg(-43.5081, 172.6362, "2023:03:11 13:20:05", "+01:00", order))
        assert (round(lat, 6), round(lng, 6), ms) == (-43.5081, 172.6362, 1678537205000)
        assert read_exif(jpeg(taken="2023:03:11 13:20:05", order=order)) == (None, None, 1678540805000)
    whole = jpeg(1.5, -2.5, "2023:03:11 13:20:05")
    assert all(len(read_exif(whole[:k])) == 3 for k in range(len(whole))) and read_exif(b"") == read_exif(b"GIF89a") == read_exif(jpeg(taken="yesterday"))[:2] + (None,)


def test_manifest_follows_a_folder(spark, tmp_path):
    d = tmp_path / "album"
    d.mkdir()
    (d / "a.jpg").write_bytes(jpeg(43.5, 16.4, "2023:03:11 13:20:05", "+01:00"))
    (d / "b.jpg").write_bytes(jpeg())
    (d / "b.jpg.json").write_text(json.dumps({"geoData": {"latitude": 1.0, "longitude": 2.0}, "photoTakenTime": {"timestamp": "1678540805"}}))
    (d / "c.png").write_bytes(b"x")
    kept = str(tmp_path / "kept")
    counts = lambda: {r["source"]: r["n"] for r in photos.refresh_manifest(spark, str(d), kept).collect()}
    assert counts() == {"exif": 1, "takeout": 1, "none": 1}
    first = photos.read_manifest(spark, f"{kept}/records", photos.RECORD)
    assert {r["path"].rsplit("/", 1)[1]: r["taken_ms"] for r in first.collect()}["a.jpg"] == 1678537205000
    stamp = (tmp_path / "kept" / "records" / "_SUCCESS").stat().st_mtime_ns
    assert counts() == {"exif": 1, "takeout": 1, "none": 1} and (tmp_path / "kept" / "records" / "_SUCCESS").stat().st_mtime_ns == stamp
    (d / "c.png").unlink()
    (d / "d.jpg").write_bytes(jpeg(1.0, 1.0))
    assert counts() == {"exif": 2, "takeout": 1}
    other = tmp_path / "other"
    other.mkdir()
    (other / "z.png").write_bytes(b"x")
    assert {r["source"]: r["n"] for r in photos.refresh_manifest(spark, str(other), kept).collect()} == {"none": 1}


def test_entries_of_results_are_whole_or_not_there(spark, tmp_path):
    folder, key = str(tmp_path / "cache"), "k"
    tables = {name: spark.range(n) for name, n in (("visits", 3), ("activities", 2), ("path_points", 0))}
    assert stores.kept_entry(spark, folder, key) is None and not stores.keep_clusters(spark, folder, key, 50.0, spark.range(1))
    stores.keep_entry(spark, folder, key, tables)
    assert {n: t.count() for n, t in stores.kept_entry(spark, folder, key).items()} == {"visits": 3, "activities": 2, "path_points": 0}
    assert stores.kept_clusters(spark, folder, key, 50.0) is None and stores.keep_clusters(spark, folder, key, 50.0, spark.range(4))
    assert stores.kept_clusters(spark, folder, key, 50.0).count() == 4 and stores.kept_clusters(spark, folder, key, 200.0) is None
    spark.range(9).write.mode("overwrite").parquet(f"{folder}/v{stores.RESULT_VERSION}/{key}/visits")
    spark.catalog.refreshByPath(f"{folder}/v{stores.RESULT_VERSION}/{key}/visits")
    assert stores.kept_entry(spark, folder, key) is None and not stores.keep_clusters(spark, folder, key, 200.0, spark.range(1))
    assert stores.delete_all(spark, {"cache": folder, "nothing": str(tmp_path / "no")})["nothing"] == 0 and stores.kept_entry(spark, folder, key) is None


def test_recent_files(spark, tmp_path):
    opened = spark.createDataFrame([(f"h{i % 12}", f"/p{i}", "n", 1, i) for i in range(30)], "hash string, path string, name string, size bigint, opened_ms bigint")
    assert sorted(r["hash"] for r in stores.evicted_files(opened).collect()) == ["h6", "h7"]
    assert stores.without_file(opened, "h1").where("hash = 'h1'").count() == 0
    (tmp_path / "copy").write_text("x")
    copy = str(tmp_path / "copy")
    assert stores.resolve_file(spark, str(tmp_path / "no"), copy) == copy and stores.resolve_file(spark, str(tmp_path / "no"), None) is None and stores.resolve_file(spark, copy, None) == copy
    key = stores.file_key(spark, copy)
    (tmp_path / "copy").write_text("xy")
    assert stores.file_key(spark, copy) != key


def test_choice_of_language():
    assert [X.language("en", "ja", "ja-JP"), X.language("xx", "ja", "en"), X.language(None, None, "ja-JP"), X.language(None, None, None)] == ["en", "ja", "ja", "en"]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from geotrail.session import ensure_checkpoint_dir

    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)
