"""Photos: sidecars, records from several sources, places estimated from the history, and the photos of a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.operators.asof import asof
from geotrail.operators.filters import near_any, near_keys

#: Fixed value: how far in time the nearest sample may be, in ms.
MOST_GAP_MS = 2 * 3_600_000
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic")


def match_sidecars(photos: DataFrame, files: DataFrame) -> DataFrame:
    """``photos`` (``dir, name``) with ``sidecar``: ``name.json``, else ``base.json``, else the shortest JSON file that begins with either.

    ``files`` (``dir, file``) are the JSON files; equally short names go by alphabet.
    """
    base = F.regexp_replace("name", r"\.[^.]*$", "")
    p = photos.select("dir", "name", base.alias("base"))
    f = files.where(F.lower("file").endswith(".json")).select("dir", "file")
    # Exact names by equality; the rest by a shared beginning of the base name, so that a folder is not paired all with all.
    one = p.select("dir", "name", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.concat("name", F.lit(".json")).alias("file")), F.struct(F.lit(1).alias("tier"), F.concat("base", F.lit(".json")).alias("file")))).alias("w"))
    exact = one.select("dir", "name", "w.tier", "w.file").join(f, ["dir", "file"])
    stems = f.select("dir", "file", F.explode(F.transform(F.sequence(F.lit(1), F.length("file") - 5), lambda n: F.substring("file", F.lit(1), n))).alias("base"))
    loose = p.join(stems, ["dir", "base"]).where(F.col("file") != F.col("name")).select("dir", "name", F.lit(2).alias("tier"), "file")
    best = exact.select("dir", "name", "tier", "file").unionByName(loose).groupBy("dir", "name").agg(F.min(F.struct("tier", F.length("file").alias("n"), "file")).alias("b"))
    return photos.join(best, ["dir", "name"], "left").withColumn("sidecar", F.col("b.file")).drop("b")


def read_sidecar(payload: Column) -> Column:
    """``struct<lat, lng, taken_ms>`` of a sidecar's JSON; (0, 0) is no place, malformed text gives nulls."""
    r = F.from_json(payload, "geoData struct<latitude: double, longitude: double>, photoTakenTime struct<timestamp: string>")
    lat, lng = r["geoData"]["latitude"], r["geoData"]["longitude"]
    known = ~((lat == 0) & (lng == 0))
    taken = r["photoTakenTime"]["timestamp"].try_cast("double")
    return F.struct(F.when(known, lat).alias("lat"), F.when(known, lng).alias("lng"), (taken * 1000).cast("bigint").alias("taken_ms"))


def coalesce_record(exif_lat: Column, exif_lng: Column, exif_ms: Column, side: Column, born_ms: Column) -> Column:
    """One record of what several sources say: the camera's place and time first, then the sidecar's, then the file's birth as fallback."""
    exif = exif_lat.isNotNull() & exif_lng.isNotNull() & ~((exif_lat == 0) & (exif_lng == 0))
    take = side["lat"].isNotNull() & side["lng"].isNotNull()
    taken = F.coalesce(exif_ms, side["taken_ms"])
    return F.struct(
        F.when(exif, exif_lat).when(take, side["lat"]).alias("lat"),
        F.when(exif, exif_lng).when(take, side["lng"]).alias("lng"),
        F.when(exif, "exif").when(take, "takeout").alias("source"),
        F.coalesce(taken, born_ms).alias("taken_ms"),
        taken.isNull().alias("taken_is_fallback"),
    )


def rescan(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``found`` files with ``action``: ``keep`` where the manifest has the path with the same time, else ``read``; vanished ones are not there."""
    old = manifest.select(F.col("path").alias("old_path"), F.col("mtime").alias("old_mtime"))
    out = found.join(old, (F.col("path") == F.col("old_path")) & (F.col("mtime") == F.col("old_mtime")), "left")
    return out.select(*found.columns, F.when(F.col("old_path").isNotNull(), "keep").otherwise("read").alias("action"))


def estimate_places(photos: DataFrame, stays: DataFrame, samples: DataFrame) -> DataFrame:
    """Places for photos that have a time but none: the stay they were taken in, else the sample nearest in time within two hours.

    Only the last stay that began is asked whether the time lies in it. ``samples`` are ``subject_id, t_ms, order, lat, lng``; of
    two equally near ones the later wins.
    """
    need = photos.where(F.col("lat").isNull() & F.col("taken_ms").isNotNull()).select("subject_id", "photo_idx", "taken_ms")
    s = stays.where(F.col("end_ms").isNotNull()).select("subject_id", F.col("start_ms").alias("s_start"), F.col("visit_idx").alias("s_idx"), F.col("end_ms").alias("s_end"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    out = asof(need, s, by="subject_id", left_time="taken_ms", right_time="s_start", payload=["s_idx", "s_end", "s_lat", "s_lng"])
    pack = lambda p: samples.select("subject_id", F.col("t_ms").alias(f"{p}_t"), F.col("order").alias(f"{p}_o"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    out = asof(out, pack("b"), by="subject_id", left_time="taken_ms", right_time="b_t", payload=["b_o", "b_lat", "b_lng"])
    out = asof(out, pack("f"), by="subject_id", left_time="taken_ms", right_time="f_t", payload=["f_o", "f_lat", "f_lng"], forward=True)
    inside = F.col("s_start").isNotNull() & (F.col("taken_ms") <= F.col("s_end"))
    later = F.col("f_t").isNotNull() & (F.col("b_t").isNull() | (F.col("f_t") - F.col("taken_ms") <= F.col("taken_ms") - F.col("b_t")))
    gap = F.when(later, F.col("f_t") - F.col("taken_ms")).otherwise(F.col("taken_ms") - F.col("b_t"))
    near = gap <= MOST_GAP_MS
    pick = lambda v: F.when(inside, F.col(f"s_{v}")).when(near, F.when(later, F.col(f"f_{v}")).otherwise(F.col(f"b_{v}")))
    return out.select("photo_idx", pick("lat").alias("lat"), pick("lng").alias("lng"), F.when(inside, F.lit(0)).when(near, gap).cast("bigint").alias("gap_ms"), F.when(inside, "stay").when(near, "nearest").otherwise("unknown").alias("tier"))


def photos_near_stays(photos: DataFrame, stays: DataFrame, threshold_m: float) -> DataFrame:
    """Photos within the threshold of any of the stays of their subject."""
    return near_any(photos, "lat", "lng", stays.select("subject_id", "lat", "lng").distinct(), "lat", "lng", threshold_m, by=("subject_id",), keep_near=True)


def photos_by_place(photos: DataFrame, stays: DataFrame, threshold_m: float) -> DataFrame:
    """``cluster_id, photo_idx``: for every place the photos of its subject within the threshold of any of its stays."""
    spots = stays.select("subject_id", "cluster_id", "lat", "lng").distinct()
    return near_keys(photos, "lat", "lng", spots, "lat", "lng", threshold_m, by=("subject_id",), key="cluster_id").select("cluster_id", "photo_idx").distinct()


def photo_summary(photos: DataFrame) -> DataFrame:
    """Number of photos by where their place comes from."""
    return photos.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def gallery(photos: DataFrame, most: int = 80) -> DataFrame:
    """The first photos by time, as many as a gallery shows."""
    return photos.orderBy("taken_ms", "photo_idx").limit(most)


def pin_changes(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """``photo_idx, action``: which pins to add and which to remove."""
    add = wanted.select("photo_idx").distinct().join(drawn.select("photo_idx"), "photo_idx", "left_anti").select("photo_idx", F.lit("add").alias("action"))
    return add.unionByName(drawn.select("photo_idx").distinct().join(wanted.select("photo_idx"), "photo_idx", "left_anti").select("photo_idx", F.lit("remove").alias("action")))
