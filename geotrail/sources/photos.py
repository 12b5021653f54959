"""Photo folders: listing, sidecars, manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.operators.photos import PHOTO_EXTENSIONS, coalesce_record, match_sidecars, photo_summary, read_sidecar, rescan
from geotrail.sources.exif import exif_table
from geotrail.sources.stores import _fs

MANIFEST_VERSION = 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2)
    return f.select("path", at[0].alias("dir"), at[1].alias("name"), F.unix_millis("modificationTime").alias("mtime"), "length", "content")


def list_photos(spark: SparkSession, path: str) -> DataFrame:
    """``path, dir, name, mtime, length`` of the pictures below a folder; contents are not read."""
    low = F.lower("name")
    kind = low.endswith(PHOTO_EXTENSIONS[0])
    for e in PHOTO_EXTENSIONS[1:]:
        kind = kind | low.endswith(e)
    return _files(spark, path).where(kind).drop("content")


def scan_photos(spark: SparkSession, path: str, exif: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Photo records of a folder, of the files of ``only`` (``path``) where it is given.

    ``exif`` (``path, exif_lat, exif_lng, exif_ms``) is what another reader of camera data found; without it the heads of JPEG files are read.
    A file's time of change stands in for its birth, which file systems of a cluster do not keep.
    """
    photos = list_photos(spark, path)
    if only is not None:
        photos = photos.join(only.select("path"), "path", "left_semi")
    if exif is None:
        jpeg = _files(spark, path).where(F.lower("name").endswith(".jpg") | F.lower("name").endswith(".jpeg"))
        exif = exif_table(jpeg if only is None else jpeg.join(only.select("path"), "path", "left_semi"))
    sides = _files(spark, path).where(F.lower("name").endswith(".json"))
    matched = match_sidecars(photos, sides.select("dir", F.col("name").alias("file")))
    body = sides.select(F.col("dir").alias("s_dir"), F.col("name").alias("s_name"), F.decode("content", "UTF-8").alias("body"))
    out = matched.join(body, (F.col("dir") == F.col("s_dir")) & (F.col("sidecar") == F.col("s_name")), "left")
    out = out.join(exif.withColumnRenamed("path", "e_path"), F.col("path") == F.col("e_path"), "left")
    out = out.withColumn("side", read_sidecar(F.col("body")))
    out = out.withColumn("r", coalesce_record(F.col("exif_lat"), F.col("exif_lng"), F.col("exif_ms"), F.col("side"), F.col("mtime")))
    return out.select("path", "mtime", "r.*").withColumn("has_location", F.col("lat").isNotNull())


def write_manifest(records: DataFrame, path: str) -> None:
    """The records with the version of their form."""
    records.withColumn("version", F.lit(MANIFEST_VERSION)).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of the present form; none where there is no manifest or one of another form."""
    try:
        return spark.read.parquet(path).where(F.col("version") == MANIFEST_VERSION).drop("version")
    except AnalysisException:
        return spark.createDataFrame([], schema)


RECORD = "path string, mtime bigint, lat double, lng double, source string, taken_ms bigint, taken_is_fallback boolean, has_location boolean"


def refresh_manifest(spark: SparkSession, folder: str, path: str, exif: DataFrame | None = None) -> DataFrame:
    """Brings the manifest at ``path`` up to the photos of a folder and returns ``source, n``, its photos by where their place comes from.

    Only files that are new or have another time are read; those that vanished are dropped. A manifest that is as it was is not written again;
    one of another folder counts as none. The new one is written beside the old before it takes its place.
    """
    kept = f"{path}/records"
    linked = read_manifest(spark, f"{path}/link", "folder string").where(F.col("folder") == folder)
    old = read_manifest(spark, kept, RECORD) if not linked.isEmpty() else spark.createDataFrame([], RECORD)
    found = rescan(list_photos(spark, folder).select("path", "mtime"), old)
    read = scan_photos(spark, folder, exif, only=found.where("action = 'read'")).select(*old.columns)
    new = old.join(found.where("action = 'keep'"), ["path", "mtime"], "left_semi").unionByName(read)
    changed = linked.isEmpty() or not found.where("action = 'read'").isEmpty() or not old.join(found, "path", "left_anti").isEmpty()
    if changed:
        write_manifest(new, f"{path}/next")
        write_manifest(spark.createDataFrame([(folder,)], "folder string"), f"{path}/link")
        at, fs = _fs(spark, kept)
        fs.delete(at, True)
        fs.rename(_fs(spark, f"{path}/next")[0], at)
        spark.catalog.refreshByPath(kept)
    return photo_summary(read_manifest(spark, kept, RECORD))
