"""Small stores: zones, bookmarks, recent files, and caches of results by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.sources.schemas import BOOKMARKS, ZONES

RECENT_FILES = 10


def _read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", f"array<struct<{schema_fields(schema)}>>")).alias("r"))
        return rows.select("r.*")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def schema_fields(schema: str) -> str:
    """A schema in column form as the fields of a struct."""
    out, depth = [], 0
    for part in schema.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}: {kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ", ".join(out)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """``zone_lat, zone_lng, radius_m``; none for a missing or malformed file."""
    z = _read_array(spark, path, ZONES)
    return z.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(F.col("lat").alias("zone_lat"), F.col("lng").alias("zone_lng"), F.col("radiusMeters").alias("radius_m"))


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """Bookmarks; none for a missing or malformed file."""
    return _read_array(spark, path, BOOKMARKS)


def recent_files(opened: DataFrame, most: int = RECENT_FILES) -> DataFrame:
    """The latest opening of each content (``hash, path, name, size, opened_ms``), the ``most`` latest of them."""
    last = Window.partitionBy("hash").orderBy(F.desc("opened_ms"))
    return opened.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n").orderBy(F.desc("opened_ms")).limit(most)


def evicted_files(opened: DataFrame, most: int = RECENT_FILES) -> DataFrame:
    """The contents beyond the ``most`` latest; their backups may go."""
    return opened.select("hash").distinct().join(recent_files(opened, most).select("hash"), "hash", "left_anti")


def without_file(opened: DataFrame, content: str) -> DataFrame:
    """The registry without one content."""
    return opened.where(F.col("hash") != content)


def resolve_file(spark: SparkSession, path: str, backup: str | None) -> str | None:
    """Where a recent file can be read: at its own place, else from its backup, else nowhere."""
    for p in filter(None, (path, backup)):
        at, fs = _fs(spark, p)
        if fs.exists(at):
            return p
    return None


def content_hash(content: Column) -> Column:
    """Key of a file's content."""
    return F.sha2(content, 256)


def result_key(path: Column, size: Column, mtime: Column) -> Column:
    """Key of a result made from a file as it was."""
    return F.sha1(F.concat_ws("|", path, size.cast("string"), mtime.cast("string")))


def cached_labels(places: DataFrame, cache: DataFrame) -> DataFrame:
    """Places with the label the cache has for their ``cache_key``, if any; nothing is fetched."""
    c = cache.select(F.col("cache_key").alias("__k"), "label")
    return places.join(c, F.col("cache_key") == F.col("__k"), "left").drop("__k")


RESULT_VERSION = 1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def file_key(spark: SparkSession, path: str) -> str:
    """``result_key`` of a file, or of a folder with all its files, as it is now."""
    p, fs = _fs(spark, path)
    summary = fs.getContentSummary(p)
    last = max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])
    return hashlib.sha1(f"{fs.resolvePath(p)}|{summary.getLength()}|{summary.getFileCount()}|{last}".encode()).hexdigest()


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a result was written to its end."""
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def cached_result(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result kept under ``key`` (see ``file_key``; a threshold may be part of it), made and written if there is none of the present form."""
    path = f"{folder}/v{RESULT_VERSION}/{key}"
    if not is_whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: The tables whose row counts tell whether an entry is the whole of what was made of a file.
COUNTED = ("visits", "activities", "path_points")


def keep_entry(spark: SparkSession, folder: str, key: str, tables: dict[str, DataFrame]) -> None:
    """Writes all tables of a file's entry, and last their counts, by which it is valid."""
    path = f"{folder}/v{RESULT_VERSION}/{key}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in COUNTED]
    spark.createDataFrame(counts, "name string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def kept_entry(spark: SparkSession, folder: str, key: str) -> dict[str, DataFrame] | None:
    """The tables of an entry of the present form whose counts are what they were; None where there is none or it is damaged."""
    path = f"{folder}/v{RESULT_VERSION}/{key}"
    if not all(is_whole(spark, f"{path}/{name}") for name in (*COUNTED, "counts")):
        return None
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in COUNTED}
    counts = {r["name"]: r["n"] for r in spark.read.parquet(f"{path}/counts").collect()}
    return tables if all(tables[name].count() == counts.get(name) for name in COUNTED) else None


def keep_clusters(spark: SparkSession, folder: str, key: str, threshold_m: float, clusters: DataFrame) -> bool:
    """Adds the places of one more threshold to an entry; only if the entry is whole, so that no half entry comes of it."""
    if kept_entry(spark, folder, key) is None:
        return False
    clusters.write.mode("overwrite").parquet(f"{folder}/v{RESULT_VERSION}/{key}/clusters_{threshold_m:g}")
    return True


def kept_clusters(spark: SparkSession, folder: str, key: str, threshold_m: float) -> DataFrame | None:
    """The places of a threshold, if the entry has them."""
    path = f"{folder}/v{RESULT_VERSION}/{key}/clusters_{threshold_m:g}"
    return spark.read.parquet(path) if kept_entry(spark, folder, key) is not None and is_whole(spark, path) else None


def clear_results(spark: SparkSession, folder: str) -> int:
    """Removes all kept results of every form and says how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    n = sum(len(fs.listStatus(v.getPath())) for v in fs.listStatus(path) if v.isDirectory())
    fs.delete(path, True)
    return n


def delete_all(spark: SparkSession, folders: dict[str, str]) -> dict[str, int]:
    """Removes every named store and says how many files each had."""
    out = {}
    for name, folder in folders.items():
        path, fs = _fs(spark, folder)
        out[name] = fs.getContentSummary(path).getFileCount() if fs.exists(path) else 0
        fs.delete(path, True)
    return out
