"""The queries of the general problems 1 to 5 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.coords import with_geo_numbers, with_lat_lng
from geotrail.operators.dual_tree import containment_join, distance_join
from geotrail.operators.instants import with_instants
from geotrail.operators.nearest_time import nearest_in_time
from geotrail.operators.periods import periods_and_gaps
from geotrail.operators.shred import flatten_exports
from geotrail.plans.tables import table
from geotrail.session import ensure_checkpoint_dir, small_side

#: Fixed values of the test tables: 2021-12-01 and 2027-01-01 (UTC) in seconds, the span that true times lie in.
TRUE_SPAN = (1_638_316_800, 1_798_761_600)


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_side(table(spark, sf_dir, "devices").select(F.col("device_id").alias("home_device"), "home_zone"))


def timeline_instants(spark: SparkSession, sf_dir: str, texts: dict, *columns: str) -> DataFrame:
    """``columns`` of the timeline with an instant for each of ``texts``."""
    rows = table(spark, sf_dir, "timeline").withColumnRenamed("start_time_timezone_utc_offset_minutes", "row_offset")
    rows = rows.select(*dict.fromkeys([*columns, "row_offset", "device_id"]), *[F.col(t).alias(n) for n, t in texts.items()])
    rows = rows.join(_homes(spark, sf_dir), F.col("device_id") == F.col("home_device"), "left")
    return with_instants(rows, {n: F.col(n) for n in texts}, "row_offset", "home_zone", epoch_span=TRUE_SPAN).select(*columns, *texts)


def photo_instants(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the photos with ``utc_ms``, the instant they were taken."""
    rows = table(spark, sf_dir, "photo_sidecars").select("*", F.col("photo_taken_time.timestamp_text").alias("utc_ms"))
    rows = rows.join(_homes(spark, sf_dir), F.col("device_id") == F.col("home_device"), "left").select(*dict.fromkeys([*columns, "utc_ms", "home_zone"]))
    return with_instants(rows, {"utc_ms": F.col("utc_ms")}, None, "home_zone", epoch_span=TRUE_SPAN).select(*columns, "utc_ms")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timeline row and photo that has an instant."""
    segments = timeline_instants(spark, sf_dir, {"utc_ms": "start_time"}, "segment_id")
    photos = photo_instants(spark, sf_dir, "photo_id")
    both = segments.select(F.lit("segment").alias("record_kind"), F.col("segment_id").alias("record_id"), "utc_ms").unionByName(
        photos.select(F.lit("photo").alias("record_kind"), F.col("photo_id").alias("record_id"), "utc_ms")
    )
    return both.where(F.col("utc_ms").isNotNull())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each place where a move starts, the photos at most 75 m away and the municipality that contains it."""
    ensure_checkpoint_dir(spark)
    moves = table(spark, sf_dir, "timeline").where(F.col("activity").isNotNull() & F.col("visit").isNull())
    moves = with_lat_lng(moves.select("segment_id", F.col("activity.start_loc.lat_lng").alias("text")), F.col("text"))
    photos = table(spark, sf_dir, "photo_sidecars").select("photo_id", "geo_data.latitude", "geo_data.longitude")
    photos = with_geo_numbers(photos, F.col("latitude"), F.col("longitude"))
    # Each place is read once and used by the summary of the tree and by the join.
    # Rows without a place go after that: a filter here would be pushed down with the whole reading inlined in it.
    starts = moves.select("segment_id", "lat", "lng").checkpoint().where(F.col("lat").isNotNull())
    shots = photos.select("photo_id", "lat", "lng").checkpoint().where(F.col("lat").isNotNull())
    near = distance_join(starts, shots, 75.0, left_cols=("segment_id", "lat", "lng"), right_cols=("photo_id", "lat", "lng"))
    inside = containment_join(
        starts, table(spark, sf_dir, "municipalities"), point_cols=("segment_id", "lat", "lng"), region_cols=("code", "feature_idx", "geometry")
    )
    return near.select(F.col("left_id").alias("segment_id"), F.lit("near").alias("kind"), F.col("right_id").cast("string").alias("found_key")).unionByName(
        inside.select(F.col("id").alias("segment_id"), F.lit("inside").alias("kind"), F.col("region_key").alias("found_key"))
    )


def path_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment_id, point_no, device_id, utc_ms``: every path element whose time has an instant."""
    rows = table(spark, sf_dir, "timeline").select(
        "segment_id", "device_id", F.col("start_time_timezone_utc_offset_minutes").alias("row_offset"), F.posexplode("timeline_path.time_text").alias("point_no", "utc_ms")
    )
    rows = rows.join(_homes(spark, sf_dir), F.col("device_id") == F.col("home_device"), "left").drop("home_device")
    return with_instants(rows, {"utc_ms": F.col("utc_ms")}, "row_offset", "home_zone", epoch_span=TRUE_SPAN).where(F.col("utc_ms").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each photo the path fix of its device that is nearest in time, within ten minutes."""
    pairs = nearest_in_time(
        photo_instants(spark, sf_dir, "photo_id", "device_id"),
        path_fixes(spark, sf_dir),
        left_keys=("photo_id", "device_id", "utc_ms"),
        right_keys=("segment_id", "point_no", "device_id", "utc_ms"),
        tolerance_ms=600_000,
    )
    return pairs.select(F.col("left_id").alias("photo_id"), F.col("right_id").alias("segment_id"), F.col("right_order").alias("point_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's continuous periods and the gaps between them."""
    spans = timeline_instants(spark, sf_dir, {"from_ms": "start_time", "to_ms": "end_time"}, "device_id")
    return periods_and_gaps(spans, "device_id", "from_ms", "to_ms").withColumnRenamed("entity", "device_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves and path points of every delivered export as flat rows."""
    return flatten_exports(table(spark, sf_dir, "raw_exports"), "export_id", "payload")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}
