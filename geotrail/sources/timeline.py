"""Timeline exports as normalized tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.calendar import local_parts
from geotrail.functions.coords import read_pair_prefix
from geotrail.sources.schemas import TIMELINE


@dataclass
class Timeline:
    """The tables of one or many exports; ``subject_id`` is derived from the file, so that many are read at once."""

    visits: DataFrame
    activities: DataFrame
    path_points: DataFrame
    frequent_places: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; missing or wrongly typed lists of segments read as empty."""
    docs = spark.read.schema(TIMELINE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return docs.withColumn("subject_id", F.xxhash64(F.input_file_name()))


def _ms(text: Column) -> Column:
    return F.unix_millis(text.try_cast("timestamp"))


def normalize(docs: DataFrame) -> Timeline:
    """Stays, moves, path points and labelled places. A segment is a stay, else a move, else a path, whichever it has first.

    Stays and path points without readable coordinates are dropped, moves are kept; a distance that is no number counts 0, a move
    without a type is UNKNOWN; an end of 0 or none is none. Positions in the source are kept as indexes.
    """
    seg = docs.select("subject_id", F.posexplode(F.coalesce("semanticSegments", F.array().cast(docs.schema["semanticSegments"].dataType))).alias("seg_idx", "s")).where(F.col("s").isNotNull())
    off = F.col("s.startTimeTimezoneUtcOffsetMinutes")
    start, end = _ms(F.col("s.startTime")), F.nullif(_ms(F.col("s.endTime")), F.lit(0).cast("bigint"))
    base = seg.select("subject_id", "seg_idx", "s", start.alias("start_ms"), end.alias("end_ms"), off.alias("off_min"))
    parts = lambda t: [c.alias(n) for n, c in local_parts(t, F.col("off_min")).items()]
    v = base.where(F.col("s.visit").isNotNull()).withColumn("at", read_pair_prefix(F.col("s.visit.topCandidate.placeLocation.latLng")))
    visits = v.where(F.col("at").isNotNull()).select(
        "subject_id",
        F.col("seg_idx").alias("visit_idx"),
        F.nullif("s.visit.topCandidate.placeId", F.lit("")).alias("place_id"),
        F.col("s.visit.topCandidate.semanticType").alias("semantic_type"),
        F.col("s.visit.probability").alias("probability"),
        "at.lat",
        "at.lng",
        "start_ms",
        "end_ms",
        "off_min",
        *parts(F.col("start_ms")),
    )
    a = base.where(F.col("s.visit").isNull() & F.col("s.activity").isNotNull())
    a = a.withColumn("p", read_pair_prefix(F.col("s.activity.start.latLng"))).withColumn("q", read_pair_prefix(F.col("s.activity.end.latLng")))
    kind = F.col("s.activity.topCandidate.type")
    activities = a.select(
        "subject_id",
        F.col("seg_idx").alias("activity_idx"),
        F.when(kind.isNull() | (kind == "UNKNOWN_ACTIVITY_TYPE"), "UNKNOWN").otherwise(kind).alias("mode"),
        F.coalesce("s.activity.distanceMeters", F.lit(0.0)).alias("distance_m"),
        "start_ms",
        "end_ms",
        "off_min",
        F.col("p.lat").alias("start_lat"),
        F.col("p.lng").alias("start_lng"),
        F.col("q.lat").alias("end_lat"),
        F.col("q.lng").alias("end_lng"),
        *parts(F.col("start_ms")),
    )
    t = base.where(F.col("s.visit").isNull() & F.col("s.activity").isNull()).select("subject_id", "seg_idx", "off_min", F.posexplode("s.timelinePath").alias("pt_idx", "x"))
    t = t.select("subject_id", "seg_idx", "pt_idx", "off_min", _ms(F.col("x.time")).alias("t_ms"), read_pair_prefix(F.col("x.point")).alias("at"))
    points = t.where(F.col("at").isNotNull()).select("subject_id", "seg_idx", "pt_idx", "t_ms", "off_min", "at.lat", "at.lng", *parts(F.col("t_ms")))
    f = docs.select("subject_id", F.explode("userLocationProfile.frequentPlaces").alias("f")).select("subject_id", "f.*", read_pair_prefix(F.col("f.placeLocation")).alias("at"))
    frequent = f.where((F.coalesce("label", F.lit("")) != "") & F.col("at").isNotNull())
    return Timeline(visits, activities, points, frequent.select("subject_id", F.col("placeId").alias("place_id"), "label", F.col("at.lat").alias("home_lat"), F.col("at.lng").alias("home_lng")))


def empty(spark: SparkSession) -> Timeline:
    """The tables of no export at all, for work with photos only."""
    return normalize(spark.createDataFrame([], TIMELINE + ", subject_id bigint"))


def write(tables: Timeline, path: str, mode: str = "overwrite") -> None:
    """The result sink: one Parquet folder per table."""
    for name in ("visits", "activities", "path_points", "frequent_places"):
        getattr(tables, name).write.mode(mode).parquet(f"{path}/{name}")
