"""The engine's canonical tables, derived from the ``events`` test table, in Spark and in SQL.

``subject_id`` is the user. Views and sign-ups are stays, clicks are moves, errors are path points, purchases are photos.
Places lie on a small lattice within synthetic square regions, so every spatial result can be told by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.calendar import local_parts
from geotrail.plans.tables import table

#: The kinds of moves.
MODES = (
    "WALKING", "CYCLING", "RUNNING", "IN_PASSENGER_VEHICLE", "IN_TAXI", "IN_BUS", "IN_TRAIN", "IN_SUBWAY", "IN_TRAM", "IN_FERRY", "FLYING",
    "IN_GONDOLA_LIFT", "UNKNOWN",
)
#: Subjects of the routes: users are pooled, as single users have too few points for a path.
ROUTE_SUBJECTS = 16
#: (lat, lng, radius in metres) of the exclusion zones.
ZONES = ((35.0, 135.0, 60.0), (35.3, 135.3, 150.0), (35.7, 135.1, 3000.0))


def _number(props: str) -> Column:
    """The integer ``k`` of a JSON text. A text of nothing but one is read without a JSON parser, which takes ten times as long."""
    c = F.col(props)
    bare = c.rlike(r'^\{"k": (?:0|-?[1-9][0-9]{0,8})\}\z')
    return F.when(bare, c.substr(F.lit(7), F.length(c) - 7).cast("int")).otherwise(F.get_json_object(c, "$.k").cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        _number("props").alias("k"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000)).cast("bigint").alias("start_ms"),
    )
    off = F.when(F.col("user_id") % 3 == 0, 540).when(F.col("user_id") % 3 == 1, 0).otherwise(-300)
    return e.withColumn("off_min", off)


def _lat(k):
    return ((F.lit(350_000_000) + (F.col("user_id") % 10) * 1_000_000 + (k % 7) * 4000) / F.lit(1e7)).cast("double")


def _lng(k):
    return ((F.lit(1_350_000_000) + (F.col("user_id") % 7) * 1_000_000 + (k % 5) * 11000) / F.lit(1e7)).cast("double")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "signup"))
    k, p = F.col("k"), local_parts(F.col("start_ms"), F.col("off_min"))
    long = F.when(k % 10 == 0, 20).otherwise(1)
    return e.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("visit_idx"),
        F.when(k % 3 == 0, F.concat(F.lit("pl-"), F.col("user_id").cast("string"), F.lit("-"), (k % 5).cast("string"))).alias("place_id"),
        _lat(k).alias("lat"),
        _lng(k).alias("lng"),
        "start_ms",
        (F.col("start_ms") + F.floor(F.col("value") * 60000).cast("bigint") * long).alias("end_ms"),
        "off_min",
        *[p[n].alias(n) for n in ("year", "month", "date_str")],
        (1 + F.floor((F.col("user_id") % 10) / 2)).cast("int").alias("pref_code"),
        F.format_string("%02d%03d", (1 + F.floor((F.col("user_id") % 10) / 2)).cast("int"), (9 * (F.col("user_id") % 10) + F.col("user_id") % 7).cast("int")).alias("muni_code"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves."""
    e = _events(spark, sf_dir).where(F.col("event_type") == "click")
    k, p = F.col("k"), local_parts(F.col("start_ms"), F.col("off_min"))
    return e.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("activity_idx"),
        F.element_at(F.array(*[F.lit(m) for m in MODES]), (k % 13 + 1).cast("int")).alias("mode"),
        F.floor(F.col("value") * 1000 + 0.5).cast("bigint").alias("distance_m"),
        "start_ms",
        (F.col("start_ms") + F.floor(F.col("value") * 60000).cast("bigint")).alias("end_ms"),
        "off_min",
        _lat(k).alias("start_lat"),
        _lng(k).alias("start_lng"),
        _lat(k + 3).alias("end_lat"),
        _lng(k + 3).alias("end_lng"),
        *[p[n].alias(n) for n in ("year", "month", "date_str", "hour", "dow")],
        k.alias("k"),
    )


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed path points."""
    e = _events(spark, sf_dir).where(F.col("event_type") == "error")
    k, p = F.col("k"), local_parts(F.col("start_ms"), F.col("off_min"))
    region = F.col("user_id") % 10
    # Points wander one column east of the stays now and then, so that some regions are only passed.
    column = (F.col("user_id") + F.when(k % 4 == 0, 1).otherwise(0)) % 7
    return e.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("point_idx"),
        _lat(k).alias("lat"),
        ((F.lit(1_350_000_000) + column * 1_000_000 + (k % 5) * 11000) / F.lit(1e7)).cast("double").alias("lng"),
        F.col("start_ms").alias("t_ms"),
        "off_min",
        *[p[n].alias(n) for n in ("year", "month", "date_str")],
        (1 + F.floor(region / 2)).cast("int").alias("pref_code"),
        F.format_string("%02d%03d", (1 + F.floor(region / 2)).cast("int"), (9 * region + column).cast("int")).alias("muni_code"),
        k.alias("k"),
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos, half of them without a place."""
    e = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    k = F.col("k")
    here = k % 2 == 0
    return e.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("photo_idx"),
        F.col("start_ms").alias("taken_ms"),
        F.when(here, _lat(k)).alias("lat"),
        F.when(here, _lng(k)).alias("lng"),
        F.when(here, F.when(k % 4 == 0, "exif").otherwise("takeout")).alias("source"),
        "off_min",
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path points of the pooled subjects."""
    return path_points(spark, sf_dir).withColumn("subject_id", F.col("subject_id") % ROUTE_SUBJECTS)


def route_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of the pooled subjects, of three kinds."""
    mode = F.element_at(F.array(F.lit("WALKING"), F.lit("IN_TRAIN"), F.lit("IN_BUS")), (F.col("k") % 3 + 1).cast("int"))
    return activities(spark, sf_dir).withColumn("subject_id", F.col("subject_id") % ROUTE_SUBJECTS).withColumn("mode", mode)


def regions(spark: SparkSession) -> DataFrame:
    """Ninety square regions: ``code, name, pref_code, feature_idx, geometry``."""
    rows = []
    for r in range(10):
        for c in range(9):
            y, x = 34.95 + 0.1 * r, 134.95 + 0.1 * c
            ring = [[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]
            rows.append((f"{1 + r // 2:02d}{9 * r + c:03d}", f"Region {r}-{c}", 1 + r // 2, 9 * r + c, [[ring]]))
    return spark.createDataFrame(rows, "code string, name string, pref_code int, feature_idx int, geometry array<array<array<array<double>>>>")


def prefectures(spark: SparkSession) -> DataFrame:
    """Five first-level regions and one that nobody visits."""
    return spark.createDataFrame([(i, f"Area {i}") for i in range(1, 7)], "code int, name string")


def zones(spark: SparkSession) -> DataFrame:
    """The exclusion zones."""
    # Of a size that the optimizer knows, so that no table is shuffled for them.
    rows = [F.struct(*[F.lit(v).cast("double").alias(n) for n, v in zip(("zone_lat", "zone_lng", "radius_m"), z)]) for z in ZONES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def frequent_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One home for every fifth subject."""
    u = _events(spark, sf_dir).select("user_id").distinct().where(F.col("user_id") % 5 == 0)
    return u.select(
        F.col("user_id").alias("subject_id"),
        F.lit("HOME").alias("label"),
        ((F.lit(350_000_000) + (F.col("user_id") % 10) * 1_000_000) / F.lit(1e7)).cast("double").alias("home_lat"),
        ((F.lit(1_350_000_000) + (F.col("user_id") % 7) * 1_000_000 + 120_000) / F.lit(1e7)).cast("double").alias("home_lng"),
    )


#: The same tables in SQL.
SQL = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS start_ms,
  CASE user_id % 3 WHEN 0 THEN 540 WHEN 1 THEN 0 ELSE -300 END AS off_min FROM events),
el AS (SELECT *, start_ms + off_min * 60000 AS loc, DATE '1970-01-01' + CAST(floor((start_ms + off_min * 60000) / 86400000.0) AS INT) AS d,
  (350000000 + (user_id % 10) * 1000000 + (k % 7) * 4000) / 1e7 AS lat, (1350000000 + (user_id % 7) * 1000000 + (k % 5) * 11000) / 1e7 AS lng FROM ev),
visits AS (SELECT user_id AS subject_id, event_id AS visit_idx, CASE WHEN k % 3 = 0 THEN 'pl-' || user_id || '-' || (k % 5) END AS place_id, lat, lng, start_ms,
  start_ms + CAST(floor(value * 60000) AS BIGINT) * (CASE WHEN k % 10 = 0 THEN 20 ELSE 1 END) AS end_ms, off_min, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
  CAST(d AS VARCHAR) AS date_str, CAST(1 + (user_id % 10) // 2 AS INT) AS pref_code,
  printf('%02d%03d', 1 + (user_id % 10) // 2, 9 * (user_id % 10) + user_id % 7) AS muni_code FROM el WHERE event_type IN ('view', 'signup')),
activities AS (SELECT user_id AS subject_id, event_id AS activity_idx,
  (['WALKING', 'CYCLING', 'RUNNING', 'IN_PASSENGER_VEHICLE', 'IN_TAXI', 'IN_BUS', 'IN_TRAIN', 'IN_SUBWAY', 'IN_TRAM', 'IN_FERRY', 'FLYING', 'IN_GONDOLA_LIFT', 'UNKNOWN'])[k % 13 + 1] AS mode,
  CAST(floor(value * 1000 + 0.5) AS BIGINT) AS distance_m, start_ms, start_ms + CAST(floor(value * 60000) AS BIGINT) AS end_ms, off_min, lat AS start_lat, lng AS start_lng,
  (350000000 + (user_id % 10) * 1000000 + ((k + 3) % 7) * 4000) / 1e7 AS end_lat, (1350000000 + (user_id % 7) * 1000000 + ((k + 3) % 5) * 11000) / 1e7 AS end_lng,
  CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(d AS VARCHAR) AS date_str, CAST(((loc % 86400000 + 86400000) % 86400000) // 3600000 AS INT) AS hour,
  CAST(extract(dow FROM d) AS INT) AS dow, k FROM el WHERE event_type = 'click'),
pp AS (SELECT *, (user_id + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 7 AS c FROM el WHERE event_type = 'error'),
path_points AS (SELECT user_id AS subject_id, event_id AS point_idx, lat, (1350000000 + c * 1000000 + (k % 5) * 11000) / 1e7 AS lng, start_ms AS t_ms, off_min,
  CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(d AS VARCHAR) AS date_str, CAST(1 + (user_id % 10) // 2 AS INT) AS pref_code,
  printf('%02d%03d', 1 + (user_id % 10) // 2, 9 * (user_id % 10) + c) AS muni_code, k FROM pp),
photos AS (SELECT user_id AS subject_id, event_id AS photo_idx, start_ms AS taken_ms, CASE WHEN k % 2 = 0 THEN lat END AS lat, CASE WHEN k % 2 = 0 THEN lng END AS lng,
  CASE WHEN k % 4 = 0 THEN 'exif' WHEN k % 2 = 0 THEN 'takeout' END AS source, off_min FROM el WHERE event_type = 'purchase'),
rpoints AS (SELECT * REPLACE (subject_id % 16 AS subject_id) FROM path_points),
ractivities AS (SELECT * REPLACE (subject_id % 16 AS subject_id, (['WALKING', 'IN_TRAIN', 'IN_BUS'])[k % 3 + 1] AS mode) FROM activities),
regions AS (SELECT printf('%02d%03d', 1 + r // 2, 9 * r + c) AS code, 'Region ' || r || '-' || c AS name, CAST(1 + r // 2 AS INT) AS pref_code, 9 * r + c AS feature_idx,
  134.95 + 0.1 * c AS x, 34.95 + 0.1 * r AS y FROM range(10) t(r), range(9) u(c)),
prefectures AS (SELECT CAST(i AS INT) AS code, 'Area ' || i AS name FROM range(1, 7) t(i)),
zones AS (SELECT * FROM (VALUES (35.0, 135.0, 60.0), (35.3, 135.3, 150.0), (35.7, 135.1, 3000.0)) z(zone_lat, zone_lng, radius_m)),
frequent_places AS (SELECT DISTINCT user_id AS subject_id, 'HOME' AS label, (350000000 + (user_id % 10) * 1000000) / 1e7 AS home_lat,
  (1350000000 + (user_id % 7) * 1000000 + 120000) / 1e7 AS home_lng FROM events WHERE user_id % 5 = 0)
"""

HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def metres(a: str, b: str, c: str, d: str) -> str:
    """SQL for the great-circle distance of (a, b) and (c, d)."""
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


def sql(body: str) -> str:
    """A statement over the canonical tables."""
    return f"WITH RECURSIVE {SQL}{body if body.lstrip().startswith(',') else ' ' + body}"
