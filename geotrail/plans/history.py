"""Queries over stays, moves and regions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions import calendar as C
from geotrail.functions import text as X
from geotrail.functions.coords import read_pair_prefix
from geotrail.operators import aggregates as A
from geotrail.operators import days as D
from geotrail.operators import filters as L
from geotrail.operators import places as P
from geotrail.operators import regions as R
from geotrail.operators.stays import numbered, stay_points
from geotrail.plans import adapter as T
from geotrail.plans.adapter import metres, sql
from geotrail.plans.tables import table
from geotrail.session import results_dir
from geotrail.sources.stores import cached_result, file_key

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL over the canonical tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def clustered(spark: SparkSession, sf_dir: str, threshold: float = 50.0) -> DataFrame:
    """Stays with their stay point; made once for a file as it is and a threshold, and kept in the shared folder for all questions."""
    key = f"{file_key(spark, f'{sf_dir}/events.parquet')}-{threshold:g}"
    return cached_result(spark, results_dir(spark), key, lambda: stay_points(T.visits(spark, sf_dir), threshold))


def _components(threshold: int) -> str:
    d = f"({threshold} / 111000.0 + 0.001)"
    return f""",
spots AS (SELECT subject_id, lat, lng, min(visit_idx) AS id FROM visits GROUP BY ALL),
named AS (SELECT DISTINCT v.subject_id, v.place_id, s.id FROM visits v JOIN spots s USING (subject_id, lat, lng) WHERE place_id IS NOT NULL),
links AS (SELECT a.id AS a, b.id AS b FROM spots a JOIN spots b ON a.subject_id = b.subject_id AND a.id <> b.id AND abs(a.lat - b.lat) <= {d} AND abs(a.lng - b.lng) <= {d}
  AND {metres('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= {threshold}
  UNION SELECT a.id, b.id FROM named a JOIN named b USING (subject_id, place_id) WHERE a.id <> b.id),
reach AS (SELECT id, id AS label FROM spots UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.id WHERE r.label < l.b),
labels AS (SELECT id, min(label) AS cluster_id FROM reach GROUP BY id),
cv AS (SELECT v.*, l.cluster_id FROM visits v JOIN spots s USING (subject_id, lat, lng) JOIN labels l ON l.id = s.id)"""


_DWELL = "greatest(least(coalesce(end_ms - start_ms, 0), 86400000), 0)"
_CV = _components(50)


@query("SELECT CAST(coalesce(sum(distance_m), 0) AS BIGINT) AS total_m, count(*) AS trips FROM activities")
def stats_total(spark, sf_dir):
    return A.travel_totals(T.activities(spark, sf_dir))


@query(
    """SELECT mode, CAST(sum(distance_m) AS BIGINT) AS distance_m, count(*) AS trips, CAST(sum(CASE WHEN end_ms >= start_ms THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS duration_ms,
    round(CASE WHEN sum(CASE WHEN end_ms >= start_ms THEN end_ms - start_ms ELSE 0 END) > 0
      THEN (sum(distance_m) / 1000.0) / (sum(CASE WHEN end_ms >= start_ms THEN end_ms - start_ms ELSE 0 END) / 3600000.0) END, 6) AS avg_speed_kmh FROM activities GROUP BY mode"""
)
def stats_by_mode(spark, sf_dir):
    return A.travel_by_mode(T.activities(spark, sf_dir))


@query("SELECT printf('%d-%02d', year, month) AS month_key, CAST(sum(distance_m) AS BIGINT) AS distance_m FROM activities GROUP BY ALL")
def stats_monthly(spark, sf_dir):
    return A.travel_monthly(T.activities(spark, sf_dir))


@query("SELECT printf('%d-%02d', year, month) AS month_key, mode, CAST(sum(distance_m) AS BIGINT) AS distance_m FROM activities GROUP BY ALL")
def stats_monthly_mode(spark, sf_dir):
    return A.travel_monthly(T.activities(spark, sf_dir), by_mode=True)


@query("SELECT round(coalesce(sum(distance_m) FILTER (mode = 'WALKING'), 0) / 1000.0 / 490.0, 6) AS walking_ratio FROM activities")
def walking_ratio(spark, sf_dir):
    return A.walking_ratio(T.activities(spark, sf_dir))


@query(
    """SELECT activity_idx, subject_id, mode, distance_m, r.name AS start_region, s.name AS end_region FROM (SELECT * FROM activities ORDER BY distance_m DESC, activity_idx LIMIT 10) a
    LEFT JOIN regions r ON a.start_lat >= r.y AND a.start_lat < r.y + 0.1 AND a.start_lng >= r.x AND a.start_lng < r.x + 0.1
    LEFT JOIN regions s ON a.end_lat >= s.y AND a.end_lat < s.y + 0.1 AND a.end_lng >= s.x AND a.end_lng < s.x + 0.1"""
)
def longest_trips(spark, sf_dir):
    top = A.longest_trips(T.activities(spark, sf_dir)).select("activity_idx", "subject_id", "mode", "distance_m", "start_lat", "start_lng", "end_lat", "end_lng")
    ends = [top.select("activity_idx", F.lit(e).alias("end"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lng").alias("lng")) for e in ("start", "end")]
    found = R.locate(ends[0].unionByName(ends[1]), T.regions(spark)).select("activity_idx", "end", "code")
    names = found.join(T.regions(spark).select("code", "name"), "code", "left").groupBy("activity_idx")
    named = names.agg(*[F.coalesce(F.max(F.when(F.col("end") == e, F.col("name"))), F.lit("Unknown")).alias(f"{e}_region") for e in ("start", "end")])
    return top.join(named, "activity_idx").select("activity_idx", "subject_id", "mode", "distance_m", "start_region", "end_region")


@query(
    """SELECT CAST(w.dow AS INT) AS dow, round(coalesce(m, 0.0), 3) AS mean_m FROM range(7) w(dow) LEFT JOIN (SELECT dow, avg(m) AS m FROM (SELECT subject_id, date_str, min(dow) AS dow, sum(distance_m) AS m
    FROM activities GROUP BY 1, 2) GROUP BY dow) d ON d.dow = w.dow"""
)
def day_of_week(spark, sf_dir):
    return A.day_of_week_means(T.activities(spark, sf_dir), spark.range(7).select(F.col("id").cast("int").alias("dow")))


@query("SELECT CAST(h.hour AS INT) AS hour, coalesce(n, 0) AS n FROM range(24) h(hour) LEFT JOIN (SELECT hour, count(*) AS n FROM activities GROUP BY hour) a ON a.hour = h.hour")
def hourly(spark, sf_dir):
    return A.hourly_histogram(T.activities(spark, sf_dir), spark.range(24).select(F.col("id").cast("int").alias("hour")))


@query("SELECT subject_id, date_str, CAST(sum(distance_m) AS BIGINT) AS distance_m, count(*) AS trips FROM activities GROUP BY 1, 2 ORDER BY distance_m DESC, date_str, subject_id LIMIT 5")
def top_days(spark, sf_dir):
    return A.top_days(T.activities(spark, sf_dir))


@query("SELECT count(*) FILTER (end_ms - start_ms > 86400000) AS capped, count(*) AS visits FROM visits")
def dwell_note(spark, sf_dir):
    return A.dwell_note(T.visits(spark, sf_dir))


_PREF = """, times AS (SELECT pref_code, start_ms AS t, 1 AS stay, cluster_id FROM cv UNION ALL SELECT pref_code, t_ms, 0, NULL FROM path_points),
pa AS (SELECT p.code AS pref_code, CAST(coalesce(sum(stay), 0) AS BIGINT) AS stay_count, count(DISTINCT cluster_id) AS place_count, min(t) AS first_ms, max(t) AS last_ms FROM prefectures p
  LEFT JOIN times t ON t.pref_code = p.code GROUP BY p.code)"""
_MUNI = """, ma AS (SELECT r.code AS muni_code, r.pref_code, coalesce(s.n, 0) AS stay_count, coalesce(s.places, 0) AS place_count, coalesce(p.n, 0) AS pass_count, s.first_ms, s.last_ms,
  coalesce(s.n, 0) = 0 AND coalesce(p.n, 0) > 0 AS pass_only FROM regions r
  LEFT JOIN (SELECT muni_code, count(*) AS n, count(DISTINCT cluster_id) AS places, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM cv GROUP BY 1) s ON s.muni_code = r.code
  LEFT JOIN (SELECT muni_code, count(*) AS n FROM path_points GROUP BY 1) p ON p.muni_code = r.code)"""


def _muni(spark, sf_dir):
    return A.second_level_coverage(clustered(spark, sf_dir), T.path_points(spark, sf_dir), T.regions(spark))


@query(_CV + _PREF + " SELECT * FROM pa")
def pref_agg(spark, sf_dir):
    return A.first_level_coverage(clustered(spark, sf_dir), T.path_points(spark, sf_dir), T.prefectures(spark))


@query(_CV + _MUNI + " SELECT * FROM ma")
def muni_agg(spark, sf_dir):
    return _muni(spark, sf_dir)


@query(
    _CV
    + _MUNI
    + """ SELECT pref_code, count(*) FILTER (stay_count > 0) AS visited, count(*) FILTER (pass_only) AS pass_only, count(*) AS total, round(count(*) FILTER (stay_count > 0) / count(*), 6) AS rate
    FROM ma GROUP BY pref_code"""
)
def conquest(spark, sf_dir):
    return A.visited_rates(_muni(spark, sf_dir))


@query(
    _CV
    + _MUNI
    + """ SELECT muni_code, CASE WHEN stay_count > 0 THEN 'heat' WHEN pass_only THEN 'pass_only' ELSE 'unvisited' END AS kind,
    round(CASE WHEN stay_count > 0 THEN ln(1 + place_count) / ln(1 + max(place_count) OVER ()) ELSE 0.0 END, 6) AS intensity FROM ma"""
)
def choropleth(spark, sf_dir):
    return A.heat(_muni(spark, sf_dir))


@query(_CV + _PREF + " SELECT pref_code, first_ms FROM pa WHERE year(DATE '1970-01-01' + CAST(floor((first_ms + 32400000) / 86400000.0) AS INT)) = 2024")
def newly_visited(spark, sf_dir):
    return A.newly_visited(pref_agg(spark, sf_dir), 2024)


_FIRST = """, fp AS (SELECT 'prefecture' AS kind, CAST(pref_code AS VARCHAR) AS code, start_ms AS first_ms, muni_code AS hint FROM
  (SELECT *, row_number() OVER (PARTITION BY pref_code ORDER BY start_ms, visit_idx) AS n FROM visits) WHERE n = 1),
fm AS (SELECT 'municipality' AS kind, muni_code AS code, min(start_ms) AS first_ms, CAST(NULL AS VARCHAR) AS hint FROM visits GROUP BY muni_code)"""
_DATE = "*, CAST(DATE '1970-01-01' + CAST(floor((first_ms + 32400000) / 86400000.0) AS INT) AS VARCHAR) AS date_str"


@query(_FIRST + f" SELECT {_DATE} FROM fp")
def chronology_pref(spark, sf_dir):
    return A.chronology(T.visits(spark, sf_dir), second_level=False)


@query(_FIRST + f" SELECT {_DATE} FROM (SELECT * FROM fp UNION ALL SELECT * FROM fm)")
def chronology_all(spark, sf_dir):
    return A.chronology(T.visits(spark, sf_dir), second_level=True)


def _assign(threshold):
    return _components(threshold) + " SELECT visit_idx, cluster_id, dense_rank() OVER (PARTITION BY subject_id ORDER BY cluster_id) - 1 AS cluster_no FROM cv"


def _assigned(spark, sf_dir, threshold):
    v = clustered(spark, sf_dir, threshold)
    return v.join(numbered(v), ["subject_id", "cluster_id"]).select("visit_idx", "cluster_id", "cluster_no")


@query(_assign(50))
def cluster_assign_50(spark, sf_dir):
    return _assigned(spark, sf_dir, 50.0)


@query(_assign(200))
def cluster_assign_200(spark, sf_dir):
    return _assigned(spark, sf_dir, 200.0)


_RANK = f""", rk AS (SELECT cluster_id, count(*) AS visits, CAST(sum({_DWELL}) AS BIGINT) AS dwell_ms, min(start_ms) AS first_ms, max(start_ms) AS last_ms, arg_min(lat, visit_idx) AS lat,
  arg_min(lng, visit_idx) AS lng, arg_min(muni_code, visit_idx) AS muni_code, min(visit_idx) AS first_idx, round(sum({_DWELL}) / count(*), 3) AS avg_dwell_ms FROM cv GROUP BY cluster_id)"""


@query(_CV + _RANK + " SELECT * FROM rk ORDER BY visits DESC, first_idx LIMIT 50")
def cluster_ranking_count(spark, sf_dir):
    return A.place_ranking(clustered(spark, sf_dir), "visits")


@query(_CV + _RANK + " SELECT * FROM rk ORDER BY dwell_ms DESC, first_idx LIMIT 50")
def cluster_ranking_dwell(spark, sf_dir):
    return A.place_ranking(clustered(spark, sf_dir), "dwell_ms")


_PRIVATE = "FROM visits v WHERE NOT EXISTS (SELECT 1 FROM frequent_places f WHERE f.subject_id = v.subject_id AND " + metres("v.lat", "v.lng", "f.home_lat", "f.home_lng") + " <= 1000)"


@query(f"SELECT muni_code, count(*) AS visits, CAST(sum({_DWELL}) AS BIGINT) AS dwell_ms, min(start_ms) AS first_ms, max(start_ms) AS last_ms {_PRIVATE} GROUP BY muni_code")
def cluster_ranking_privacy(spark, sf_dir):
    return A.region_ranking(L.apply_privacy(T.visits(spark, sf_dir), T.frequent_places(spark, sf_dir), [("lat", "lng")]))


@query(
    _CV
    + """, g AS (SELECT cluster_id, place_id, CASE WHEN place_id IS NULL THEN lat END AS a, CASE WHEN place_id IS NULL THEN lng END AS b, count(*) AS n, min(visit_idx) AS v, arg_min(lat, visit_idx) AS lat,
    arg_min(lng, visit_idx) AS lng FROM cv GROUP BY 1, 2, 3, 4) SELECT cluster_id, lat, lng, place_id FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (place_id IS NULL), n DESC, v) AS k FROM g) WHERE k = 1"""
)
def modal_location(spark, sf_dir):
    return A.modal_place(clustered(spark, sf_dir))


@query(
    _CV
    + f""", pl AS (SELECT subject_id, cluster_id, arg_min(lat, visit_idx) AS lat, arg_min(lng, visit_idx) AS lng FROM cv GROUP BY 1, 2),
    pr AS (SELECT a.subject_id, a.cluster_id, b.cluster_id AS near_id, round({metres('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 3) AS away_m FROM pl a JOIN pl b ON a.subject_id = b.subject_id
    AND a.cluster_id <> b.cluster_id) SELECT * FROM (SELECT subject_id, cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY away_m, near_id) AS INT) AS rank, near_id, away_m FROM pr)
    WHERE rank <= 5"""
)
def nearby_places(spark, sf_dir):
    first = F.min(F.struct("visit_idx", "lat", "lng")).alias("f")
    places = clustered(spark, sf_dir).groupBy("subject_id", "cluster_id").agg(first).select("subject_id", "cluster_id", "f.lat", "f.lng")
    return P.nearest_places(places)


@query("SELECT visit_idx " + _PRIVATE)
def privacy_visits(spark, sf_dir):
    return L.apply_privacy(T.visits(spark, sf_dir), T.frequent_places(spark, sf_dir), [("lat", "lng")]).select("visit_idx")


@query(
    f"""SELECT activity_idx FROM activities v WHERE NOT EXISTS (SELECT 1 FROM frequent_places f WHERE f.subject_id = v.subject_id AND ({metres('v.start_lat', 'v.start_lng', 'f.home_lat', 'f.home_lng')} <= 1000
    OR {metres('v.end_lat', 'v.end_lng', 'f.home_lat', 'f.home_lng')} <= 1000))"""
)
def privacy_activities(spark, sf_dir):
    return L.apply_privacy(T.activities(spark, sf_dir), T.frequent_places(spark, sf_dir), [("start_lat", "start_lng"), ("end_lat", "end_lng")]).select("activity_idx")


_OUT = f"NOT EXISTS (SELECT 1 FROM zones z WHERE {metres('v.lat', 'v.lng', 'z.zone_lat', 'z.zone_lng')} <= z.radius_m)"


@query(f"SELECT visit_idx FROM visits v WHERE {_OUT}")
def zone_visits(spark, sf_dir):
    return L.exclude_zones(T.visits(spark, sf_dir), T.zones(spark)).select("visit_idx")


@query(f"SELECT count(*) FILTER (NOT ({_OUT})) AS hidden, count(*) AS visits FROM visits v".replace("count(*) FILTER (NOT (", "CAST(sum(CASE WHEN ").replace(")) AS hidden", " THEN 0 ELSE 1 END) AS BIGINT) AS hidden"))
def zone_hidden_count(spark, sf_dir):
    v = L.flag_near(T.visits(spark, sf_dir), "lat", "lng", T.zones(spark), "zone_lat", "zone_lng", F.col("radius_m"), "hidden")
    return v.agg(F.count_if("hidden").alias("hidden"), F.count("*").alias("visits"))


@query("SELECT date_str, count(*) AS n FROM visits WHERE year = 2024 AND month = 1 GROUP BY date_str")
def period_year_month(spark, sf_dir):
    return L.in_period(T.visits(spark, sf_dir), 2024, 1).groupBy("date_str").agg(F.count("*").alias("n"))


@query("SELECT pref_code, count(*) AS n FROM visits WHERE year * 12 + month <= 2024 * 12 + 1 GROUP BY pref_code")
def cumulative_month(spark, sf_dir):
    return L.up_to_period(T.visits(spark, sf_dir), 2024, 1).groupBy("pref_code").agg(F.count("*").alias("n"))


@query(
    _CV
    + """, al AS (SELECT year * 12 + month - 1 AS m, pref_code, muni_code, cluster_id FROM cv UNION ALL SELECT year * 12 + month - 1, pref_code, NULL, NULL FROM path_points)
    SELECT CAST(m // 12 AS INT) AS year, CAST(m % 12 + 1 AS INT) AS month, (SELECT count(DISTINCT pref_code) FROM al x WHERE x.m <= k.m) AS pref_count,
    (SELECT count(DISTINCT muni_code) FROM al x WHERE x.m <= k.m) AS muni_count, (SELECT count(DISTINCT cluster_id) FROM al x WHERE x.m <= k.m) AS place_count FROM (SELECT DISTINCT m FROM al) k"""
)
def timelapse_frames(spark, sf_dir):
    return A.frames(clustered(spark, sf_dir), T.path_points(spark, sf_dir))


@query("SELECT event_id AS visit_idx, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(d AS VARCHAR) AS date_str, CAST(((loc % 86400000 + 86400000) % 86400000) // 3600000 AS INT) AS hour, CAST(extract(dow FROM d) AS INT) AS dow FROM el WHERE event_type IN ('view', 'signup')")
def local_parts(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    return v.select("visit_idx", *[c.alias(n) for n, c in C.local_parts(F.col("start_ms"), F.col("off_min")).items()])


@query(
    f"""SELECT visit_idx, m // 60 || 'h ' || m % 60 || 'min' AS dwell FROM (SELECT visit_idx, CAST(floor({_DWELL} / 60000.0 + 0.5) AS BIGINT) AS m FROM visits) WHERE m >= 60
    UNION ALL SELECT visit_idx, m || 'min' FROM (SELECT visit_idx, CAST(floor({_DWELL} / 60000.0 + 0.5) AS BIGINT) AS m FROM visits) WHERE m < 60"""
)
def dwell_format(spark, sf_dir):
    return T.visits(spark, sf_dir).select("visit_idx", X.duration_text(A.dwell_ms()).alias("dwell"))


@query(
    r""", t AS (SELECT segment_id, activity.start_loc.lat_lng AS s FROM timeline WHERE activity IS NOT NULL),
    n AS (SELECT segment_id, try_cast(nullif(regexp_extract(regexp_replace(split_part(s, ',', 1), '°', ''), '^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+))', 1), '') AS DOUBLE) AS lat,
    try_cast(nullif(regexp_extract(regexp_replace(split_part(s, ',', 2), '°', ''), '^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+))', 1), '') AS DOUBLE) AS lng FROM t WHERE len(string_split(s, ',')) = 2)
    SELECT segment_id, lat, lng FROM n WHERE lat IS NOT NULL AND lng IS NOT NULL"""
)
def parse_latlng(spark, sf_dir):
    t = table(spark, sf_dir, "timeline").where("activity IS NOT NULL").select("segment_id", F.col("activity.start_loc.lat_lng").alias("s"))
    return t.select("segment_id", read_pair_prefix(F.col("s")).alias("p")).select("segment_id", "p.lat", "p.lng").where("lat IS NOT NULL")


@query(
    """, sp AS (SELECT DISTINCT lat, lng FROM path_points) SELECT p.point_idx, r.code, coalesce(r.pref_code, 0) AS pref_code, CASE WHEN r.code IS NULL THEN 'none' ELSE 'inside' END AS how FROM path_points p
    LEFT JOIN regions r ON p.lat >= r.y AND p.lat < r.y + 0.1 AND p.lng >= r.x AND p.lng < r.x + 0.1"""
)
def locate_points(spark, sf_dir):
    return R.locate(T.path_points(spark, sf_dir).drop("pref_code", "muni_code"), T.regions(spark)).select("point_idx", "code", "pref_code", "how")


_AWAY = "sqrt(pow(greatest(r.x - p.x0, p.x0 - (r.x + 0.1), 0) * cos(radians(p.y0)) * 111320.0, 2) + pow(greatest(r.y - p.y0, p.y0 - (r.y + 0.1), 0) * 110540.0, 2))"


@query(
    f""", p AS (SELECT point_idx, lat + 0.9 + 0.01 * (k % 5) AS y0, lng AS x0 FROM path_points), c AS (SELECT point_idx, code, round({_AWAY}, 3) AS away_m,
    row_number() OVER (PARTITION BY point_idx ORDER BY round({_AWAY}, 6), -feature_idx) AS n FROM p, regions r WHERE {_AWAY} <= 3000) SELECT point_idx, code, away_m FROM c WHERE n = 1"""
)
def nearest_muni(spark, sf_dir):
    p = T.path_points(spark, sf_dir).select("point_idx", (F.col("lat") + 0.9 + 0.01 * (F.col("k") % 5)).alias("lat"), "lng")
    return R.locate(p, T.regions(spark)).where("how <> 'none'").select("point_idx", "code", "away_m")


@query(
    f""", pk AS (SELECT subject_id, NULL AS k FROM visits) , rk AS (SELECT subject_id, cluster_id, count(*) AS visits, arg_min(lat, visit_idx) AS lat, arg_min(lng, visit_idx) AS lng FROM cv GROUP BY 1, 2),
    h AS (SELECT subject_id, home_lat AS lat, home_lng AS lng FROM frequent_places), ho AS (SELECT * FROM h v WHERE {_OUT}),
    tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY visits DESC, cluster_id) AS n FROM rk) v WHERE n <= 10 AND {_OUT}
    AND NOT EXISTS (SELECT 1 FROM ho WHERE ho.subject_id = v.subject_id AND {metres('v.lat', 'v.lng', 'ho.lat', 'ho.lng')} <= 300))
    SELECT subject_id, 'HOME' AS kind, CAST(NULL AS BIGINT) AS cluster_id, lat, lng FROM ho UNION ALL SELECT subject_id, 'PLACE', cluster_id, lat, lng FROM tp""".join([_CV, ""])
)
def zone_suggestions(spark, sf_dir):
    first = F.min(F.struct("visit_idx", "lat", "lng")).alias("f")
    rank = clustered(spark, sf_dir).groupBy("subject_id", "cluster_id").agg(F.count("*").alias("visits"), first).select("subject_id", "cluster_id", "visits", "f.lat", "f.lng")
    return P.suggestions(T.frequent_places(spark, sf_dir), rank, T.zones(spark))


_MARKS = "mk AS (SELECT event_id AS mark_id, user_id AS subject_id, lat + 0.0007 AS lat, lng AS lng FROM el WHERE event_type = 'purchase' AND k % 2 = 0)"


@query(
    f""", {_MARKS}, pr AS (SELECT mark_id, visit_idx, {metres('v.lat', 'v.lng', 's.lat', 's.lng')} AS d FROM mk v JOIN visits s ON s.subject_id = v.subject_id AND abs(v.lat - s.lat) < 0.01
    AND abs(v.lng - s.lng) < 0.01 WHERE {_OUT} AND {metres('v.lat', 'v.lng', 's.lat', 's.lng')} <= 200)
    SELECT mark_id, visit_idx, round(round(d, 6), 3) AS away_m FROM mk LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY round(d, 6), visit_idx DESC) AS n FROM pr) USING (mark_id)
    WHERE coalesce(n, 1) = 1"""
)
def bookmark_resolve(spark, sf_dir):
    marks = T.photos(spark, sf_dir).where("lat IS NOT NULL").select(F.col("photo_idx").alias("mark_id"), "subject_id", (F.col("lat") + 0.0007).alias("anchor_lat"), F.col("lng").alias("anchor_lng"))
    return P.resolve_bookmarks(marks, T.visits(spark, sf_dir), T.zones(spark))


@query(_CV + " SELECT cluster_id, date_str, lag(date_str) OVER w AS prev_day, lead(date_str) OVER w AS next_day FROM (SELECT DISTINCT cluster_id, date_str FROM cv) WINDOW w AS (PARTITION BY cluster_id ORDER BY date_str)")
def prev_next_day(spark, sf_dir):
    return D.neighbour_days(clustered(spark, sf_dir))


def _every_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by day of stays, moves, path points and photos; photos by the date that ``photos_for_day`` goes by."""
    photos = T.photos(spark, sf_dir).withColumn("date_str", C.date_text(F.col("taken_ms")))
    return D.day_counts(T.visits(spark, sf_dir), T.activities(spark, sf_dir), T.path_points(spark, sf_dir), photos)


_ALL_DAYS = """, rd AS (SELECT subject_id, date_str FROM visits UNION ALL SELECT subject_id, date_str FROM activities UNION ALL SELECT subject_id, date_str FROM path_points UNION ALL
    SELECT subject_id, CAST(DATE '1970-01-01' + CAST(floor((taken_ms + 32400000) / 86400000.0) AS INT) AS VARCHAR) FROM photos)"""


@query(_ALL_DAYS + " SELECT subject_id, date_str, lag(date_str) OVER w AS prev_day, lead(date_str) OVER w AS next_day FROM (SELECT DISTINCT * FROM rd) WINDOW w AS (PARTITION BY subject_id ORDER BY date_str)")
def recorded_days(spark, sf_dir):
    return D.recorded_days(_every_day(spark, sf_dir))


@query(
    _ALL_DAYS
    + """, n AS (SELECT date_str, count(*) AS n FROM rd GROUP BY 1), g AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(d)),
    m AS (SELECT max(n) AS most FROM n WHERE date_str LIKE '2024-%')
    SELECT CAST(d AS VARCHAR) AS date_str, CAST((dayofyear(d) - 1 + extract(dow FROM DATE '2024-01-01')) // 7 + 1 AS INT) AS grid_col, CAST(extract(dow FROM d) + 1 AS INT) AS grid_row, coalesce(n, 0) AS n,
    CAST(CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN most <= 1 THEN 4 ELSE least(4, 1 + floor((n - 1) / (most - 1) * 4)) END AS INT) AS level FROM g LEFT JOIN n ON n.date_str = CAST(g.d AS VARCHAR), m"""
)
def calendar_levels(spark, sf_dir):
    return D.calendar_grid(_every_day(spark, sf_dir), 2024)


@query(
    _ALL_DAYS
    + """, x AS (SELECT subject_id, date_str, CAST(date_str AS DATE) - DATE '2024-01-15' AS diff FROM (SELECT DISTINCT * FROM rd)) SELECT subject_id, date_str, CAST(diff AS INT) AS days_off
    FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(diff), diff) AS n FROM x WHERE abs(diff) <= 7) WHERE n = 1"""
)
def anniversary(spark, sf_dir):
    return D.anniversary(_every_day(spark, sf_dir), "2025-01-15")


@query(_ALL_DAYS + " SELECT subject_id, date_str, count(*) AS n FROM rd GROUP BY 1, 2")
def day_record_counts(spark, sf_dir):
    return _every_day(spark, sf_dir)
