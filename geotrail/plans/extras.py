"""Further questions of the views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.functions import text as X
from geotrail.operators import aggregates as A
from geotrail.operators import days as D
from geotrail.operators import filters as L
from geotrail.operators import photos as H
from geotrail.operators import places as P
from geotrail.operators import regions as R
from geotrail.plans import adapter as T
from geotrail.plans.adapter import metres, sql
from geotrail.plans.history import _CV, _DATE, _DWELL, _FIRST, _MUNI, _PREF, _RANK, _muni, clustered
from geotrail.plans.routes import _inside_zone
from geotrail.streaming.sessions import point_sessions

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL over the canonical tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


@query(_CV + _PREF + _MUNI + " SELECT (SELECT count(*) FROM pa WHERE stay_count > 0 OR first_ms IS NOT NULL) AS prefs, (SELECT count(*) FROM ma WHERE stay_count > 0) AS munis, (SELECT count(*) FROM ma WHERE pass_only) AS pass_only")
def visited_badges(spark, sf_dir):
    stays, points = clustered(spark, sf_dir), T.path_points(spark, sf_dir)
    return A.visited_badges(A.first_level_coverage(stays, points, T.prefectures(spark)), A.second_level_coverage(stays, points, T.regions(spark)))


@query(
    _CV
    + _MUNI
    + f""", d AS (SELECT pref_code, CAST(sum({_DWELL}) AS BIGINT) AS dwell_ms, count(*) AS n FROM visits GROUP BY 1) SELECT ma.pref_code, coalesce(any_value(dwell_ms), 0) AS dwell_ms,
    round(coalesce(any_value(dwell_ms / n), 0), 3) AS avg_dwell_ms, count(*) FILTER (stay_count > 0) AS visited, count(*) FILTER (pass_only) AS pass_only, count(*) AS total FROM ma LEFT JOIN d USING (pref_code) GROUP BY 1"""
)
def region_detail(spark, sf_dir):
    return A.region_detail(T.visits(spark, sf_dir), _muni(spark, sf_dir))


@query(
    _CV
    + f""" SELECT cluster_id, count(*) AS visits, CAST(sum({_DWELL}) AS BIGINT) AS dwell_ms, round(avg({_DWELL}), 3) AS avg_dwell_ms, count(DISTINCT date_str) AS days, min(date_str) AS first_day,
    max(date_str) AS last_day FROM cv GROUP BY 1"""
)
def place_detail(spark, sf_dir):
    return A.place_detail(clustered(spark, sf_dir))


@query(_CV + _MUNI + " SELECT muni_code, CASE WHEN pass_only THEN 'pass only' WHEN place_count = 1 THEN '1 place' WHEN place_count > 0 THEN place_count || ' places' ELSE 'unvisited' END AS note FROM ma")
def region_notes(spark, sf_dir):
    return A.region_notes(_muni(spark, sf_dir))


@query(
    _FIRST
    + f""", e AS (SELECT {_DATE} FROM (SELECT * FROM fp UNION ALL SELECT * FROM fm)) SELECT kind, code, date_str, coalesce(lag(substr(date_str, 1, 4)) OVER w <> substr(date_str, 1, 4), true) AS new_year,
    coalesce(lag(substr(date_str, 1, 7)) OVER w <> substr(date_str, 1, 7), true) AS new_month FROM e WINDOW w AS (ORDER BY first_ms, kind DESC, code)"""
)
def chronology_headings(spark, sf_dir):
    return A.with_headings(A.chronology(T.visits(spark, sf_dir), second_level=True))


@query(_CV + _RANK + " SELECT cluster_id, round(6 + least(10.0, 3 * ln(1 + visits)), 6) AS pin_px, round(2.5 + least(4.0, ln(1 + visits)), 6) AS dot_px FROM rk")
def marker_sizes(spark, sf_dir):
    return A.marker_sizes(A.place_ranking(clustered(spark, sf_dir), limit=None))


@query("SELECT visit_idx FROM visits WHERE pref_code = 1 AND muni_code = '01000' AND NOT (lat BETWEEN 34.95 AND 35.0004 AND lng BETWEEN 134.95 AND 135.0022)")
def island_visits(spark, sf_dir):
    # A region of two parts: the larger one holds only some of the lattice.
    box = lambda x0, y0, x1, y1: [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]
    shape = [("01000", [box(135.0023, 35.0005, 135.01, 35.01), box(134.95, 34.95, 135.0022, 35.0004)])]
    r = spark.createDataFrame(shape, "code string, geometry array<array<array<array<double>>>>")
    return R.on_islands(T.visits(spark, sf_dir), r).select("visit_idx")


_STATIONS = "st AS (SELECT DISTINCT 'S' || r.code AS name, r.y + 0.05 AS lat, r.x + 0.05 AS lng FROM regions r)"


@query(
    f""", {_STATIONS}, p AS (SELECT DISTINCT lat, lng FROM visits), q AS (SELECT p.lat || ',' || p.lng AS place_id, p.*, st.name, round({metres('p.lat', 'p.lng', 'st.lat', 'st.lng')}, 3) AS away_m FROM p, st
    WHERE abs(p.lat - st.lat) < 0.01 AND abs(p.lng - st.lng) < 0.01 AND {metres('p.lat', 'p.lng', 'st.lat', 'st.lng')} <= 250) SELECT lat, lng, name, away_m FROM q"""
)
def nearest_station(spark, sf_dir):
    s = T.regions(spark).select(F.concat(F.lit("S"), "code").alias("name"), (F.col("geometry")[0][0][0][1] + 0.05).alias("lat"), (F.col("geometry")[0][0][0][0] + 0.05).alias("lng"))
    p = T.visits(spark, sf_dir).select("lat", "lng").distinct().withColumn("place_id", F.struct("lat", "lng"))
    return P.nearest_station(p, s).select("place_id.lat", "place_id.lng", "name", "away_m")


@query(
    """SELECT DISTINCT cache_key FROM (SELECT visit_idx, CASE WHEN place_id IS NOT NULL THEN 'place:' || place_id ELSE printf('coord:%.5f,%.5f', lat, lng) END AS cache_key FROM visits)
    WHERE cache_key NOT IN (SELECT 'place:' || place_id FROM visits WHERE place_id IS NOT NULL AND visit_idx % 2 = 0)"""
)
def unlabelled_places(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    key = P.cache_key(F.col("place_id"), F.col("lat"), F.col("lng")).alias("cache_key")
    labels = v.where("place_id IS NOT NULL AND visit_idx % 2 = 0").select(key).distinct()
    return P.unlabelled(v.select(key).distinct(), labels)


@query("SELECT subject_id, arg_min(date_str, md5('7|' || subject_id || '|' || date_str) || date_str) AS date_str FROM (SELECT DISTINCT subject_id, date_str FROM visits) GROUP BY 1")
def random_day(spark, sf_dir):
    return D.random_day(D.day_counts(T.visits(spark, sf_dir)), 7)


@query(
    """SELECT DISTINCT mode, CASE mode WHEN 'IN_PASSENGER_VEHICLE' THEN 'Car' WHEN 'FLYING' THEN 'Plane' WHEN 'IN_GONDOLA_LIFT' THEN 'Gondola' ELSE upper(left(replace(mode, 'IN_', ''), 1)) ||
    lower(substr(replace(mode, 'IN_', ''), 2)) END AS name, CASE WHEN mode IN ('IN_TRAIN', 'IN_SUBWAY', 'IN_TRAM') THEN 'rail' WHEN mode IN ('WALKING', 'RUNNING') THEN 'dotted' ELSE 'solid' END AS pattern FROM activities"""
)
def mode_legend(spark, sf_dir):
    m = T.activities(spark, sf_dir).select("mode").distinct()
    return m.select("mode", X.mode_name(F.col("mode")).alias("name"), X.line_pattern(F.col("mode")).alias("pattern"))


@query(f"SELECT photo_idx FROM photos p WHERE lat IS NOT NULL AND NOT {_inside_zone('p.lat', 'p.lng')} AND month(DATE '1970-01-01' + CAST(floor((taken_ms + 32400000) / 86400000.0) AS INT)) = 1")
def photos_in_period(spark, sf_dir):
    from geotrail.functions.calendar import local_date

    p = T.photos(spark, sf_dir).where("lat IS NOT NULL").withColumn("month", F.month(local_date(F.col("taken_ms"))))
    return L.in_period(L.exclude_zones(p, T.zones(spark)), month=1).select("photo_idx")


@query(
    f""", g AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w >= 1200000 THEN 1 ELSE 0 END AS b FROM rpoints WINDOW w AS (PARTITION BY subject_id ORDER BY t_ms, point_idx)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY t_ms, point_idx) AS sess FROM g) SELECT subject_id, min(t_ms) AS start_ms, max(t_ms) + 1200000 AS end_ms, count(*) AS points,
    round({metres('min(lat)', 'min(lng)', 'max(lat)', 'max(lng)')}, 3) AS reach_m FROM s GROUP BY subject_id, sess"""
)
def path_sessions(spark, sf_dir):
    p = T.route_points(spark, sf_dir).withColumn("ts", F.timestamp_millis("t_ms"))
    return point_sessions(p).select("subject_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "points", "reach_m")


@query(
    _CV
    + f""" SELECT DISTINCT cv.cluster_id, p.photo_idx FROM photos p JOIN cv ON cv.subject_id = p.subject_id AND abs(p.lat - cv.lat) < 0.001
    AND {metres('p.lat', 'p.lng', 'cv.lat', 'cv.lng')} <= 50 WHERE p.lat IS NOT NULL"""
)
def photos_by_place(spark, sf_dir):
    return H.photos_by_place(T.photos(spark, sf_dir), clustered(spark, sf_dir), 50.0)
