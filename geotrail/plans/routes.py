"""Queries over routes, days, photos, search and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions import text as X
from geotrail.operators import days as D
from geotrail.operators import filters as L
from geotrail.operators import photos as H
from geotrail.operators import places as P
from geotrail.operators import routes as U
from geotrail.operators import search as S
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


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that loading a history makes once; kept in the shared folder for the file as it is."""
    return cached_result(spark, results_dir(spark), f"{file_key(spark, f'{sf_dir}/events.parquet')}-{name}", make)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.route_points(spark, sf_dir).select("subject_id", "point_idx", "t_ms", "lat", "lng")
    return _kept(spark, sf_dir, "modes", lambda: U.point_modes(points, T.route_activities(spark, sf_dir)))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "segments", lambda: U.run_segments(U.route_runs(_modes(spark, sf_dir))))


def _inside_zone(lat: str, lng: str) -> str:
    return f"EXISTS (SELECT 1 FROM zones z WHERE {metres(lat, lng, 'z.zone_lat', 'z.zone_lng')} <= z.radius_m)"


_PM = """, pm AS (SELECT p.*, b.activity_idx AS b_idx, CASE WHEN b.start_ms IS NOT NULL AND p.t_ms <= b.end_ms THEN b.mode
    WHEN f.start_ms IS NOT NULL AND (b.start_ms IS NULL OR f.start_ms - p.t_ms <= p.t_ms - b.start_ms) THEN f.mode ELSE coalesce(b.mode, 'UNKNOWN') END AS mode,
    CASE WHEN b.start_ms IS NOT NULL AND p.t_ms <= b.end_ms THEN b.activity_idx END AS inside_idx,
    CASE WHEN b.start_ms IS NOT NULL AND p.t_ms <= b.end_ms THEN 'inside' WHEN b.start_ms IS NOT NULL OR f.start_ms IS NOT NULL THEN 'nearest' ELSE 'none' END AS tier
    FROM rpoints p LEFT JOIN LATERAL (SELECT * FROM ractivities a WHERE a.subject_id = p.subject_id AND a.start_ms <= p.t_ms ORDER BY start_ms DESC, activity_idx DESC LIMIT 1) b ON true
    LEFT JOIN LATERAL (SELECT * FROM ractivities a WHERE a.subject_id = p.subject_id AND a.start_ms >= p.t_ms ORDER BY start_ms, activity_idx LIMIT 1) f ON true)"""
_RUN = (
    _PM
    + """, br AS (SELECT *, coalesce(mode <> lag(mode) OVER w OR t_ms - lag(t_ms) OVER w > 1200000, false) AS is_break FROM pm WINDOW w AS (PARTITION BY subject_id ORDER BY t_ms, point_idx)),
    rn AS (SELECT *, CAST(sum(is_break::INT) OVER (PARTITION BY subject_id ORDER BY t_ms, point_idx) AS BIGINT) AS run_no FROM br),
    rp AS (SELECT subject_id, run_no, mode, 0 AS shared, t_ms, point_idx, lat, lng FROM rn UNION ALL SELECT subject_id, run_no - 1, mode, 1, t_ms, point_idx, lat, lng FROM rn WHERE is_break),
    sg AS (SELECT subject_id, run_no, max(CASE WHEN shared = 0 THEN mode END) AS mode, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM rp GROUP BY 1, 2 HAVING count(*) >= 2)"""
)
_TRIM = (
    _RUN
    + f""", fl AS (SELECT r.*, s.mode AS seg_mode, s.n AS whole, {_inside_zone('r.lat', 'r.lng')} AS hidden FROM rp r JOIN sg s USING (subject_id, run_no)),
    pc AS (SELECT *, CAST(sum(hidden::INT) OVER (PARTITION BY subject_id, run_no ORDER BY t_ms, point_idx) AS BIGINT) AS piece FROM fl),
    ts AS (SELECT subject_id, run_no, piece, any_value(seg_mode) AS mode, count(*) <> any_value(whole) AS trimmed, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM pc WHERE NOT hidden
    GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
)
_VIS = (
    _TRIM
    + f""", tp AS (SELECT p.*, t.trimmed, t.start_ms AS s0, t.end_ms AS s1 FROM pc p JOIN ts t USING (subject_id, run_no, piece) WHERE NOT hidden),
    sn AS (SELECT a.activity_idx, p.run_no, p.piece, p.t_ms, p.lat, p.lng, lag(p.lat) OVER w AS la, lag(p.lng) OVER w AS ln, count(*) OVER (PARTITION BY a.activity_idx, p.run_no, p.piece) AS c
      FROM ractivities a JOIN tp p ON a.subject_id = p.subject_id AND p.s0 <= a.end_ms AND p.s1 >= a.start_ms AND p.t_ms BETWEEN a.start_ms AND a.end_ms
      WINDOW w AS (PARTITION BY a.activity_idx, p.run_no, p.piece ORDER BY p.t_ms, p.point_idx)),
    vs AS (SELECT activity_idx, min(t_ms) AS v0, max(t_ms) AS v1, coalesce(sum(CASE WHEN la IS NOT NULL THEN {metres('la', 'ln', 'lat', 'lng')} END), 0) AS v_m FROM sn WHERE c >= 2 GROUP BY 1),
    ct AS (SELECT a.activity_idx, bool_or(t.trimmed) AS cut FROM ractivities a JOIN ts t ON a.subject_id = t.subject_id AND t.start_ms <= a.end_ms AND t.end_ms >= a.start_ms GROUP BY 1),
    vm AS (SELECT a.*, v0, v1, v_m, {_inside_zone('a.start_lat', 'a.start_lng')} OR {_inside_zone('a.end_lat', 'a.end_lng')} OR coalesce(cut, false) AS partial FROM ractivities a
      LEFT JOIN vs USING (activity_idx) LEFT JOIN ct USING (activity_idx)),
    vis AS (SELECT subject_id, activity_idx, mode, date_str, partial, CASE WHEN partial THEN v0 ELSE start_ms END AS start_ms, CASE WHEN partial THEN v1 ELSE end_ms END AS end_ms,
      round(CASE WHEN partial THEN v_m ELSE CAST(distance_m AS DOUBLE) END, 3) AS distance_m, CASE WHEN partial THEN v0 - start_ms > 60000 ELSE false END AS start_cut,
      CASE WHEN partial THEN end_ms - v1 > 60000 ELSE false END AS end_cut FROM vm WHERE NOT partial OR v0 IS NOT NULL)"""
)
_DAY = (
    _VIS
    + f""", st AS (SELECT *, subject_id % 16 AS pool FROM visits v WHERE NOT {_inside_zone('v.lat', 'v.lng')}),
    dt0 AS (SELECT pool AS subject_id, date_str, 'stay' AS kind, visit_idx AS idx, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY pool, date_str ORDER BY start_ms, visit_idx) AS INT) AS stay_no,
      CAST(NULL AS DOUBLE) AS distance_m FROM st UNION ALL SELECT subject_id, date_str, 'move', activity_idx, start_ms, end_ms, NULL, distance_m FROM vis),
    dt AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, date_str ORDER BY start_ms, kind, idx) AS INT) AS position FROM dt0)"""
)


@query(_PM + " SELECT point_idx, mode, inside_idx, tier FROM pm")
def path_mode_asof(spark, sf_dir):
    return _modes(spark, sf_dir).select("point_idx", "mode", "inside_idx", "tier")


@query(_RUN + " SELECT subject_id, run_no, mode, CAST(n AS INT) AS points, start_ms, end_ms FROM sg")
def route_runs(spark, sf_dir):
    return _segments(spark, sf_dir).select("subject_id", "run_no", "mode", F.size("points").alias("points"), "start_ms", "end_ms")


@query(_PM + " SELECT activity_idx, mode, start_ms, end_ms FROM ractivities WHERE activity_idx NOT IN (SELECT inside_idx FROM pm WHERE inside_idx IS NOT NULL)")
def inferred_segments(spark, sf_dir):
    return U.inferred_segments(T.route_activities(spark, sf_dir), _modes(spark, sf_dir)).select("activity_idx", "mode", "start_ms", "end_ms")


@query(_TRIM + " SELECT subject_id, run_no, mode, trimmed, CAST(n AS INT) AS points, start_ms, end_ms FROM ts")
def zone_trimmed_segments(spark, sf_dir):
    return U.trimmed_segments(_segments(spark, sf_dir), T.zones(spark)).select("subject_id", "run_no", "mode", "trimmed", F.size("points").alias("points"), "start_ms", "end_ms")


def _visible(spark, sf_dir):
    return U.visible_moves(T.route_activities(spark, sf_dir), U.trimmed_segments(_segments(spark, sf_dir), T.zones(spark)), T.zones(spark))


@query(_VIS + " SELECT * FROM vis")
def visible_moves(spark, sf_dir):
    return _visible(spark, sf_dir)


def _timeline(spark, sf_dir):
    stays = L.exclude_zones(T.visits(spark, sf_dir), T.zones(spark)).withColumn("subject_id", F.col("subject_id") % T.ROUTE_SUBJECTS)
    return D.day_timeline(stays, _visible(spark, sf_dir))


@query(_DAY + " SELECT * FROM dt")
def day_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(
    _DAY
    + """ SELECT subject_id, date_str, round(coalesce(sum(CASE WHEN kind = 'move' THEN distance_m END), 0.0), 3) AS distance_m,
    CAST(coalesce(sum(CASE WHEN kind = 'move' THEN greatest(end_ms - start_ms, 0) END), 0) AS BIGINT) AS moving_ms, count(*) FILTER (kind = 'stay') AS stops FROM dt GROUP BY 1, 2"""
)
def day_summary(spark, sf_dir):
    return D.day_summary(_timeline(spark, sf_dir))


@query(_VIS + " SELECT subject_id, date_str, mode, round(sum(distance_m), 3) AS distance_m, count(*) AS moves FROM vis GROUP BY 1, 2, 3")
def day_modes(spark, sf_dir):
    return _visible(spark, sf_dir).groupBy("subject_id", "date_str", "mode").agg(F.round(F.sum("distance_m"), 3).alias("distance_m"), F.count("*").alias("moves"))


@query(
    """, n AS (SELECT date_str, count(*) AS n FROM visits GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY visit_idx) - 1 AS i, count(*) OVER () AS c FROM visits),
    k AS (SELECT DISTINCT CAST(floor(j * (SELECT count(*) FROM visits) / 100.0) AS BIGINT) AS i FROM range(100) t(j)) SELECT visit_idx FROM x WHERE c <= 100 OR i IN (SELECT i FROM k)"""
)
def even_sample(spark, sf_dir):
    return U.even_sample(T.visits(spark, sf_dir), "visit_idx", 100).select("visit_idx")


_SAMPLES = """, sm AS (SELECT subject_id, t_ms, point_idx * 4 AS o, lat, lng FROM path_points UNION ALL SELECT subject_id, start_ms, activity_idx * 4 + 1, start_lat, start_lng FROM activities
    UNION ALL SELECT subject_id, end_ms, activity_idx * 4 + 2, end_lat, end_lng FROM activities UNION ALL SELECT subject_id, start_ms, visit_idx * 4 + 3, lat, lng FROM visits)"""


@query(
    _SAMPLES
    + """ SELECT p.photo_idx, CASE WHEN inside THEN s.lat WHEN near THEN CASE WHEN later THEN f.lat ELSE b.lat END END AS lat,
    CASE WHEN inside THEN s.lng WHEN near THEN CASE WHEN later THEN f.lng ELSE b.lng END END AS lng, CASE WHEN inside THEN 0 WHEN near THEN gap END AS gap_ms,
    CASE WHEN inside THEN 'stay' WHEN near THEN 'nearest' ELSE 'unknown' END AS tier
    FROM photos p LEFT JOIN LATERAL (SELECT * FROM visits v WHERE v.subject_id = p.subject_id AND v.start_ms <= p.taken_ms ORDER BY start_ms DESC, visit_idx DESC LIMIT 1) s ON true
    LEFT JOIN LATERAL (SELECT * FROM sm WHERE sm.subject_id = p.subject_id AND sm.t_ms <= p.taken_ms ORDER BY t_ms DESC, o DESC LIMIT 1) b ON true
    LEFT JOIN LATERAL (SELECT * FROM sm WHERE sm.subject_id = p.subject_id AND sm.t_ms >= p.taken_ms ORDER BY t_ms, o LIMIT 1) f ON true
    , LATERAL (SELECT coalesce(p.taken_ms <= s.end_ms, false) AS inside, f.t_ms IS NOT NULL AND (b.t_ms IS NULL OR f.t_ms - p.taken_ms <= p.taken_ms - b.t_ms) AS later) q
    , LATERAL (SELECT CASE WHEN later THEN f.t_ms - p.taken_ms ELSE p.taken_ms - b.t_ms END AS gap) g, LATERAL (SELECT coalesce(gap <= 7200000, false) AS near) h WHERE p.lat IS NULL"""
)
def photo_estimates(spark, sf_dir):
    a, v, p = T.activities(spark, sf_dir), T.visits(spark, sf_dir), T.path_points(spark, sf_dir)
    pick = lambda df, t, o, la, ln: df.select("subject_id", F.col(t).alias("t_ms"), o.alias("order"), F.col(la).alias("lat"), F.col(ln).alias("lng"))
    samples = (
        pick(p, "t_ms", F.col("point_idx") * 4, "lat", "lng")
        .unionByName(pick(a, "start_ms", F.col("activity_idx") * 4 + 1, "start_lat", "start_lng"))
        .unionByName(pick(a, "end_ms", F.col("activity_idx") * 4 + 2, "end_lat", "end_lng"))
        .unionByName(pick(v, "start_ms", F.col("visit_idx") * 4 + 3, "lat", "lng"))
    )
    return H.estimate_places(T.photos(spark, sf_dir), v, samples)


@query(
    f"""SELECT photo_idx FROM photos p WHERE lat IS NOT NULL AND EXISTS (SELECT 1 FROM visits v WHERE v.subject_id = p.subject_id
    AND {metres('p.lat', 'p.lng', 'v.lat', 'v.lng')} <= 50)"""
)
def photos_for_place(spark, sf_dir):
    return H.photos_near_stays(T.photos(spark, sf_dir), T.visits(spark, sf_dir), 50.0).select("photo_idx")


@query("SELECT photo_idx, taken_ms FROM photos p WHERE NOT coalesce(" + _inside_zone("p.lat", "p.lng") + ", false) AND CAST(DATE '1970-01-01' + CAST(floor((taken_ms + 32400000) / 86400000.0) AS INT) AS VARCHAR) = '2024-01-10'")
def photos_for_day(spark, sf_dir):
    from geotrail.functions.calendar import date_text

    p = L.exclude_zones(T.photos(spark, sf_dir), T.zones(spark))
    return p.where(date_text(F.col("taken_ms")) == "2024-01-10").select("photo_idx", "taken_ms").orderBy("taken_ms")


@query(
    f""", ph AS (SELECT photo_idx, subject_id, lat + 0.00001 * (photo_idx % 3) AS lat, lng FROM photos WHERE lat IS NOT NULL), pins AS (SELECT subject_id, lat, lng, min(visit_idx) AS pin_id FROM visits
    GROUP BY 1, 2, 3), pr AS (SELECT p.photo_idx, p.lat, p.lng, q.lat AS pl, q.lng AS pn, {metres('p.lat', 'p.lng', 'q.lat', 'q.lng')} AS d, q.pin_id FROM ph p JOIN pins q ON p.subject_id = q.subject_id
    WHERE abs(p.lat - q.lat) < 0.001 AND abs(p.lng - q.lng) < 0.001), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY photo_idx ORDER BY round(d, 6), pin_id) AS n FROM pr WHERE d <= 15) WHERE n = 1)
    SELECT p.photo_idx, b.photo_idx IS NOT NULL AS nudged, round(CASE WHEN b.photo_idx IS NULL THEN p.lat ELSE degrees(asin(sin(radians(pl)) * cos(10 / 6371000.0) + cos(radians(pl)) * sin(10 / 6371000.0)
    * cos(turn))) END, 7) AS lat, round(CASE WHEN b.photo_idx IS NULL THEN p.lng ELSE pn + degrees(atan2(sin(turn) * sin(10 / 6371000.0) * cos(radians(pl)), cos(10 / 6371000.0) - sin(radians(pl))
    * (sin(radians(pl)) * cos(10 / 6371000.0) + cos(radians(pl)) * sin(10 / 6371000.0) * cos(turn)))) END, 7) AS lng
    FROM ph p LEFT JOIN (SELECT *, CASE WHEN round(d, 6) <= 0.5 THEN 0 ELSE atan2(b.lng - pn, b.lat - pl) END AS turn FROM b) b USING (photo_idx)"""
)
def photo_nudge(spark, sf_dir):
    ph = T.photos(spark, sf_dir).where("lat IS NOT NULL").withColumn("lat", F.col("lat") + 0.00001 * (F.col("photo_idx") % 3))
    pins = T.visits(spark, sf_dir).groupBy("subject_id", "lat", "lng").agg(F.min("visit_idx").alias("pin_id"))
    return P.nudge_photos(ph, pins).select("photo_idx", "nudged", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"))


@query("SELECT coalesce(source, 'none') AS source, count(*) AS n FROM photos GROUP BY 1")
def photo_summary(spark, sf_dir):
    return H.photo_summary(T.photos(spark, sf_dir))


_SIDE = """to_json({'geoData': {'latitude': CASE WHEN photo_idx % 5 = 0 THEN 0 ELSE lat END, 'longitude': CASE WHEN photo_idx % 5 = 0 THEN 0 ELSE lng END},
    'photoTakenTime': {'timestamp': CAST(taken_ms // 1000 AS VARCHAR)}})"""


@query(
    """, s AS (SELECT *, photo_idx % 11 = 0 AND lat IS NOT NULL AS ex, photo_idx % 7 <> 0 AND photo_idx % 5 <> 0 AND lat IS NOT NULL AS side FROM photos)
    SELECT photo_idx, CASE WHEN ex THEN lat + 0.001 WHEN side THEN lat END AS lat, CASE WHEN ex THEN lng + 0.001 WHEN side THEN lng END AS lng, CASE WHEN ex THEN 'exif' WHEN side THEN 'takeout' END AS source,
    CASE WHEN photo_idx % 13 = 0 THEN taken_ms - 5 WHEN photo_idx % 7 <> 0 THEN taken_ms // 1000 * 1000 ELSE taken_ms + 5 END AS taken_ms, photo_idx % 7 = 0 AND photo_idx % 13 <> 0 AS taken_is_fallback FROM s"""
)
def sidecar_records(spark, sf_dir):
    p = T.photos(spark, sf_dir)
    zero = lambda c: F.when(F.col("photo_idx") % 5 == 0, F.lit(0.0)).otherwise(F.col(c))
    body = F.to_json(
        F.struct(
            F.struct(zero("lat").alias("latitude"), zero("lng").alias("longitude")).alias("geoData"),
            F.struct(F.floor(F.col("taken_ms") / F.lit(1000)).cast("string").alias("timestamp")).alias("photoTakenTime"),
        )
    )
    p = p.withColumn("side", H.read_sidecar(F.when(F.col("photo_idx") % 7 == 0, F.lit("{broken")).otherwise(body)))
    # A camera wrote a place into every eleventh picture and (0, 0) into every twelfth, a time into every thirteenth.
    camera = lambda c: F.when(F.col("photo_idx") % 11 == 0, F.col(c) + 0.001).when(F.col("photo_idx") % 12 == 0, F.lit(0.0))
    p = p.withColumn("r", H.coalesce_record(camera("lat"), camera("lng"), F.when(F.col("photo_idx") % 13 == 0, F.col("taken_ms") - 5), F.col("side"), F.col("taken_ms") + 5))
    return p.select("photo_idx", "r.*")


@query(
    """, nm AS (SELECT photo_idx, subject_id AS dir, printf('IMG_%07d', photo_idx) AS base, printf('IMG_%07d', photo_idx) || '.jpg' AS name, photo_idx % 4 AS c FROM photos) SELECT photo_idx, CASE c WHEN 0 THEN name || '.json' WHEN 1 THEN base || '.json'
    WHEN 2 THEN base || '.jpg.sup.json' END AS sidecar FROM nm"""
)
def sidecar_match(spark, sf_dir):
    base, c = F.format_string("IMG_%07d", "photo_idx"), F.col("photo_idx") % 4
    p = T.photos(spark, sf_dir).select("photo_idx", F.col("subject_id").alias("dir"), F.concat(base, F.lit(".jpg")).alias("name"))
    names = F.when(c == 0, F.array(F.concat(base, F.lit(".jpg.json")), F.concat(base, F.lit(".json")))).when(c == 1, F.array(F.concat(base, F.lit(".json")), F.concat(base, F.lit(".jpg.sup.json"))))
    names = names.when(c == 2, F.array(F.concat(base, F.lit(".jpg.sup.json")), F.concat(base, F.lit(".jpg.supplement.json"))))
    files = p.select("dir", F.explode(names).alias("file"))
    return H.match_sidecars(p, files).select("photo_idx", "sidecar")


@query("SELECT photo_idx, CASE WHEN photo_idx % 3 = 0 THEN 'keep' ELSE 'read' END AS action FROM photos")
def photo_rescan(spark, sf_dir):
    found = T.photos(spark, sf_dir).select("photo_idx", F.col("photo_idx").cast("string").alias("path"), F.col("taken_ms").alias("mtime"))
    old = found.select("path", (F.col("mtime") + F.when(F.col("photo_idx") % 3 == 1, 1).otherwise(0)).alias("mtime")).where("CAST(path AS BIGINT) % 3 <> 2")
    return H.rescan(found, old).select("photo_idx", "action")


_CAND = """, cand AS (SELECT 'prefecture' AS kind, name AS label, code NOT IN (SELECT pref_code FROM visits) AS unvisited FROM prefectures UNION ALL
    SELECT 'municipality', name, code NOT IN (SELECT muni_code FROM visits) FROM regions UNION ALL SELECT DISTINCT 'day', date_str, false FROM visits)"""


def _candidates(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    named = lambda kind, dim, code, key: dim.select("name", F.col(code).alias("c")).join(v.select(F.col(key).alias("k")).distinct(), F.col("c") == F.col("k"), "left").select(F.lit(kind).alias("kind"), F.col("name").alias("label"), F.col("k").isNull().alias("unvisited"))
    days = v.select(F.lit("day").alias("kind"), F.col("date_str").alias("label"), F.lit(False).alias("unvisited")).distinct()
    return named("prefecture", T.prefectures(spark), "code", "pref_code").unionByName(named("municipality", T.regions(spark), "code", "muni_code")).unionByName(days)


@query(
    _CAND
    + """ SELECT kind, label, unvisited, CAST(score AS INT) AS score FROM (SELECT *, CASE WHEN starts_with(lower(label), 'region 1') THEN 0 WHEN contains(lower(label), 'region 1') THEN 1 END AS score FROM cand)
    WHERE score IS NOT NULL ORDER BY score, unvisited::INT, kind, label LIMIT 10"""
)
def search_prefix(spark, sf_dir):
    return S.search_text(_candidates(spark, sf_dir), "Region 1")


@query(
    _CAND
    + """ SELECT kind, label, unvisited, CAST(score AS INT) AS score FROM (SELECT *, CASE WHEN starts_with(label, '2024-01-1') THEN 0 WHEN contains(label, '2024-01-1') THEN 1 END AS score FROM cand)
    WHERE score IS NOT NULL ORDER BY score, label DESC LIMIT 10"""
)
def search_days(spark, sf_dir):
    return S.search_text(_candidates(spark, sf_dir), "2024-01-1")


@query(
    """, d AS (SELECT DISTINCT date_str FROM visits), q AS (SELECT * FROM (VALUES ('2024-1-5'), ('2024年1月7日'), ('2024.01'), ('２０２４'), ('1/6'), ('1999'), ('2024-13'), ('text')) t(query)),
    r AS (SELECT '2024-1-5' AS query, 'day' AS kind, '2024-01-05' AS label UNION ALL SELECT '2024年1月7日', 'day', '2024-01-07' UNION ALL SELECT '2024.01', 'period', '2024-01'
    UNION ALL SELECT '２０２４', 'period', '2024' UNION ALL SELECT '1/6', 'day', '2024-01-06') SELECT * FROM r WHERE kind = 'period' OR label IN (SELECT date_str FROM d)"""
)
def search_dates(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in ("2024-1-5", "2024年1月7日", "2024.01", "２０２４", "1/6", "1999", "2024-13", "text")], "query string")
    return S.search_dates(asked, T.visits(spark, sf_dir).select("date_str"))


@query("SELECT visit_idx, CASE WHEN place_id IS NOT NULL THEN 'place:' || place_id ELSE printf('coord:%.5f,%.5f', lat, lng) END AS cache_key FROM visits")
def label_keys(spark, sf_dir):
    return T.visits(spark, sf_dir).select("visit_idx", P.cache_key(F.col("place_id"), F.col("lat"), F.col("lng")).alias("cache_key"))


@query(
    """SELECT activity_idx, CASE WHEN distance_m < 1000 THEN distance_m || ' m' ELSE format('{:,.1f} km', distance_m / 1000.0 + CASE WHEN distance_m % 1000 = 250 THEN 0.01 ELSE 0 END) END AS how_far FROM activities"""
)
def distance_format(spark, sf_dir):
    return T.activities(spark, sf_dir).select("activity_idx", X.distance_text(F.col("distance_m")).alias("how_far"))


@query("SELECT event_id, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM events")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.escape_html(F.col("props")).alias("html"))
