"""Queries over captions, choices and jumps of the views, real boundaries, and nested exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.functions import calendar as C
from geotrail.functions import text as X
from geotrail.functions.geo import bounds, contains, outline_contains, ring_area, ring_centre
from geotrail.operators import aggregates as A
from geotrail.operators import days as D
from geotrail.operators import filters as L
from geotrail.operators import photos as H
from geotrail.operators import places as P
from geotrail.operators import regions as R
from geotrail.operators import routes as U
from geotrail.operators import search as S
from geotrail.operators.shred import EXPORT, find_segments, shred
from geotrail.operators.stays import centres
from geotrail.plans import adapter as T
from geotrail.plans.adapter import metres, sql
from geotrail.plans.history import _CV, _DATE, _DWELL, _FIRST, _MUNI, _OUT, _muni, clustered
from geotrail.plans.routes import _CAND, _PM, _RUN, _candidates, _modes, _segments
from geotrail.plans.tables import table
from geotrail.sources import timeline
from geotrail.sources.schemas import TIMELINE

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL over the canonical tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


_TAKEN = "(DATE '1970-01-01' + CAST(floor((taken_ms + 32400000) / 86400000.0) AS INT))"


# ---- choices and captions -------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT CAST(y AS INT) AS year FROM (SELECT year AS y FROM visits UNION ALL SELECT year FROM path_points UNION ALL SELECT year{_TAKEN} FROM photos)")
def year_options(spark, sf_dir):
    taken = T.photos(spark, sf_dir).select(F.year(C.local_date(F.col("taken_ms"))).alias("year"))
    return D.year_options(T.visits(spark, sf_dir), T.path_points(spark, sf_dir), taken)


@query(", y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT year, coalesce(lag(year) OVER (ORDER BY year), nullif(max(year) OVER (), year)) AS other FROM y")
def comparison_years(spark, sf_dir):
    return D.comparison_years(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


@query("SELECT DISTINCT year, month, printf('%d-%02d', year, month) AS label FROM visits UNION ALL SELECT DISTINCT year, NULL, year::VARCHAR FROM visits UNION ALL SELECT NULL, NULL, 'All time'")
def period_labels(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    none = F.lit(None).cast("int").alias("month")
    periods = v.select("year", "month").distinct().unionByName(v.select("year", none).distinct()).unionByName(spark.range(1).select(none.alias("year"), none))
    return periods.select("year", "month", X.period_label(F.col("year"), F.col("month")).alias("label"))


@query("SELECT DISTINCT date_str, strftime(CAST(date_str AS DATE), '%a, %b %-d, %Y') AS title FROM visits")
def day_titles(spark, sf_dir):
    return T.visits(spark, sf_dir).select("date_str").distinct().select("date_str", X.date_title(F.col("date_str")).alias("title"))


@query(
    """, t AS (SELECT *, make_timestamp((taken_ms + off_min * 60000) * 1000) AS clock, photo_idx % 3 = 0 AS fallback, CASE WHEN source IS NULL THEN 'estimated' ELSE source END AS src, (photo_idx % 200) * 60000 AS gap,
    photo_idx % 200 AS m FROM photos)
    SELECT photo_idx, strftime(clock, '%Y/%-m/%-d %H:%M') || CASE WHEN fallback THEN ' (estimated from file creation time)' ELSE '' END AS taken,
    CASE src WHEN 'exif' THEN 'Location: Exif' WHEN 'takeout' THEN 'Location: Takeout' ELSE 'Location: estimated' || CASE WHEN gap <= 0 THEN '' WHEN m < 60 THEN ' (about ' || m || ' min from the nearest record)'
    ELSE ' (about ' || CAST(floor(m / 60.0 + 0.5) AS BIGINT) || ' h from the nearest record)' END END AS place, strftime(clock, '%Y/%-m/%-d') AS imported FROM t"""
)
def photo_captions(spark, sf_dir):
    p = T.photos(spark, sf_dir)
    gap = (F.col("photo_idx") % 200) * 60_000
    return p.select(
        "photo_idx",
        X.taken_text(F.col("taken_ms"), F.col("photo_idx") % 3 == 0, F.col("off_min")).alias("taken"),
        X.source_text(F.coalesce("source", F.lit("estimated")), gap).alias("place"),
        X.imported_text(F.col("taken_ms"), F.col("off_min")).alias("imported"),
    )


@query(
    """, n AS (SELECT event_id, CAST(floor(value * 100000) AS BIGINT) AS n FROM events)
    SELECT event_id, CASE WHEN n < 1048576 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM n"""
)
def size_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 100_000).cast("bigint").alias("n"))
    return e.select("event_id", X.size_text(F.col("n")).alias("size"))


@query(
    """, t AS (SELECT visit_idx, CAST(floor((((start_ms + off_min * 60000) % 86400000 + 86400000) % 86400000) / 60000.0) AS INT) AS m, CAST(floor((end_ms - start_ms) / 60000.0 + 0.5) AS BIGINT) AS g FROM visits)
    SELECT visit_idx, printf('%02d:%02d', m // 60, m % 60) AS clock, CASE WHEN g < 60 THEN g || ' min' ELSE CAST(floor(g / 60.0 + 0.5) AS BIGINT) || ' h' END AS gap FROM t"""
)
def clock_texts(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    return v.select("visit_idx", X.clock_text(F.col("start_ms"), F.col("off_min")).alias("clock"), X.gap_text(F.col("end_ms") - F.col("start_ms")).alias("gap"))


_LABELS = "lb AS (SELECT DISTINCT cluster_id, 'Spot ' || cluster_id AS label FROM cv WHERE cluster_id % 4 = 0)"


def _labels(stays):
    """Labels that a resolver gave some of the places."""
    return stays.where("cluster_id % 4 = 0").select("cluster_id", F.concat(F.lit("Spot "), F.col("cluster_id").cast("string")).alias("label")).distinct()


@query(_CV + f", {_LABELS} SELECT visit_idx, CASE WHEN label IS NOT NULL THEN label || ' (' || r.name || ')' ELSE r.name END AS name FROM cv LEFT JOIN lb USING (cluster_id) LEFT JOIN regions r ON r.code = cv.muni_code")
def named_stays(spark, sf_dir):
    v = clustered(spark, sf_dir)
    return P.named_stays(v, _labels(v), T.regions(spark))


@query("SELECT r.code, p.name || ' › ' || r.name AS path, r.name || ' in ' || p.name || ' {x}' AS said FROM regions r JOIN prefectures p ON p.code = r.pref_code")
def region_paths(spark, sf_dir):
    r = T.regions(spark).select("code", "name", "pref_code").join(T.prefectures(spark).select(F.col("code").alias("pc"), F.col("name").alias("pn")), F.col("pref_code") == F.col("pc"))
    return r.select("code", X.place_path(F.col("pn"), F.col("name")).alias("path"), X.filled(F.lit("{r} in {p} {x}"), r=F.col("name"), p=F.col("pn")).alias("said"))


@query("SELECT code, name, CASE WHEN code % 2 = 0 THEN 'Gebiet ' || code ELSE name END AS local_name FROM prefectures")
def local_names(spark, sf_dir):
    p = T.prefectures(spark)
    names = p.where("code % 2 = 0").select("code", F.lit("de").alias("language"), F.concat(F.lit("Gebiet "), F.col("code").cast("string")).alias("local_name"))
    return X.in_language(p, names, "code", "de")


@query(
    f""", mk AS (SELECT photo_idx, photo_idx % 5 AS k, CASE WHEN photo_idx % 7 = 0 THEN CAST({_TAKEN} AS VARCHAR) END AS day, photo_idx % 2 = 0 AS known FROM photos),
    l AS (SELECT *, CASE WHEN day IS NOT NULL THEN 'Day view: ' || day WHEN k = 0 THEN 'Japan' WHEN k = 1 THEN 'Area 3' ELSE 'Area 3 › Spot ' || k END AS label FROM mk)
    SELECT photo_idx AS mark_id, label, CASE WHEN known AND day IS NULL THEN label || ' (2024-01)' ELSE label END AS name FROM l"""
)
def page_labels(spark, sf_dir):
    k = F.col("photo_idx") % 5
    p = T.photos(spark, sf_dir).select("photo_idx", k.alias("k"), F.when(F.col("photo_idx") % 7 == 0, C.date_text(F.col("taken_ms"))).alias("day"), F.when(F.col("photo_idx") % 2 == 0, 2024).alias("year"))
    view = F.when(F.col("k") == 0, "national").when(F.col("k") == 1, "prefecture").otherwise("place")
    p = p.withColumn("label", X.entry_label(F.col("day"), view, F.lit("Area 3"), F.concat(F.lit("Spot "), F.col("k").cast("string"))))
    return p.select(F.col("photo_idx").alias("mark_id"), "label", X.bookmark_name(F.col("label"), F.col("day"), F.col("year"), F.lit(1)).alias("name"))


# ---- maps -----------------------------------------------------------------------------------------------------------


@query(
    _CV
    + _MUNI
    + """, t AS (SELECT *, round(CASE WHEN stay_count > 0 THEN ln(1 + place_count) / ln(1 + max(place_count) OVER ()) ELSE 0.0 END, 6) AS t FROM ma)
    SELECT muni_code, CASE WHEN stay_count > 0 THEN printf('rgb(%d, %d, %d)', CAST(floor(222 - 214 * t + 0.5) AS INT), CAST(floor(235 - 154 * t + 0.5) AS INT), CAST(floor(247 - 91 * t + 0.5) AS INT))
    WHEN pass_only THEN '#b9e2da' ELSE '#e0e0e0' END AS color FROM t"""
)
def fill_colors(spark, sf_dir):
    return A.fill_colors(_muni(spark, sf_dir))


@query(
    """SELECT DISTINCT mode, CASE mode WHEN 'WALKING' THEN '#008300' WHEN 'RUNNING' THEN '#006400' WHEN 'CYCLING' THEN '#4d8a00' WHEN 'IN_PASSENGER_VEHICLE' THEN '#c98500' WHEN 'IN_TAXI' THEN '#1f5aa8' WHEN 'IN_BUS' THEN '#2a78d6'
    WHEN 'IN_TRAIN' THEN '#e34948' WHEN 'IN_SUBWAY' THEN '#b62e2d' WHEN 'IN_TRAM' THEN '#d9534f' WHEN 'FLYING' THEN '#4a3aa7' WHEN 'IN_FERRY' THEN '#0e8a74' WHEN 'IN_GONDOLA_LIFT' THEN '#d55181' ELSE '#75736e' END AS color FROM activities"""
)
def mode_colors(spark, sf_dir):
    return T.activities(spark, sf_dir).select("mode").distinct().select("mode", X.mode_color(F.col("mode")).alias("color"))


@query(_RUN + " SELECT subject_id, run_no, mode, start_ms, end_ms FROM sg WHERE mode <> 'IN_BUS'")
def routes_without_buses(spark, sf_dir):
    return U.without_modes(_segments(spark, sf_dir), ("IN_BUS",)).select("subject_id", "run_no", "mode", "start_ms", "end_ms")


@query(
    _PM
    + """, br AS (SELECT *, coalesce(mode <> lag(mode) OVER w OR t_ms - lag(t_ms) OVER w > 1200000, false) AS is_break FROM pm WINDOW w AS (PARTITION BY subject_id ORDER BY point_idx)),
    rn AS (SELECT *, CAST(sum(is_break::INT) OVER (PARTITION BY subject_id ORDER BY point_idx) AS BIGINT) AS run_no FROM br),
    rp AS (SELECT subject_id, run_no, mode, 0 AS shared, t_ms, point_idx FROM rn UNION ALL SELECT subject_id, run_no - 1, mode, 1, t_ms, point_idx FROM rn WHERE is_break)
    SELECT subject_id, run_no, max(CASE WHEN shared = 0 THEN mode END) AS mode, CAST(count(*) AS INT) AS points, arg_min(t_ms, point_idx) AS start_ms, arg_max(t_ms, point_idx) AS end_ms FROM rp GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def route_runs_as_recorded(spark, sf_dir):
    s = U.run_segments(U.route_runs(_modes(spark, sf_dir), "point_idx"), "point_idx")
    return s.select("subject_id", "run_no", "mode", F.size("points").alias("points"), "start_ms", "end_ms")


@query(
    f"""{_MUNI.replace('cv', 'visits').replace('count(DISTINCT cluster_id)', '0')}, sh AS (SELECT muni_code, count(*) AS visits, CAST(sum({_DWELL}) AS BIGINT) AS dwell_ms, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM visits v WHERE {_OUT} GROUP BY 1)
    SELECT muni_code, coalesce(visits, 0) AS visits, coalesce(sh.dwell_ms, 0) AS dwell_ms, sh.first_ms, sh.last_ms, CASE WHEN visits > 0 THEN 'shown' WHEN stay_count > 0 THEN 'all excluded' WHEN pass_only THEN 'pass only' ELSE 'none' END AS note
    FROM ma LEFT JOIN sh USING (muni_code)"""
)
def region_summaries(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    coverage = A.second_level_coverage(v.withColumn("cluster_id", F.lit(0)), T.path_points(spark, sf_dir), T.regions(spark))
    return A.region_summaries(coverage, L.exclude_zones(v, T.zones(spark)))


@query("SELECT photo_idx, taken_ms FROM photos WHERE lat IS NOT NULL ORDER BY taken_ms, photo_idx LIMIT 80")
def photo_gallery(spark, sf_dir):
    return H.gallery(T.photos(spark, sf_dir).where("lat IS NOT NULL").select("photo_idx", "taken_ms"))


@query("SELECT photo_idx, CASE WHEN photo_idx % 4 = 0 THEN 'add' ELSE 'remove' END AS action FROM photos WHERE (photo_idx % 4 = 0) <> (photo_idx % 3 = 0)")
def photo_pin_changes(spark, sf_dir):
    p = T.photos(spark, sf_dir).select("photo_idx")
    return H.pin_changes(p.where("photo_idx % 3 = 0"), p.where("photo_idx % 4 = 0"))


# ---- places and regions ---------------------------------------------------------------------------------------------


@query("SELECT p.photo_idx, r.name FROM photos p LEFT JOIN regions r ON p.lat >= r.y AND p.lat < r.y + 0.1 AND p.lng >= r.x AND p.lng < r.x + 0.1 WHERE p.lat IS NOT NULL")
def photo_regions(spark, sf_dir):
    found = R.first_outline(T.photos(spark, sf_dir).where("lat IS NOT NULL").select("photo_idx", "lat", "lng"), T.regions(spark))
    return found.join(T.regions(spark).select("code", "name"), "code", "left").select("photo_idx", "name")


_FAR = ", q AS (SELECT point_idx, lat + 0.2 * (point_idx % 9) - 0.3993 AS y0, lng + 0.15 * (point_idx % 7) - 0.2993 AS x0 FROM path_points)"
_NEAREST = "sqrt(pow(greatest(r.x - q.x0, q.x0 - (r.x + 0.1), 0) * cos(radians(q.y0)) * 111320.0, 2) + pow(greatest(r.y - q.y0, q.y0 - (r.y + 0.1), 0) * 110540.0, 2))"


@query(
    _FAR
    + f""", c AS (SELECT point_idx, code, pref_code, round({_NEAREST}, 6) AS d, feature_idx FROM q, regions r WHERE {_NEAREST} <= 3000),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_idx ORDER BY d, CASE WHEN d = 0 THEN feature_idx ELSE -feature_idx END) AS n FROM c) WHERE n = 1),
    pf AS (SELECT CAST(k AS INT) AS code, 34.45 + 0.3 * k AS y, 134.45 AS x FROM range(1, 6) t(k))
    SELECT q.point_idx, b.code, CAST(coalesce(b.pref_code, (SELECT min(code) FROM pf WHERE y0 BETWEEN y AND y + 0.3 AND x0 BETWEEN x AND x + 2.0), 0) AS INT) AS pref_code,
    CASE WHEN d = 0 THEN 'inside' WHEN d > 0 THEN 'nearest' WHEN EXISTS (SELECT 1 FROM pf WHERE y0 BETWEEN y AND y + 0.3 AND x0 BETWEEN x AND x + 2.0) THEN 'prefecture' ELSE 'none' END AS how FROM q LEFT JOIN b USING (point_idx)"""
)
def locate_cascade(spark, sf_dir):
    q = T.path_points(spark, sf_dir).select("point_idx", (F.col("lat") + 0.2 * (F.col("point_idx") % 9) - 0.3993).alias("lat"), (F.col("lng") + 0.15 * (F.col("point_idx") % 7) - 0.2993).alias("lng"))
    rows = []
    for k in range(1, 6):
        y, x = 34.45 + 0.3 * k, 134.45
        rows.append((k, k, [[[[x, y], [x + 2.0, y], [x + 2.0, y + 0.3], [x, y + 0.3], [x, y]]]]))
    shapes = spark.createDataFrame(rows, "code int, feature_idx int, geometry array<array<array<array<double>>>>")
    return R.locate(q, T.regions(spark), prefectures=shapes).select("point_idx", "code", "pref_code", "how")


_RINGS = """, po AS (SELECT code, name, feature_idx, polygon, n FROM (SELECT code, name, feature_idx, unnest(geometry) AS polygon, generate_subscripts(geometry, 1) AS n FROM municipalities)),
    ri AS (SELECT code, n, m, ring FROM (SELECT code, n, unnest(polygon) AS ring, generate_subscripts(polygon, 1) AS m FROM po)),
    pt AS (SELECT code, n, m, k, p[1] AS x, p[2] AS y FROM (SELECT code, n, m, unnest(ring) AS p, generate_subscripts(ring, 1) AS k FROM ri))"""


@query(
    _RINGS
    + """, bx AS (SELECT code, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY 1),
    ar AS (SELECT code, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM (SELECT code, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pt WHERE n = 1 AND m = 1
      WINDOW w AS (PARTITION BY code ORDER BY k)) GROUP BY 1),
    lg AS (SELECT code, n, m, row_number() OVER (PARTITION BY code ORDER BY len(ring) DESC, n, m) AS r FROM ri), ce AS (SELECT pt.code, avg(y) AS lat, avg(x) AS lng FROM pt JOIN lg USING (code, n, m) WHERE r = 1 GROUP BY 1)
    SELECT code, round(area, 9) AS area, round(lat, 6) AS lat, round(lng, 6) AS lng, x0 AS west, x1 AS east, y0 AS south, y1 AS north FROM bx JOIN ar USING (code) JOIN ce USING (code)"""
)
def boundary_shapes(spark, sf_dir):
    m = table(spark, sf_dir, "municipalities").select("code", "geometry", bounds(F.col("geometry")).alias("b"), ring_centre(F.col("geometry")).alias("c"))
    return m.select("code", F.round(ring_area(F.col("geometry")[0][0]), 9).alias("area"), F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"), F.col("b.min_lng").alias("west"), F.col("b.max_lng").alias("east"), F.col("b.min_lat").alias("south"), F.col("b.max_lat").alias("north"))


@query(
    _RINGS
    + """, lg AS (SELECT code, n, m, row_number() OVER (PARTITION BY code ORDER BY len(ring) DESC, n, m) AS r FROM ri), ce AS (SELECT pt.code, avg(y) AS lat, avg(x) AS lng FROM pt JOIN lg USING (code, n, m) WHERE r = 1 GROUP BY 1),
    ed AS (SELECT code, m, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pt WINDOW w AS (PARTITION BY code, n, m ORDER BY k)),
    cr AS (SELECT code, m, (y1 > lat) <> (y2 > lat) AND (((x2 - x1) * (lat - y1) - (lng - x1) * (y2 - y1)) > 0) = (y2 > y1) AS crosses FROM ce JOIN ed USING (code))
    SELECT code, count(*) FILTER (crosses) % 2 = 1 AS holds, count(*) FILTER (crosses AND m = 1) % 2 = 1 AS outlined FROM cr GROUP BY 1"""
)
def boundary_centres(spark, sf_dir):
    m = table(spark, sf_dir, "municipalities").select("code", "geometry", ring_centre(F.col("geometry")).alias("c"))
    return m.select("code", contains(F.col("geometry"), F.col("c.lat"), F.col("c.lng")).alias("holds"), outline_contains(F.col("geometry"), F.col("c.lat"), F.col("c.lng")).alias("outlined"))


@query(_RINGS + ", bx AS (SELECT code, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY 1) SELECT code FROM bx WHERE x1 >= 135.0 - 0.5 AND x0 <= 137.0 + 0.5 AND y1 >= 34.0 - 0.375 AND y0 <= 35.5 + 0.375")
def boundaries_in_view(spark, sf_dir):
    return R.in_view(table(spark, sf_dir, "municipalities"), 135.0, 34.0, 137.0, 35.5).select("code")


@query("SELECT code, 'Reg' || name AS name, CAST(sum(len(geometry)) AS INT) AS polygons FROM municipalities WHERE len(geometry) > 0 GROUP BY 1, 2")
def boundary_merge(spark, sf_dir):
    m = table(spark, sf_dir, "municipalities").select("code", "name", F.explode("geometry").alias("p"))
    # Every polygon as a record of a regional file of its own, and the unnamed parts between them.
    parts = m.select("code", F.lit("Reg").alias("county"), "name", F.array("p").alias("polygons")).unionByName(m.select(F.lit("").alias("code"), F.lit(None).cast("string").alias("county"), "name", F.array("p").alias("polygons")))
    return R.merge_boundary_parts(parts).select("code", "name", F.size("geometry").alias("polygons"))


@query(
    _RINGS
    + f""", lg AS (SELECT code, n, m, row_number() OVER (PARTITION BY code ORDER BY len(ring) DESC, n, m) AS r FROM ri), ce AS (SELECT pt.code, avg(y) AS lat, avg(x) AS lng FROM pt JOIN lg USING (code, n, m) WHERE r = 1 GROUP BY 1)
    SELECT code, round({metres('35.4', '136.2', 'lat', 'lng')}, 3) AS away_m FROM ce ORDER BY 2, 1 LIMIT 1"""
)
def nearest_centre(spark, sf_dir):
    m = table(spark, sf_dir, "municipalities").select("code", ring_centre(F.col("geometry")).alias("c")).select("code", "c.lat", "c.lng")
    return R.nearest_centre(35.4, 136.2, m).select("code", "away_m")


# ---- names from answers ---------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    """Answers of a reverse geocoder, one for each event."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (F.col("k") % n + 1).cast("int"))
    name = pick(5, "Cafe Ume", "City Hall", "中央駅改札口", "", None)
    category, kind = pick(3, "amenity", "shop", "railway"), pick(4, "cafe", "townhall", "clinic", "platform")
    keys = F.array(F.lit("mall"), F.lit("building"), F.lit("suburb"), F.lit("road"))
    on = F.array(F.when(F.col("k") % 7 == 0, "Great Mall"), F.when(F.col("k") % 11 == 0, "Tower"), F.when(F.col("k") % 2 == 0, "North"), F.when(F.col("k") % 3 == 0, "地下通路").otherwise("Main St"))
    address = F.map_filter(F.map_from_arrays(keys, on), lambda _, v: v.isNotNull())
    return e.select("event_id", name.alias("name"), category.alias("category"), kind.alias("kind"), address.alias("address"), F.when(F.col("k") % 13 != 0, F.concat(F.lit("Spot "), F.col("k").cast("string"), F.lit(", Town"))).alias("display"))


@query(
    """, a AS (SELECT event_id, k, (['Cafe Ume', 'City Hall', '中央駅改札口', NULL, NULL])[k % 5 + 1] AS own, k % 5 = 2 AS sign, (['amenity', 'shop', 'railway'])[k % 3 + 1] AS category, (['cafe', 'townhall', 'clinic', 'platform'])[k % 4 + 1] AS kind,
    CASE WHEN k % 7 = 0 THEN 'Great Mall' WHEN k % 11 = 0 THEN 'Tower' END AS around, CASE WHEN k % 2 = 0 THEN 'North' END AS area, CASE WHEN k % 3 <> 0 THEN 'Main St' END AS road, CASE WHEN k % 13 <> 0 THEN 'Spot ' || k END AS first FROM el),
    b AS (SELECT *, category = 'shop' OR (category = 'amenity' AND kind IN ('cafe', 'clinic')) AS sub FROM a)
    SELECT event_id, CASE WHEN (sub OR sign) AND around IS NOT NULL THEN around WHEN own IS NOT NULL AND NOT sign THEN own WHEN around IS NOT NULL THEN around ELSE coalesce(area, road, first) END AS label,
    CASE WHEN (sub OR sign) AND around IS NOT NULL THEN true WHEN own IS NOT NULL AND NOT sign THEN NOT sub ELSE around IS NOT NULL END AS confident FROM b"""
)
def label_extract(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("event_id", P.place_name(F.col("name"), F.col("category"), F.col("kind"), F.col("address"), F.col("display")).alias("p")).select("event_id", "p.*")


@query(
    """, a AS (SELECT event_id, k % 2 = 0 AS park, k % 3 = 0 AS hall, k % 5 = 0 AS ward FROM el)
    SELECT event_id, CASE WHEN hall THEN 'Hall ' || event_id WHEN park AND NOT ward THEN 'Park ' || event_id END AS name FROM a"""
)
def landmark_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    tags = lambda **t: F.map_from_entries(F.array(*[F.struct(F.lit(k), v if not isinstance(v, str) else F.lit(v)) for k, v in t.items()]))
    named = lambda what: F.concat(F.lit(f"{what} "), F.col("event_id").cast("string"))
    element = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("tags"))
    park = F.when(F.col("k") % 2 == 0, element("area", F.when(F.col("k") % 5 == 0, tags(name=named("Ward"), leisure="park", boundary="x")).otherwise(tags(name=named("Park"), leisure="park"))))
    hall = F.when(F.col("k") % 3 == 0, element("area", tags(name=named("Hall"), building="yes")))
    return e.select("event_id", P.landmark(F.filter(F.array(element("node", tags(name=named("Kiosk"), shop="yes")), element("area", tags(shop="yes")), park, hall), lambda x: x.isNotNull())).alias("name"))


_MODAL = """, g AS (SELECT cluster_id, place_id, CASE WHEN place_id IS NULL THEN lat END AS a, CASE WHEN place_id IS NULL THEN lng END AS b, count(*) AS n, min(visit_idx) AS v, arg_min(lat, visit_idx) AS lat,
    arg_min(lng, visit_idx) AS lng FROM cv GROUP BY 1, 2, 3, 4), md AS (SELECT cluster_id, CASE WHEN place_id IS NOT NULL THEN 'place:' || place_id ELSE printf('coord:%.5f,%.5f', lat, lng) END AS cache_key FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (place_id IS NULL), n DESC, v) AS k FROM g) WHERE k = 1)"""


@query(_CV + _MODAL + " SELECT cluster_id, cache_key, CASE WHEN cache_key LIKE 'place:%-1' THEN 'Known ' || cache_key END AS label FROM md")
def cached_place_labels(spark, sf_dir):
    from geotrail.sources.stores import cached_labels

    keyed = P.with_cache_key(A.modal_place(clustered(spark, sf_dir)))
    cache = keyed.where("cache_key LIKE 'place:%-1'").select("cache_key", F.concat(F.lit("Known "), "cache_key").alias("label")).distinct()
    return cached_labels(keyed.select("cluster_id", "cache_key"), cache)


@query(_CV + _MODAL + " SELECT DISTINCT md.cluster_id, md.cache_key FROM cv JOIN md USING (cluster_id) WHERE cv.date_str = '2024-01-10' AND NOT (cache_key LIKE 'place:%-1')")
def labels_to_fetch(spark, sf_dir):
    v = clustered(spark, sf_dir)
    keyed = P.with_cache_key(A.modal_place(v))
    cache = keyed.where("cache_key LIKE 'place:%-1'").select("cache_key").distinct()
    today = v.where("date_str = '2024-01-10'").select("cluster_id").distinct()
    return P.unlabelled(keyed.join(today, "cluster_id", "left_semi").select("cluster_id", "cache_key"), cache)


@query(_CV + " SELECT cluster_id, round(avg(lat), 7) AS lat, round(avg(lng), 7) AS lng, count(*) AS stays FROM cv GROUP BY 1")
def cluster_centres(spark, sf_dir):
    return centres(clustered(spark, sf_dir)).select("cluster_id", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), "stays")


@query(
    f""", st AS (SELECT DISTINCT 'S' || r.code AS name, r.y + 0.05 AS lat, r.x + 0.05 AS lng FROM regions r), p AS (SELECT visit_idx, lat, lng, visit_idx % 4 = 0 AS held FROM visits),
    q AS (SELECT p.visit_idx, arg_min(st.name, (round({metres('p.lat', 'p.lng', 'st.lat', 'st.lng')}, 3), st.name)) AS name FROM p JOIN st ON abs(p.lat - st.lat) < 0.01 AND abs(p.lng - st.lng) < 0.01
      WHERE {metres('p.lat', 'p.lng', 'st.lat', 'st.lng')} <= 250 GROUP BY 1)
    SELECT visit_idx AS place_id, CASE WHEN held THEN 'Hall ' || visit_idx ELSE q.name END AS name, CASE WHEN held THEN 'area' WHEN q.name IS NOT NULL THEN 'station' ELSE 'none' END AS how FROM p LEFT JOIN q USING (visit_idx)"""
)
def landmark_cascade(spark, sf_dir):
    v = T.visits(spark, sf_dir).select(F.col("visit_idx").alias("place_id"), "lat", "lng")
    stations = T.regions(spark).select(F.concat(F.lit("S"), "code").alias("name"), (F.col("geometry")[0][0][0][1] + 0.05).alias("lat"), (F.col("geometry")[0][0][0][0] + 0.05).alias("lng"))
    tags = F.create_map(F.lit("name"), F.concat(F.lit("Hall "), F.col("place_id").cast("string")), F.lit("building"), F.lit("yes"))
    answers = v.where("place_id % 4 = 0").select("place_id", F.array(F.struct(F.lit("area").alias("type"), tags.alias("tags"))).alias("elements"))
    return P.landmark_or_station(v, answers, stations)


# ---- jumps ----------------------------------------------------------------------------------------------------------


_EVENTS = f"e AS (SELECT {_DATE} FROM (SELECT * FROM fp UNION ALL SELECT * FROM fm))"


@query(
    _CV
    + _FIRST
    + f""", {_EVENTS}, fs AS (SELECT muni_code, arg_min(cluster_id, (start_ms, visit_idx)) AS c FROM cv v WHERE {_OUT} GROUP BY 1)
    SELECT kind, e.code, coalesce(CAST(r.pref_code AS VARCHAR), e.code) AS pref_code, fs.c AS cluster_id, CAST(NULL AS VARCHAR) AS muni_code FROM e LEFT JOIN regions r ON kind = 'municipality' AND r.code = e.code
    LEFT JOIN fs ON kind = 'municipality' AND fs.muni_code = e.code"""
)
def chronology_targets(spark, sf_dir):
    v = clustered(spark, sf_dir)
    return A.first_visit_targets(A.chronology(T.visits(spark, sf_dir), second_level=True), L.exclude_zones(v, T.zones(spark)), T.regions(spark))


def _marks(spark, sf_dir):
    """A bookmark for every photo, of all kinds."""
    k = F.col("photo_idx") % 5
    p = T.photos(spark, sf_dir)
    view = F.when(k == 0, "national").when(k == 1, "prefecture").otherwise("place")
    spot = lambda c, d: F.when(k.isin(2, 3), F.coalesce(F.col(c) + d, F.lit(10.0)))
    return p.select(
        F.col("photo_idx").alias("mark_id"), "subject_id", view.alias("view"), F.when(k > 0, F.lit(3)).alias("pref_code"), F.when(k == 4, "02013").alias("muni_code"), spot("lat", 0.0007).alias("anchor_lat"), spot("lng", 0.0).alias("anchor_lng"),
        C.date_text(F.col("taken_ms")).alias("day"), F.when(F.col("photo_idx") % 2 == 0, 2024).otherwise(2019).alias("year"), F.lit(1).alias("month"),
    )


@query(
    _CV
    + f""", mk AS (SELECT photo_idx AS mark_id, subject_id, photo_idx % 5 AS k, coalesce(lat + 0.0007, 10.0) AS lat, coalesce(lng, 10.0) AS lng, CAST({_TAKEN} AS VARCHAR) AS day, photo_idx % 2 = 0 AS known FROM photos),
    pr AS (SELECT mark_id, s.cluster_id, s.pref_code, {metres('v.lat', 'v.lng', 's.lat', 's.lng')} AS d, s.visit_idx FROM mk v JOIN cv s ON s.subject_id = v.subject_id AND abs(v.lat - s.lat) < 0.01 AND abs(v.lng - s.lng) < 0.01
      WHERE k IN (2, 3) AND {_OUT} AND {metres('v.lat', 'v.lng', 's.lat', 's.lng')} <= 200),
    ht AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY round(d, 6), visit_idx DESC) AS n FROM pr) WHERE n = 1)
    SELECT mk.mark_id, CAST(CASE WHEN known THEN 2024 END AS INT) AS year, CAST(CASE WHEN known THEN 1 END AS INT) AS month, CASE WHEN k = 0 THEN 'national' WHEN ht.mark_id IS NOT NULL OR k = 4 THEN 'place' ELSE 'prefecture' END AS target,
    CAST(CASE WHEN k > 0 THEN coalesce(ht.pref_code, 3) END AS INT) AS pref_code, ht.cluster_id, CASE WHEN k = 4 THEN '02013' END AS muni_code, day, k NOT IN (2, 3) OR ht.mark_id IS NOT NULL AS found FROM mk LEFT JOIN ht USING (mark_id)"""
)
def bookmark_open(spark, sf_dir):
    v = T.visits(spark, sf_dir)
    return P.open_bookmarks(_marks(spark, sf_dir), clustered(spark, sf_dir), T.zones(spark), v.select("year"))


@query(
    _CAND
    + """, w AS (SELECT 'period' AS kind, '2024-01' AS label, false AS unvisited, -1 AS score FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM visits WHERE date_str LIKE '2024%')) UNION ALL SELECT kind, label, unvisited, CASE WHEN starts_with(label, '2024-01') THEN 0 ELSE 1 END
    FROM cand WHERE contains(label, '2024-01')) SELECT CAST(row_number() OVER (ORDER BY score, label DESC) AS INT) AS position, kind, label, unvisited, CAST(score AS INT) AS score FROM w ORDER BY score, label DESC LIMIT 10"""
)
def address_search(spark, sf_dir):
    return S.search(_candidates(spark, sf_dir), T.visits(spark, sf_dir).select("date_str"), "２０２４-０１")


@query(
    _CV
    + _MUNI
    + """, mo AS (SELECT mode, sum(distance_m) AS d, count(*) AS n FROM activities GROUP BY 1), rt AS (SELECT pref_code, round(count(*) FILTER (stay_count > 0) / count(*), 6) AS rate FROM ma GROUP BY 1),
    wd AS (SELECT w.dow, round(coalesce(m, 0.0), 3) AS m FROM range(7) w(dow) LEFT JOIN (SELECT dow, avg(m) AS m FROM (SELECT subject_id, date_str, min(dow) AS dow, sum(distance_m) AS m FROM activities GROUP BY 1, 2) GROUP BY dow) d ON d.dow = w.dow)
    SELECT 'trips' AS section, 'all' AS label, CAST(sum(n) AS DOUBLE) AS value FROM mo UNION ALL SELECT 'mode_km', mode, round(d / 1000.0, 3) FROM mo
    UNION ALL SELECT 'month_km', printf('%d-%02d', year, month), round(sum(distance_m) / 1000.0, 3) FROM activities GROUP BY year, month UNION ALL SELECT 'weekday_km', dow::VARCHAR, round(m / 1000.0, 3) FROM wd
    UNION ALL SELECT 'hour', h.hour::VARCHAR, CAST(coalesce(n, 0) AS DOUBLE) FROM range(24) h(hour) LEFT JOIN (SELECT hour, count(*) AS n FROM activities GROUP BY hour) a ON a.hour = h.hour
    UNION ALL SELECT 'visited_percent', pref_code::VARCHAR, floor(rate * 100 + 0.5) FROM rt"""
)
def stats_report(spark, sf_dir):
    hours, weekdays = (spark.range(n).select(F.col("id").cast("int").alias(c)) for n, c in ((24, "hour"), (7, "dow")))
    return A.stats_report(T.activities(spark, sf_dir), _muni(spark, sf_dir), hours, weekdays)


# ---- exports --------------------------------------------------------------------------------------------------------


def _documents(spark, sf_dir):
    """The timeline as exports of one segment each, in the reader's form; stays of a known kind are labelled places."""
    t = table(spark, sf_dir, "timeline")
    e = t.select(
        F.col("segment_id").alias("subject_id"),
        F.array(
            F.struct(
                F.col("start_time").alias("startTime"), F.col("end_time").alias("endTime"), F.col("start_time_timezone_utc_offset_minutes").alias("startTimeTimezoneUtcOffsetMinutes"),
                F.col("visit"), F.col("activity"), F.col("timeline_path").alias("timelinePath"),
            )
        ).cast(spark.createDataFrame([], TIMELINE).schema["semanticSegments"].dataType).alias("semanticSegments"),
        F.struct(F.array(F.struct(F.col("visit.top_candidate.place_id").alias("placeId"), F.col("visit.top_candidate.place_location.lat_lng").alias("placeLocation"), F.col("visit.top_candidate.semantic_type").alias("label"))).alias("frequentPlaces")).alias("userLocationProfile"),
    )
    return e


def _pair(s: str) -> str:
    number = lambda k: rf"try_cast(nullif(regexp_extract(regexp_replace(split_part({s}, ',', {k}), '°', ''), '^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE)"
    return f"CASE WHEN len(string_split({s}, ',')) = 2 AND {number(1)} IS NOT NULL AND {number(2)} IS NOT NULL THEN {{'lat': {number(1)}, 'lng': {number(2)}}} END"


@query(
    f""", t AS (SELECT segment_id, visit, {_pair('visit.top_candidate.place_location.lat_lng')} AS spot FROM timeline WHERE visit IS NOT NULL)
    SELECT segment_id, nullif(visit.top_candidate.place_id, '') AS place_id, visit.top_candidate.semantic_type AS semantic_type, spot.lat AS lat, spot.lng AS lng FROM t WHERE spot IS NOT NULL"""
)
def export_stays(spark, sf_dir):
    v = timeline.normalize(_documents(spark, sf_dir)).visits
    return v.select(F.col("subject_id").alias("segment_id"), "place_id", "semantic_type", "lat", "lng")


@query(
    f""", t AS (SELECT segment_id, activity, {_pair('activity.start_loc.lat_lng')} AS p, {_pair('activity.end_loc.lat_lng')} AS q FROM timeline WHERE visit IS NULL AND activity IS NOT NULL)
    SELECT segment_id, CASE WHEN activity.top_candidate.type_name IS NULL OR activity.top_candidate.type_name = 'UNKNOWN_ACTIVITY_TYPE' THEN 'UNKNOWN' ELSE activity.top_candidate.type_name END AS mode,
    coalesce(activity.distance_meters, 0.0) AS distance_m, p.lat AS start_lat, p.lng AS start_lng, q.lat AS end_lat, q.lng AS end_lng FROM t"""
)
def export_moves(spark, sf_dir):
    a = timeline.normalize(_documents(spark, sf_dir)).activities
    return a.select(F.col("subject_id").alias("segment_id"), "mode", "distance_m", "start_lat", "start_lng", "end_lat", "end_lng")


@query(
    f""", t AS (SELECT segment_id, unnest(timeline_path) AS x, generate_subscripts(timeline_path, 1) - 1 AS pt FROM timeline WHERE visit IS NULL AND activity IS NULL), p AS (SELECT segment_id, pt, {_pair('x.point')} AS spot FROM t)
    SELECT segment_id, CAST(pt AS INT) AS pt_idx, spot.lat AS lat, spot.lng AS lng FROM p WHERE spot IS NOT NULL"""
)
def export_points(spark, sf_dir):
    p = timeline.normalize(_documents(spark, sf_dir)).path_points
    return p.select(F.col("subject_id").alias("segment_id"), "pt_idx", "lat", "lng")


@query(
    f""", t AS (SELECT segment_id, visit, {_pair('visit.top_candidate.place_location.lat_lng')} AS spot FROM timeline)
    SELECT segment_id, visit.top_candidate.place_id AS place_id, visit.top_candidate.semantic_type AS label, spot.lat AS home_lat, spot.lng AS home_lng FROM t WHERE spot IS NOT NULL AND coalesce(visit.top_candidate.semantic_type, '') <> ''"""
)
def export_frequent_places(spark, sf_dir):
    return timeline.normalize(_documents(spark, sf_dir)).frequent_places.withColumnRenamed("subject_id", "segment_id")


_SHREDDED = EXPORT | {
    "semanticSegments|semantic_segments[]": EXPORT["semanticSegments|semantic_segments[]"]
    | {"visit": {"topCandidate|top_candidate": {"placeId|place_id": None, "placeLocation|place_location": {"latLng|lat_lng": None}}}, "startTime|start_time": None}
}


@query()
def p5_segments(spark, sf_dir):
    """Every segment of every export with its links and leaves."""
    return shred(table(spark, sf_dir, "raw_exports"), "export_id", "payload", _SHREDDED, find_segments)["semanticSegments"]


@query()
def p5_path_points(spark, sf_dir):
    """Every path element of every export with its links to segment and export."""
    return shred(table(spark, sf_dir, "raw_exports"), "export_id", "payload", _SHREDDED, find_segments)["semanticSegments.timelinePath"]
