"""From places to regions: containment, the nearest region within a distance, and the cascade of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import bounds, haversine_m, ring_area, segment_distance_m
from geotrail.operators.dual_tree import contained_spots
from geotrail.session import ensure_checkpoint_dir

#: Fixed value: how far outside every region a place may lie and still belong to the nearest, in metres.
NEAREST_M = 3000.0
_CELL = 0.05


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / F.lit(_CELL)).cast("int"), F.floor(high / F.lit(_CELL)).cast("int"))


def edge_cells(regions: DataFrame, margin_m: float) -> DataFrame:
    """``code, pref_code, feature_idx, x1, y1, x2, y2, cy, cx``: every edge of the regions, once for each grid cell within the margin of its box."""
    ring = regions.select("code", "pref_code", "feature_idx", F.explode(F.flatten("geometry")).alias("ring")).where(F.size("ring") > 1)
    turned = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    e = ring.select("code", "pref_code", "feature_idx", F.explode(F.arrays_zip(F.col("ring").alias("p"), turned.alias("q"))).alias("e"))
    e = e.select("code", "pref_code", "feature_idx", F.col("e.p")[0].alias("x1"), F.col("e.p")[1].alias("y1"), F.col("e.q")[0].alias("x2"), F.col("e.q")[1].alias("y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    dy = margin_m / 110_540.0 * 1.000001
    dx = margin_m / 111_320.0 * 1.000001 / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(low), F.abs(high)) + dy))), F.lit(0.001))
    e = e.select("*", F.explode_outer(_cells(low - dy, high + dy)).alias("cy"), _cells(F.least("x1", "x2") - dx, F.greatest("x1", "x2") + dx).alias("xs"))
    return e.select("*", F.explode_outer("xs").alias("cx")).drop("xs")


def locate(points: DataFrame, regions: DataFrame, lat: str = "lat", lng: str = "lng", nearest_m: float = NEAREST_M, prefectures: DataFrame | None = None) -> DataFrame:
    """``points`` with ``code``, ``pref_code``, ``how`` and ``away_m``: the first region in file order that contains the place, borders
    included; else the nearest within ``nearest_m`` (of equally near ones the later); else, without a code, the first of ``prefectures``
    (``code, feature_idx, geometry``) that contains it; else nulls and 0.

    Each distinct place is looked up once: by the dual-tree containment join, then against single edges in small grid cells.
    """
    ensure_checkpoint_dir(points.sparkSession)
    spots = points.select(F.col(lat).cast("double").alias("la"), F.col(lng).cast("double").alias("ln")).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()
    spots = spots.select("la", "ln", F.lit(0).cast("bigint").alias("id")).checkpoint()
    codes = regions.select(F.col("code").alias("r_code"), F.col("pref_code").cast("int").alias("pref_code"), "feature_idx")

    def within(rest: DataFrame, shapes: DataFrame) -> DataFrame:
        return contained_spots(rest, shapes.select(F.col("feature_idx").cast("string").alias("key"), "feature_idx", "geometry"), point_cols=("id", "la", "ln"), region_cols=("key", "feature_idx", "geometry"))

    answer = lambda code, pref, how, away: F.struct(code.alias("code"), pref.cast("int").alias("pref_code"), F.lit(how).alias("how"), away.cast("double").alias("away_m")).alias("b")
    none = F.lit(None).cast("string")
    inside = within(spots, regions).join(codes, F.col("region_key") == F.col("feature_idx").cast("string"))
    found = inside.select("la", "ln", answer(F.col("r_code"), F.col("pref_code"), "inside", F.lit(0.0))).checkpoint()
    rest = spots.join(found, ["la", "ln"], "left_anti")
    cell = lambda c: F.floor(F.col(c) / F.lit(_CELL)).cast("int")
    near = rest.withColumn("cy", cell("la")).withColumn("cx", cell("ln")).join(edge_cells(regions, nearest_m), ["cy", "cx"])
    near = near.select("la", "ln", "code", "pref_code", "feature_idx", segment_distance_m(*(F.col(c) for c in ("la", "ln", "x1", "y1", "x2", "y2"))).alias("away")).where(F.col("away") <= nearest_m)
    best = near.groupBy("la", "ln").agg(F.min(F.struct(F.round("away", 6).alias("away"), (-F.col("feature_idx")).alias("o"), "code", "pref_code")).alias("n"))
    found = found.unionByName(best.select("la", "ln", answer(F.col("n.code"), F.col("n.pref_code"), "nearest", F.col("n.away"))))
    if prefectures is not None:
        found = found.checkpoint()
        rest = spots.join(found, ["la", "ln"], "left_anti").checkpoint()
        names = prefectures.select(F.col("code").alias("p_code"), "feature_idx")
        held = within(rest, prefectures).join(names, F.col("region_key") == F.col("feature_idx").cast("string"))
        found = found.unionByName(held.select("la", "ln", answer(none, F.col("p_code"), "prefecture", F.lit(None))))
    out = points.join(found, (F.col(lat) == F.col("la")) & (F.col(lng) == F.col("ln")), "left")
    return out.select(*points.columns, F.col("b.code").alias("code"), F.coalesce(F.col("b.pref_code"), F.lit(0)).alias("pref_code"), F.coalesce("b.how", F.lit("none")).alias("how"), F.round("b.away_m", 3).alias("away_m"))


def first_outline(points: DataFrame, regions: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``points`` with ``code`` of the first region whose outer rings contain it, holes not counting; null for none."""
    shells = regions.select("code", "feature_idx", F.transform("geometry", lambda polygon: F.slice(polygon, 1, 1)).alias("geometry"))
    # Outer rings that overlap would cancel each other under the even-odd rule; each becomes a region of its own.
    shells = shells.select("code", "feature_idx", F.explode("geometry").alias("p")).select("code", "feature_idx", F.array("p").alias("geometry"))
    spots = points.select(F.col(lat).alias("la"), F.col(lng).alias("ln"), F.lit(0).cast("bigint").alias("id")).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()
    found = contained_spots(spots, shells, point_cols=("id", "la", "ln"), region_cols=("code", "feature_idx", "geometry"))
    return points.join(found, (F.col(lat) == F.col("la")) & (F.col(lng) == F.col("ln")), "left").select(*points.columns, F.col("region_key").alias("code"))


def nearest_centre(lat: float, lng: float, centres: DataFrame) -> DataFrame:
    """The region whose centre is nearest to one place; of equal ones the first."""
    d = haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return centres.withColumn("away_m", F.round(d, 3)).orderBy("away_m", "code").limit(1)


def merge_boundary_parts(parts: DataFrame) -> DataFrame:
    """Boundary records by code: names joined from their levels, polygons of one code put together, records without a code dropped."""
    name = F.concat(F.coalesce("county", F.lit("")), F.coalesce("name", F.lit("")))
    return parts.where(F.col("code").isNotNull() & (F.col("code") != "")).groupBy("code").agg(F.min(name).alias("name"), F.flatten(F.array_sort(F.collect_list("polygons"))).alias("geometry"))


def in_view(regions: DataFrame, west: float, south: float, east: float, north: float, margin: float = 0.25) -> DataFrame:
    """Regions whose box meets a view widened by a share of its size on every side."""
    dx, dy = (east - west) * margin, (north - south) * margin
    b = regions.withColumn("box", bounds(F.col("geometry")))
    meets = (F.col("box.max_lng") >= west - dx) & (F.col("box.min_lng") <= east + dx) & (F.col("box.max_lat") >= south - dy) & (F.col("box.min_lat") <= north + dy)
    return b.where(meets).drop("box")


def mainland_boxes(regions: DataFrame) -> DataFrame:
    """``code`` and the box of the outer ring of greatest area; places outside it are on islands."""
    rings = regions.select("code", F.posexplode("geometry").alias("n", "polygon")).select("code", "n", F.col("polygon")[0].alias("ring"))
    best = rings.groupBy("code").agg(F.max_by("ring", F.struct(ring_area(F.col("ring")).alias("a"), (-F.col("n")).alias("n"))).alias("ring"))
    return best.select("code", bounds(F.array(F.array("ring"))).alias("box")).select("code", "box.*")


def on_islands(places: DataFrame, regions: DataFrame, code: str = "muni_code") -> DataFrame:
    """Places outside the mainland box of their region."""
    b = mainland_boxes(regions).withColumnRenamed("code", "__code")
    out = places.join(b, F.col(code) == F.col("__code"))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng").between(F.col("min_lng"), F.col("max_lng"))
    return out.where(~inside).select(*places.columns)
