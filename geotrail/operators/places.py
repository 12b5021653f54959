"""Questions about single places: neighbours, suggestions, bookmarks, labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import destination, flat_bearing, haversine_m
from geotrail.functions.text import place_label
from geotrail.operators.dual_tree import _groups
from geotrail.operators.dual_tree import haversine_m as sphere_m
from geotrail.operators.filters import _covered_cells, _met, near_any
from geotrail.session import ensure_checkpoint_dir

#: Fixed values in metres: a bookmark's reach, a photo's reach of a pin and where it is then drawn, suggestions near a home.
BOOKMARK_M, NUDGE_M, NUDGED_M, SUGGEST_M = 200.0, 15.0, 10.0, 300.0
#: Categories and types of small tenants within something larger, where the larger thing's name is better.
SUBUNIT_CATEGORIES = ("shop", "office")
SUBUNIT_AMENITIES = ("cafe", "restaurant", "fast_food", "bar", "pub", "ice_cream", "bank", "atm", "pharmacy", "clinic", "dentist", "food_court", "vending_machine")
#: Address fields of enclosing things in order, and endings of names that only show the way.
ENCLOSING = ("mall", "building", "retail", "commercial", "department_store")
WAYFINDING = "(改札口?|出口|入口|連絡通路|地下通路|連絡橋|コンコース)$"


def pairs_within(left: DataFrame, right: DataFrame, radius: float, left_cols: tuple[str, str], right_cols: tuple[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at most ``radius`` metres apart, with ``away_m``, by an equi-join on grid cells; columns of the right side must differ."""
    cells = _covered_cells(right.withColumn("__all", F.struct("*")), *right_cols, radius, ["__all", *by])
    rest = [c for c in right.columns if c not in by]
    d = haversine_m(F.col(left_cols[0]), F.col(left_cols[1]), F.col("__clat"), F.col("__clng"))
    return left.join(cells, _met(*left_cols, radius, by)).select(*left.columns, *[F.col(f"__k___all.{c}").alias(c) for c in rest], d.alias("away_m"))


#: Subjects of at most so many places are compared within one task; nearest places of the others are sought in growing circles.
FEW_PLACES = 2_000
_FIRST_REACH_M, _HALF_ROUND_M = 200.0, 20_100_000.0
_NEAR = "subject_id bigint, cluster_id bigint, rank int, near_id bigint, away_m double"


def _nearest_of_few(k: int):
    """Nearest places within each subject of a sorted partition, a few thousand rows at most for one of them."""

    def run(batches):
        for subject, ids, lat, lng in _groups(batches, 1):
            n = len(ids)
            for s in range(0, n, 256):
                part = slice(s, min(s + 256, n))
                d = np.round(sphere_m(lat[part, None], lng[part, None], lat[None], lng[None]), 3)
                d[np.arange(d.shape[0]), np.arange(part.start, part.stop)] = np.inf
                order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, : min(k, n - 1)]
                m, width = order.shape
                if width:
                    columns = [np.repeat(subject[part], width), np.repeat(ids[part], width), np.tile(np.arange(1, width + 1, dtype=np.int32), m), ids[order].ravel(), np.take_along_axis(d, order, 1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["subject_id", "cluster_id", "rank", "near_id", "away_m"])

    return run


def nearest_places(places: DataFrame, k: int = 5) -> DataFrame:
    """For each place (``subject_id, cluster_id, lat, lng``) the ``k`` nearest other places of its subject however far, nearest first, by
    millimetres and then id.

    Subjects with few places are compared within one task. For the places of the others circles of four times the radius are drawn
    until each holds ``k`` others, so crowded places, whose circles stay small, make few pairs.
    """
    ensure_checkpoint_dir(places.sparkSession)
    places = places.select(F.col("subject_id").cast("bigint").alias("subject_id"), F.col("cluster_id").cast("bigint").alias("cluster_id"), "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL").checkpoint()
    many = places.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW_PLACES).select("subject_id").checkpoint()
    few = places.join(many, "subject_id", "left_anti").repartition("subject_id").sortWithinPartitions("subject_id").mapInArrow(_nearest_of_few(k), _NEAR)
    if many.isEmpty():
        return few
    crowd = places.join(many, "subject_id", "left_semi").checkpoint()
    other = crowd.select("subject_id", F.col("cluster_id").alias("near_id"), F.col("lat").alias("near_lat"), F.col("lng").alias("near_lng"))
    found, open_, reach = [few], crowd, _FIRST_REACH_M
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("away_m", "near_id"))
    while True:
        last = reach >= _HALF_ROUND_M
        pairs = pairs_within(open_, other, reach, ("lat", "lng"), ("near_lat", "near_lng"), ("subject_id",)).where("cluster_id <> near_id")
        ranked = pairs.select("subject_id", "cluster_id", "near_id", F.round("away_m", 3).alias("away_m")).withColumn("rank", rank).where(F.col("rank") <= k).select("subject_id", "cluster_id", "rank", "near_id", "away_m")
        if last:
            return reduce(DataFrame.unionByName, [*found, ranked])
        ranked = ranked.checkpoint()
        # A circle that is full holds the nearest; a place whose last one lies at the very edge may have an equal just outside.
        full = ranked.where((F.col("rank") == k) & (F.col("away_m") < reach - 0.001)).select(F.col("cluster_id").alias("full_id"))
        found.append(ranked.join(full, F.col("cluster_id") == F.col("full_id"), "left_semi"))
        open_ = open_.join(full, F.col("cluster_id") == F.col("full_id"), "left_anti").checkpoint()
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reach *= 4


def suggestions(homes: DataFrame, ranking: DataFrame, zones: DataFrame, top: int = 10) -> DataFrame:
    """Places to hide: homes outside the zones, and of each subject's ``top`` places those outside the zones and not near a suggested home.

    The ranks are taken before anything is filtered.
    """
    h = near_any(homes.where(F.col("label").isin("HOME", "WORK")), "home_lat", "home_lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), keep_near=False)
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("visits"), "cluster_id"))
    t = ranking.withColumn("rank", rank).where(F.col("rank") <= top)
    t = near_any(t, "lat", "lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), keep_near=False)
    t = near_any(t, "lat", "lng", h, "home_lat", "home_lng", SUGGEST_M, by=("subject_id",), keep_near=False)
    return h.select("subject_id", F.col("label").alias("kind"), F.lit(None).cast("bigint").alias("cluster_id"), F.col("home_lat").alias("lat"), F.col("home_lng").alias("lng")).unionByName(
        t.select("subject_id", F.lit("PLACE").alias("kind"), "cluster_id", "lat", "lng")
    )


def resolve_bookmarks(marks: DataFrame, stays: DataFrame, zones: DataFrame) -> DataFrame:
    """The stay nearest to each bookmark's anchor within reach, of equal ones the last; none for anchors in a zone."""
    open_ = near_any(marks, "anchor_lat", "anchor_lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), keep_near=False)
    s = stays.select("subject_id", "visit_idx", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    pairs = pairs_within(open_, s, BOOKMARK_M, ("anchor_lat", "anchor_lng"), ("s_lat", "s_lng"), ("subject_id",))
    best = pairs.groupBy("mark_id").agg(F.min(F.struct(F.round("away_m", 6).alias("d"), (-F.col("visit_idx")).alias("v"))).alias("b"))
    return marks.join(best, "mark_id", "left").select("mark_id", (-F.col("b.v")).alias("visit_idx"), F.round("b.d", 3).alias("away_m"))


def nudge_photos(photos: DataFrame, pins: DataFrame) -> DataFrame:
    """Photos within reach of a pin are drawn a fixed way off it, in the direction they lie, north if they coincide."""
    p = pins.select("subject_id", F.col("pin_id"), F.col("lat").alias("pin_lat"), F.col("lng").alias("pin_lng"))
    pairs = pairs_within(photos, p, NUDGE_M, ("lat", "lng"), ("pin_lat", "pin_lng"), ("subject_id",))
    best = pairs.groupBy("photo_idx").agg(F.min(F.struct(F.round("away_m", 6).alias("d"), "pin_id", "pin_lat", "pin_lng")).alias("b"))
    out = photos.join(best, "photo_idx", "left")
    turn = F.when(F.col("b.d") <= 0.5, F.lit(0.0)).otherwise(flat_bearing(F.col("lat") - F.col("b.pin_lat"), F.col("lng") - F.col("b.pin_lng")))
    to = destination(F.col("b.pin_lat"), F.col("b.pin_lng"), turn, F.lit(NUDGED_M))
    moved = F.col("b").isNotNull()
    return out.select("photo_idx", F.when(moved, to["lat"]).otherwise(F.col("lat")).alias("lat"), F.when(moved, to["lng"]).otherwise(F.col("lng")).alias("lng"), moved.alias("nudged"))


def place_name(name: Column, category: Column, kind: Column, address: Column, display: Column) -> Column:
    """``struct<label, confident>`` of an answer of a reverse geocoder; ``address`` is map<string, string>."""
    enclosing = F.coalesce(*[F.nullif(F.try_element_at(address, F.lit(k)), F.lit("")) for k in ENCLOSING])
    field = lambda k: F.nullif(F.try_element_at(address, F.lit(k)), F.lit(""))
    own = F.nullif(name, F.lit(""))
    subunit = F.coalesce(category.isin(*SUBUNIT_CATEGORIES) | ((category == "amenity") & kind.isin(*SUBUNIT_AMENITIES)), F.lit(False))
    sign = F.coalesce(own.rlike(WAYFINDING), F.lit(False))
    area = F.coalesce(field("neighbourhood"), field("suburb"), field("quarter"))
    road = F.when(~field("road").rlike(WAYFINDING), field("road"))
    first = F.nullif(F.split(display, ",")[0], F.lit(""))
    say = lambda label, sure: F.struct(label.alias("label"), sure.alias("confident"))
    return (
        F.when((subunit | sign) & enclosing.isNotNull(), say(enclosing, F.lit(True)))
        .when(own.isNotNull() & ~sign, say(own, ~subunit))
        .when(enclosing.isNotNull(), say(enclosing, F.lit(True)))
        .otherwise(say(F.coalesce(area, road, first), F.lit(False)))
    )


def landmark(elements: Column) -> Column:
    """The name of a named landmark area among ``array<struct<type, tags map>>``: a building first, else the first."""
    has = lambda e, k: F.coalesce(F.try_element_at(e["tags"], F.lit(k)), F.lit("")) != ""
    kinds = ("building", "shop", "landuse", "leisure", "tourism", "amenity")

    def fits(e: Column) -> Column:
        some = has(e, kinds[0])
        for k in kinds[1:]:
            some = some | has(e, k)
        return (e["type"] == "area") & has(e, "name") & ~has(e, "boundary") & ~has(e, "place") & some

    areas = F.filter(elements, fits)
    best = F.coalesce(F.get(F.filter(areas, lambda e: has(e, "building")), F.lit(0)), F.get(areas, F.lit(0)))
    return F.try_element_at(best["tags"], F.lit("name"))


def cache_key(place_id: Column, lat: Column, lng: Column) -> Column:
    """Key of a label cache: the place id, else the coordinates to five digits."""
    return F.when(place_id.isNotNull(), F.concat(F.lit("place:"), place_id)).otherwise(F.format_string("coord:%.5f,%.5f", lat, lng))


def nearest_station(places: DataFrame, stations: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """``place_id, name, away_m``: the nearest named station within reach of each place (``place_id, lat, lng``)."""
    s = stations.where(F.col("name").isNotNull()).select(F.col("name").alias("s_name"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    pairs = pairs_within(places, s, radius_m, ("lat", "lng"), ("s_lat", "s_lng"))
    best = pairs.groupBy("place_id").agg(F.min(F.struct(F.round("away_m", 3).alias("d"), "s_name")).alias("b"))
    return best.select("place_id", F.col("b.s_name").alias("name"), F.col("b.d").alias("away_m"))


def landmark_or_station(places: DataFrame, answers: DataFrame, stations: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """``place_id, name, how``: the landmark area that holds each place (``answers``: place_id, elements), else the nearest named station within
    reach, else null: the order in which landmarks are asked for."""
    held = answers.select(F.col("place_id").alias("__a"), landmark(F.col("elements")).alias("__area"))
    near = nearest_station(places, stations, radius_m).select(F.col("place_id").alias("__s"), F.col("name").alias("__station"))
    out = places.select("place_id").join(held, F.col("place_id") == F.col("__a"), "left").join(near, F.col("place_id") == F.col("__s"), "left")
    how = F.when(F.col("__area").isNotNull(), "area").when(F.col("__station").isNotNull(), "station").otherwise("none")
    return out.select("place_id", F.coalesce("__area", "__station").alias("name"), how.alias("how"))


def unlabelled(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Places whose cache key has no label yet."""
    return places.join(labels.select(F.col("cache_key")), "cache_key", "left_anti")


def open_bookmarks(marks: DataFrame, stays: DataFrame, zones: DataFrame, years: DataFrame, private: bool = False) -> DataFrame:
    """What opening each bookmark shows: ``mark_id, year, month, target, pref_code, cluster_id, muni_code, day, found``.

    ``marks`` are ``mark_id, subject_id, view, pref_code, muni_code, anchor_lat, anchor_lng, day, year, month``; ``stays`` need ``cluster_id``,
    ``pref_code`` and ``muni_code``. The period counts only if its year is there. A place's anchor leads to the nearest stay within reach:
    to its place, under privacy to its region; if there is none, to the bookmark's first-level region, not found. Days are
    not shown under privacy.
    """
    at = resolve_bookmarks(marks.where((F.col("view") == "place") & F.col("anchor_lat").isNotNull() & F.col("anchor_lng").isNotNull()), stays, zones).where(F.col("visit_idx").isNotNull())
    s = stays.select(F.col("visit_idx").alias("__v"), F.col("cluster_id").alias("__c"), F.col("muni_code").alias("__m"), F.col("pref_code").alias("__p"))
    hit = at.join(s, F.col("visit_idx") == F.col("__v")).select(F.col("mark_id").alias("__id"), "__c", "__m", "__p")
    y = years.select(F.col("year").alias("__y")).distinct()
    out = marks.join(hit, F.col("mark_id") == F.col("__id"), "left").join(y, F.col("year") == F.col("__y"), "left")
    known, place = F.col("__y").isNotNull(), F.col("view") == "place"
    anchored, seen = place & F.col("anchor_lat").isNotNull() & F.col("anchor_lng").isNotNull(), F.col("__id").isNotNull()
    direct = place & ~anchored & F.col("muni_code").isNotNull()
    target = F.when(seen | direct, "place").when(place | (F.col("view") == "prefecture"), "prefecture").otherwise("national")
    muni = F.when(direct, F.col("muni_code")).when(seen & F.lit(private), F.col("__m"))
    return out.select(
        "mark_id",
        F.when(known, F.col("year")).alias("year"),
        F.when(known, F.col("month")).alias("month"),
        target.alias("target"),
        F.when(target != "national", F.coalesce("__p", "pref_code")).alias("pref_code"),
        (F.lit(None).cast("bigint") if private else F.col("__c")).alias("cluster_id"),
        muni.alias("muni_code"),
        (F.lit(None).cast("string") if private else F.col("day")).alias("day"),
        (~anchored | seen).alias("found"),
    )


def with_cache_key(modal: DataFrame) -> DataFrame:
    """Places (``cluster_id, lat, lng, place_id``) with the key of their label in the cache."""
    return modal.withColumn("cache_key", cache_key(F.col("place_id"), F.col("lat"), F.col("lng")))


def named_stays(stays: DataFrame, labels: DataFrame, regions: DataFrame) -> DataFrame:
    """``visit_idx, name``: the label of each stay's place (``labels``: cluster_id, label) with its region, or the region alone."""
    r = regions.select(F.col("code").alias("__r"), F.col("name").alias("__n"))
    named = stays.join(labels.select(F.col("cluster_id").alias("__c"), "label"), F.col("cluster_id") == F.col("__c"), "left").join(r, F.col("muni_code") == F.col("__r"), "left")
    return named.select("visit_idx", place_label(F.col("label"), F.coalesce("__n", F.lit("Unknown"))).alias("name"))
