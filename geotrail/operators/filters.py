"""Privacy, exclusion zones and periods as composable steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import EARTH_M, haversine_m
from geotrail.session import is_small

#: Fixed value: the radius around a home or workplace that privacy hides, in metres.
PRIVACY_RADIUS_M = 1000.0
_LEAST_CELL_M, _ANY_CELL_M = 200.0, 5_500.0


def _rings(radius: float | Column) -> int:
    """How many grid cells go round the globe: of four times the radius where it is one number, of a few kilometres where rows have their own."""
    return int(40_000_000 / (_ANY_CELL_M if isinstance(radius, Column) else max(4 * radius, _LEAST_CELL_M))) or 1


def _cell(value: Column, rings: int) -> Column:
    return F.floor(value / 360 * rings).cast("int")


def _at(lat: Column, lng: Column, rings: int) -> tuple[Column, Column]:
    """Row and column of a place; columns go round the globe."""
    return _cell(lat, rings), F.pmod(_cell(lng, rings), F.lit(rings))


def _covered_cells(centres: DataFrame, lat: str, lng: str, radius: float | Column, keep: list[str]) -> DataFrame:
    """One row for every grid cell that a circle may touch, also across the 180th meridian and the poles."""
    rings = _rings(radius)
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    angle = r / EARTH_M
    dlat = F.degrees(angle) * 1.000001 + 1e-9
    spread = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat))))) * 1.000001 + 1e-9
    dlng = F.when(F.abs(lat) + dlat >= 90, F.lit(180.0)).otherwise(spread)
    out = centres.where(F.col(lat).isNotNull() & F.col(lng).isNotNull() & (r >= 0))
    out = out.select(F.col(lat).alias("__clat"), F.col(lng).alias("__clng"), r.alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keep], dlat.alias("__dy"), dlng.alias("__dx"))
    first = _cell(F.col("__clng") - F.col("__dx"), rings)
    last = F.least(_cell(F.col("__clng") + F.col("__dx"), rings), first + rings - 1)
    out = out.select("*", F.explode_outer(F.sequence(_cell(F.col("__clat") - F.col("__dy"), rings), _cell(F.col("__clat") + F.col("__dy"), rings))).alias("__cy"), F.sequence(first, last).alias("__xs"))
    return out.select("*", F.explode_outer("__xs").alias("__x")).withColumn("__cx", F.pmod("__x", F.lit(rings))).drop("__xs", "__x", "__dy", "__dx")


def _met(lat: str, lng: str, radius: float | Column, by: tuple[str, ...]) -> Column:
    """The condition of a join with ``_covered_cells``: equal cells, equal ``by`` columns, and the distance itself."""
    cy, cx = _at(F.col(lat), F.col(lng), _rings(radius))
    on = (cy == F.col("__cy")) & (cx == F.col("__cx"))
    for b in by:
        on = on & (F.col(b) == F.col(f"__k_{b}"))
    return on & (haversine_m(F.col(lat), F.col(lng), F.col("__clat"), F.col("__clng")) <= F.col("__r"))


def near_any(df: DataFrame, lat: str, lng: str, centres: DataFrame, centre_lat: str, centre_lng: str, radius: float | Column, *, by: tuple[str, ...] = (), keep_near: bool) -> DataFrame:
    """Rows that lie (``keep_near``) or do not lie within ``radius`` of any centre; the edge counts as near, null places as far.

    An equi-join on grid cells of about the radius with the exact distance as residual condition, so neither side needs to be small; a
    crowded cell of ``df`` is split by adaptive execution, as its rows need not stay together.
    """
    cells = _covered_cells(centres, centre_lat, centre_lng, radius, list(by))
    return df.join(cells, _met(lat, lng, radius, by), "left_semi" if keep_near else "left_anti")


def near_keys(df: DataFrame, lat: str, lng: str, centres: DataFrame, centre_lat: str, centre_lng: str, radius: float | Column, *, by: tuple[str, ...] = (), key: str) -> DataFrame:
    """Rows with the ``key`` of each centre they lie within ``radius`` of, one row per centre; the edge counts as near, null places as far."""
    cells = _covered_cells(centres, centre_lat, centre_lng, radius, [*by, key])
    return df.join(cells, _met(lat, lng, radius, by)).select(*df.columns, F.col(f"__k_{key}").alias(key))


def flag_near(df: DataFrame, lat: str, lng: str, centres: DataFrame, centre_lat: str, centre_lng: str, radius: float | Column, flag: str) -> DataFrame:
    """``df`` with a boolean column instead of a filter.

    Few centres go to every task, one row per grid cell; of many, each distinct place of ``df`` is tested once.
    """
    cells = _covered_cells(centres, centre_lat, centre_lng, radius, []).groupBy("__cy", "__cx").agg(F.collect_list(F.struct("__clat", "__clng", "__r")).alias("__centres"))
    if is_small(cells):
        cy, cx = _at(F.col(lat), F.col(lng), _rings(radius))
        out = df.join(F.broadcast(cells), (cy == F.col("__cy")) & (cx == F.col("__cx")), "left")
        hit = F.exists("__centres", lambda c: haversine_m(F.col(lat), F.col(lng), c["__clat"], c["__clng"]) <= c["__r"])
        return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__cy", "__cx", "__centres")
    places = df.select(F.col(lat).alias("__la"), F.col(lng).alias("__ln")).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()
    near = near_any(places, "__la", "__ln", centres, centre_lat, centre_lng, radius, keep_near=True).withColumn("__hit", F.lit(True))
    out = df.join(near, (F.col(lat) == F.col("__la")) & (F.col(lng) == F.col("__ln")), "left")
    return out.withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__la", "__ln", "__hit")


def apply_privacy(df: DataFrame, homes: DataFrame, places: list[tuple[str, str]]) -> DataFrame:
    """Rows none of whose ``places`` (pairs of latitude and longitude columns) is near a home or workplace of their subject."""
    labelled = homes.where(F.col("label").isin("HOME", "WORK"))
    for lat, lng in places:
        df = near_any(df, lat, lng, labelled, "home_lat", "home_lng", PRIVACY_RADIUS_M, by=("subject_id",), keep_near=False)
    return df


def exclude_zones(df: DataFrame, zones: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows outside every exclusion zone."""
    return near_any(df, lat, lng, zones, "zone_lat", "zone_lng", F.col("radius_m"), keep_near=False)


def in_period(df: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of a year, of a month of any year, or of a month of a year; all rows without either."""
    if year is not None:
        df = df.where(F.col("year") == year)
    return df.where(F.col("month") == month) if month is not None else df


def up_to_period(df: DataFrame, year: int, month: int) -> DataFrame:
    """Rows up to a month; rows without a date are dropped."""
    return df.where(F.col("year") * 12 + F.col("month") <= year * 12 + month)
