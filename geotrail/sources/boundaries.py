"""Boundary files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.geo import ring_centre
from geotrail.operators.regions import merge_boundary_parts
from geotrail.sources.schemas import FEATURE

_RINGS = "array<array<array<double>>>"


def geometry(kind: Column, coordinates: Column) -> Column:
    """Always a multi-polygon: array<polygon<ring<[lng, lat]>>>."""
    return F.when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{_RINGS}>")).when(kind == "Polygon", F.array(F.from_json(coordinates, _RINGS)))


def read_boundaries(spark: SparkSession, path: str, code: str = "code", name: str = "name", parent: str = "prefCode") -> DataFrame:
    """``code, name, pref_code, feature_idx, geometry, centre`` of a GeoJSON collection, in file order."""
    f = spark.read.schema(FEATURE).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_idx", "f"))
    p = F.col("f.properties")
    out = f.select(p[code].alias("code"), p[name].alias("name"), p[parent].try_cast("int").alias("pref_code"), "feature_idx", geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))
    return out.withColumn("centre", ring_centre(F.col("geometry")))


def merge_regional_files(spark: SparkSession, path: str, code: str = "N03_007", county: str = "N03_003", name: str = "N03_004") -> DataFrame:
    """Many regional files as one record for each code, polygons put together, records without a code dropped."""
    f = spark.read.schema(FEATURE).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    return merge_boundary_parts(f.select(p[code].alias("code"), p[county].alias("county"), p[name].alias("name"), geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons")))


def reference_list(regions: DataFrame) -> DataFrame:
    """The list of regions without their shapes."""
    return regions.drop("geometry")


def by_code(regions: DataFrame, code: str) -> DataFrame:
    """One region."""
    return regions.where(F.col("code") == code)
