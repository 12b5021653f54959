"""Coordinates from texts and from unit-less numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[-+−]?(?:\d+(?:\.\d*)?|\.\d+)"


def _on_earth(lat: Column, lng: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~((lat == 0) & (lng == 0))


def _staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keep], *[v.alias(k) for k, v in columns.items()])


def with_lat_lng(df: DataFrame, text: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with ``lat`` and ``lng`` of a text with exactly one latitude and one longitude in decimal degrees, else nulls.

    Whatever stands around the two numbers is ignored, except letters that name an axis (N, S, E, W, lat, lng, lon): they
    give order and sign. Two latitudes, two longitudes, one or three numbers, values out of range and (0, 0)
    are no location. The steps are separate projections, so that nothing is evaluated twice.
    """
    keep = [c for c in df.columns if c not in (lat, lng)]
    out = _staged(df, keep, __t=text)
    out = _staged(out, keep, __n=F.regexp_extract_all(F.col("__t"), F.lit(_NUMBER), F.lit(0)), __w=F.trim(F.lower(F.regexp_replace("__t", "[^A-Za-z]+", " "))))
    number = lambda k: F.when(F.size("__n") == 2, F.translate(F.col("__n")[k], "−", "-")).try_cast("double")
    out = _staged(out, keep, __a=number(0), __b=number(1), __w=F.col("__w"), __c=F.col("__w").rlike("^[nsew] [nsew]$"))
    w, a, b = F.col("__w"), F.col("__a"), F.col("__b")
    first, last = F.substring(w, 1, 1), F.substring(w, 3, 1)
    minus = lambda v, letter: F.when(letter.isin("s", "w"), -F.abs(v)).otherwise(v)
    kind = (
        F.when(~F.col("__c"), F.when((w != "") & w.rlike(r"\blo?ng?(?:itude)?\b.*\blat(?:itude)?\b"), "swap").otherwise("plain"))
        .when(first.isin("n", "s") & last.isin("e", "w"), "plain")
        .when(first.isin("e", "w") & last.isin("n", "s"), "swap")
    )
    signed = lambda v, letter: F.when(F.col("__c"), minus(v, letter)).otherwise(v)
    out = _staged(out, keep, __k=kind, __a=signed(a, first), __b=signed(b, last))
    swap = F.col("__k") == "swap"
    out = _staged(out, keep, __k=F.col("__k"), __lat=F.when(swap, F.col("__b")).otherwise(F.col("__a")), __lng=F.when(swap, F.col("__a")).otherwise(F.col("__b")))
    ok = F.col("__k").isNotNull() & _on_earth(F.col("__lat"), F.col("__lng"))
    return _staged(out, keep, **{lat: F.when(ok, F.col("__lat")), lng: F.when(ok, F.col("__lng"))})


def with_geo_numbers(df: DataFrame, lat_in: Column, lng_in: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with ``lat`` and ``lng`` in degrees of two numbers in degrees or in whole ten-millionths of a degree, else nulls.

    Both must be present and no NaN; (0, 0) and values out of range are no location.
    """
    keep = [c for c in df.columns if c not in (lat, lng)]
    out = _staged(df, keep, __a=lat_in.cast("double"), __b=lng_in.cast("double"))
    a, b = F.col("__a"), F.col("__b")
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    small = F.when((F.abs(a) > 90) | (F.abs(b) > 180), F.when((a == F.floor(a)) & (b == F.floor(b)), F.lit(1e7))).otherwise(F.lit(1.0))
    out = _staged(out, keep, __a=a, __b=b, __s=F.when(known, small))
    out = _staged(out, keep, __a=F.col("__a") / F.col("__s"), __b=F.col("__b") / F.col("__s"))
    ok = _on_earth(F.col("__a"), F.col("__b"))
    return _staged(out, keep, **{lat: F.when(ok, F.col("__a")), lng: F.when(ok, F.col("__b"))})


def read_pair_prefix(text: Column) -> Column:
    """``struct<lat, lng>`` of ``"a, b"``: exactly two comma parts, a leading number in each, degree sign ignored."""
    parts = F.split(text, ",", -1)
    number = lambda s: F.regexp_extract(F.regexp_replace(s, "^([^°]*)°", "$1"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    lat, lng = number(parts[0]), number(F.try_element_at(parts, F.lit(2)))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))
