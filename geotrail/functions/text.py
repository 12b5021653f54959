"""Texts for people: durations, distances, sizes, labels, and the normal form used in searching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def duration_text(ms: Column) -> Column:
    """``3h 5min`` or ``5min``, rounded to minutes."""
    minutes = F.floor(ms / 60_000 + 0.5).cast("bigint")
    return F.when(minutes >= 60, F.format_string("%dh %dmin", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%dmin", minutes))


def distance_text(metres: Column) -> Column:
    """Whole metres under a kilometre, else kilometres with one decimal."""
    km = metres / 1000
    # format_number rounds an exact half to the even digit; here it goes up.
    up = F.when(km % 1 == 0.25, km + 0.01).otherwise(km)
    return F.when(metres < 1000, F.format_string("%d m", F.floor(metres + 0.5).cast("bigint"))).otherwise(F.concat(F.format_number(up, 1), F.lit(" km")))


def size_text(n: Column) -> Column:
    """Bytes as KB or MB."""
    kb = n / 1024
    return F.when(kb < 1024, F.format_string("%d KB", F.floor(kb + 0.5).cast("bigint"))).otherwise(F.format_string("%.1f MB", kb / 1024))


def gap_text(ms: Column) -> Column:
    """Minutes under an hour, else rounded hours."""
    minutes = F.floor(ms / 60_000 + 0.5).cast("bigint")
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h", F.floor(minutes / 60 + 0.5).cast("bigint")))


def escape_html(text: Column) -> Column:
    """The five signs that mean something in HTML, escaped."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def place_label(label: Column, region: Column) -> Column:
    """``label (region)``, or the region alone."""
    return F.when(label.isNotNull(), F.concat(label, F.lit(" ("), region, F.lit(")"))).otherwise(region)


def clock_text(epoch_ms: Column, offset_min: Column) -> Column:
    """``HH:MM`` of the local clock."""
    minute = F.floor(F.pmod(epoch_ms + offset_min.cast("bigint") * 60_000, F.lit(86_400_000)) / F.lit(60_000)).cast("int")
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)


def normal_form(text: str) -> str:
    """Compatibility form and lower case."""
    return unicodedata.normalize("NFKC", text).lower()


@F.pandas_udf(StringType())
def search_form(texts: pd.Series) -> pd.Series:
    """The same of a column; Spark has no such function of its own."""
    return texts.map(normal_form, na_action="ignore")


#: Names of the kinds of moves and how their lines are drawn.
MODE_NAMES = {
    "WALKING": "Walking", "CYCLING": "Cycling", "RUNNING": "Running", "IN_PASSENGER_VEHICLE": "Car", "IN_TAXI": "Taxi", "IN_BUS": "Bus", "IN_TRAIN": "Train", "IN_SUBWAY": "Subway",
    "IN_TRAM": "Tram", "IN_FERRY": "Ferry", "FLYING": "Plane", "IN_GONDOLA_LIFT": "Gondola", "UNKNOWN": "Unknown",
}
RAIL = ("IN_TRAIN", "IN_SUBWAY", "IN_TRAM")
ON_FOOT = ("WALKING", "RUNNING")


def mode_name(mode: Column) -> Column:
    """A name for people; unknown kinds stay as they are written."""
    names = F.create_map(*[F.lit(x) for kv in MODE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, mode), mode)


def line_pattern(mode: Column) -> Column:
    """How a route of this kind is drawn."""
    return F.when(mode.isin(*RAIL), "rail").when(mode.isin(*ON_FOOT), "dotted").otherwise("solid")


#: Colours of the kinds of moves, of others, of regions not visited and only passed, and the ends of the heat scale.
MODE_COLORS = {
    "WALKING": "#008300", "RUNNING": "#006400", "CYCLING": "#4d8a00", "IN_PASSENGER_VEHICLE": "#c98500", "IN_TAXI": "#1f5aa8", "IN_BUS": "#2a78d6", "IN_TRAIN": "#e34948",
    "IN_SUBWAY": "#b62e2d", "IN_TRAM": "#d9534f", "FLYING": "#4a3aa7", "IN_FERRY": "#0e8a74", "IN_GONDOLA_LIFT": "#d55181",
}
OTHER_COLOR, UNVISITED_COLOR, PASSED_COLOR = "#75736e", "#e0e0e0", "#b9e2da"
HEAT_LOW, HEAT_HIGH = (222, 235, 247), (8, 81, 156)
#: The closest zoom, and that under privacy.
MOST_ZOOM, MOST_ZOOM_PRIVATE = 18, 12
LANGUAGES = ("ja", "en")
#: What captions and labels say.
ALL_TIME, WHOLE_MAP, DAY_VIEW = "All time", "Japan", "Day view: {d}"
NO_TIME, FILE_TIME, NEAREST_RECORD = "Date taken unknown", " (estimated from file creation time)", " (about {n} from the nearest record)"
PLACED_BY = {"exif": "Location: Exif", "takeout": "Location: Takeout", "estimated": "Location: estimated"}


def mode_color(mode: Column) -> Column:
    """The colour of a route of this kind."""
    names = F.create_map(*[F.lit(x) for kv in MODE_COLORS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, mode), F.lit(OTHER_COLOR))


def heat_color(share: Column) -> Column:
    """``rgb(r, g, b)`` between the ends of the heat scale."""
    parts = [F.floor(F.lit(a) + (b - a) * share + 0.5).cast("int") for a, b in zip(HEAT_LOW, HEAT_HIGH)]
    return F.format_string("rgb(%d, %d, %d)", *parts)


def period_label(year: Column, month: Column) -> Column:
    """``All time``, ``2024`` or ``2024-01``."""
    return F.when(year.isNull(), ALL_TIME).when(month.isNull(), year.cast("string")).otherwise(F.format_string("%d-%02d", year, month))


def taken_text(epoch_ms: Column, is_fallback: Column, offset_min: Column) -> Column:
    """When a photo was taken, by the local clock; a time that is only the file's says so."""
    local = F.timestamp_millis(epoch_ms + offset_min.cast("bigint") * 60_000)
    said = F.concat(F.date_format(local, "yyyy/M/d HH:mm"), F.when(is_fallback, FILE_TIME).otherwise(""))
    return F.when(epoch_ms.isNull(), NO_TIME).otherwise(said)


def source_text(source: Column, gap_ms: Column) -> Column:
    """Where a photo's place comes from; an estimate with its distance in time."""
    gap = F.when(gap_ms > 0, filled(F.lit(NEAREST_RECORD), n=gap_text(gap_ms))).otherwise("")
    names = F.create_map(*[F.lit(x) for kv in PLACED_BY.items() for x in kv])
    return F.coalesce(F.concat(F.try_element_at(names, source), F.when(source == "estimated", gap).otherwise("")), F.lit(""))


def entry_label(day: Column, view: Column, region: Column, place: Column) -> Column:
    """What a visited page is called: a day, the whole map, a first-level region, or a place below one."""
    return F.when(day.isNotNull(), filled(F.lit(DAY_VIEW), d=day)).when(view == "national", WHOLE_MAP).when(view == "prefecture", region).otherwise(place_path(region, place))


def bookmark_name(label: Column, day: Column, year: Column, month: Column) -> Column:
    """The name a new bookmark is given: that of its page, with the period unless it is a day or all time."""
    return F.when(year.isNull() | day.isNotNull(), label).otherwise(F.concat(label, F.lit(" ("), period_label(year, month), F.lit(")")))


def date_title(day: Column) -> Column:
    """``Sat, Jan 20, 2024`` of a date text."""
    return F.date_format(F.to_date(day), "EEE, MMM d, yyyy")


def imported_text(epoch_ms: Column, offset_min: Column) -> Column:
    """``2024/1/20``, empty for none."""
    return F.when(F.coalesce(epoch_ms, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_millis(epoch_ms + offset_min.cast("bigint") * 60_000), "yyyy/M/d"))


def place_path(*parts: Column) -> Column:
    """Names from the outermost to the place itself."""
    return F.concat_ws(" › ", *parts)


def filled(template: Column, **values: Column) -> Column:
    """A text with ``{name}`` replaced by values; names that are not given stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def in_language(df, names, key: str, language: str):
    """``df`` with ``local_name`` of its ``key`` in a language (``names``: key, language, local_name), else its own ``name``."""
    n = names.where(F.col("language") == language).select(F.col(key).alias("__key"), "local_name")
    out = df.join(n, F.col(key) == F.col("__key"), "left")
    return out.select(*df.columns, F.coalesce("local_name", "name").alias("local_name"))


def language(forced: str | None, saved: str | None, system: str | None) -> str:
    """The forced language, else the saved one, else the system's; English where none is known."""
    for wish in (forced, saved):
        if wish in LANGUAGES:
            return wish
    return "ja" if (system or "").lower().startswith("ja") else "en"
