"""Local calendar parts from epoch milliseconds and an offset, by integer arithmetic (never the session's time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The offset where a record has none, and that of dates shown for first and last visits (minutes).
DEFAULT_OFFSET_MIN = 540


def local_ms(epoch_ms: Column, offset_min: Column | None = None) -> Column:
    """Milliseconds of the local clock; ``DEFAULT_OFFSET_MIN`` where the offset is null or NaN."""
    if offset_min is None:
        return epoch_ms + DEFAULT_OFFSET_MIN * 60_000
    off = offset_min.cast("double")
    return epoch_ms + (F.when(off.isNull() | F.isnan(off), F.lit(DEFAULT_OFFSET_MIN)).otherwise(off) * 60_000).cast("bigint")


def local_date(epoch_ms: Column, offset_min: Column | None = None) -> Column:
    """The local date."""
    return F.date_from_unix_date(F.floor(local_ms(epoch_ms, offset_min) / F.lit(DAY_MS)).cast("int"))


def date_text(epoch_ms: Column, offset_min: Column | None = None) -> Column:
    """The local date as ``YYYY-MM-DD``."""
    return local_date(epoch_ms, offset_min).cast("string")


def local_parts(epoch_ms: Column, offset_min: Column | None = None) -> dict[str, Column]:
    """year, month, date_str, hour and dow (Sunday 0) of the local clock."""
    day = local_date(epoch_ms, offset_min)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "date_str": day.cast("string"),
        "hour": F.floor(F.pmod(local_ms(epoch_ms, offset_min), F.lit(DAY_MS)) / F.lit(3_600_000)).cast("int"),
        "dow": (F.dayofweek(day) - 1).cast("int"),
    }


def grid_level(count: Column, most: Column) -> Column:
    """0 for none, else 1 to 4 by share of the largest count."""
    step = F.floor((count - 1) / (most - 1) * 4)
    return F.when(count <= 0, 0).when(most <= 1, 4).otherwise(F.least(F.lit(4), 1 + step)).cast("int")


def month_key(year: Column, month: Column) -> Column:
    """``YYYY-MM``."""
    return F.format_string("%d-%02d", year, month)


def grid_cell(day: Column) -> dict[str, Column]:
    """Column (week) and row (weekday) of a day in its year's grid, both from 1."""
    first = F.dayofweek(F.trunc(day, "year")) - 1
    at = F.dayofyear(day) - 1
    return {"grid_col": (F.floor((at + first) / 7) + 1).cast("int"), "grid_row": F.dayofweek(day).cast("int")}
