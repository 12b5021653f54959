"""Problem 1: one unambiguous UTC instant for every time text.

Method: the texts are parsed by column expressions to wall-clock milliseconds. Where a text has no offset and no row
offset decides, the wall time is matched as-of against the local-time intervals of its zone. The intervals are
exploded to one row per zone and four local years, so the match is an equi-join; within a bucket, two matching intervals
mean an ambiguous wall time (clock set back), none a nonexistent one (clock set forward), and one gives the offset.
"""

from __future__ import annotations

from bisect import bisect_left
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.time_text import AMBIGUOUS, EPOCH_SPAN, read_time_text

_MS_BUCKET = 4 * 366 * 86_400_000
#: The years whose wall times in named zones are known where no others are asked for.
YEARS = (1970, 2060)
_EPOCH = datetime(1970, 1, 1)
_INTERVALS = pa.schema([("zone", pa.string()), ("bucket", pa.int32()), ("spans", pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64()), ("offset_ms", pa.int64())])))])


@lru_cache(maxsize=4)
def _probes(first_year: int, last_year: int) -> tuple[list[int], list[datetime]]:
    # Wall times of the first and last day may lie in the neighbouring year of UTC.
    start, end = datetime(first_year, 1, 1) - timedelta(days=2), datetime(last_year + 1, 1, 1) + timedelta(days=2)
    days = [*(start + timedelta(days=14 * k) for k in range((end - start).days // 14 + 1)), end]
    return [int((d - _EPOCH).total_seconds()) for d in days], days


@lru_cache(maxsize=None)
def zone_spans(name: str, first_year: int, last_year: int) -> tuple[tuple[int, int, int], ...]:
    """(from, to, offset) in local milliseconds of each stretch of one offset of a zone between two years."""
    zone = ZoneInfo(name)
    of = lambda at: int(zone.fromutc(at.replace(tzinfo=zone)).utcoffset().total_seconds())
    seconds, days = _probes(first_year, last_year)
    offsets = [of(d) for d in days]
    changes = [(seconds[0], offsets[0])]
    for k in range(1, len(days)):
        was = offsets[k - 1]
        if offsets[k] != was:
            # Clocks change at quarters of an hour, but for some that went by odd seconds long ago.
            unit = 900 if was % 900 == 0 == offsets[k] % 900 else 1
            n = bisect_left(range((seconds[k] - seconds[k - 1]) // unit), True, key=lambda q, a=days[k - 1], was=was, unit=unit: of(a + timedelta(seconds=q * unit)) != was)
            at = seconds[k - 1] + n * unit
            changes.append((at, of(_EPOCH + timedelta(seconds=at))))
    ends = [at for at, _ in changes[1:]] + [seconds[-1]]
    return tuple(((at + off) * 1000, (until + off) * 1000, off * 1000) for (at, off), until in zip(changes, ends))


@lru_cache(maxsize=4)
def _exploded(first_year: int, last_year: int, names: tuple[str, ...]) -> pa.Table:
    zones, numbers, lists, known = [], [], [], {}
    for name in names:
        # Many names are links to one set of rules.
        rules = next((p.read_bytes() for p in (Path(root, name) for root in TZPATH) if p.is_file()), name)
        if rules not in known:
            buckets: dict[int, list] = {}
            for span in zone_spans(name, first_year, last_year):
                for bucket in range(span[0] // _MS_BUCKET, (span[1] - 1) // _MS_BUCKET + 1):
                    buckets.setdefault(bucket, []).append(dict(zip(("from_ms", "to_ms", "offset_ms"), span)))
            known[rules] = buckets
        buckets = known[rules]
        zones += [name] * len(buckets)
        numbers += buckets
        lists += buckets.values()
    return pa.table([zones, numbers, lists], schema=_INTERVALS)


def _names() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if z not in ("localtime", "Factory") and not z.startswith(("posix", "right"))))


def zone_intervals(spark: SparkSession, first_year: int = YEARS[0], last_year: int = YEARS[1], names: tuple[str, ...] | None = None) -> DataFrame:
    """The exploded zone-offset intervals of all zones of the time-zone database.

    Its size is bounded by that database: about 600 zones times 23 buckets of four years by default. Wall times of named
    zones outside the years have no interval and so no instant; the years are the caller's to choose.
    """
    return spark.createDataFrame(_exploded(first_year, last_year, names or _names()))


@lru_cache(maxsize=1)
def _meanings() -> tuple[tuple[str, int], ...]:
    """(zone and abbreviation, minutes) for every zone that uses an abbreviation of several meanings in winter or summer."""
    out = {}
    for name in _names():
        for month in (1, 7):
            at = datetime(2024, month, 1, tzinfo=timezone.utc).astimezone(ZoneInfo(name))
            minutes = int(at.utcoffset().total_seconds() // 60)
            if minutes in AMBIGUOUS.get(at.tzname(), ()):
                out[f"{name} {at.tzname()}"] = minutes
    return tuple(out.items())


def _covers(wall: Column):
    return lambda span: (span["from_ms"] <= wall) & (wall < span["to_ms"])


def with_instants(
    df: DataFrame,
    texts: dict[str, Column | str],
    offset_min: Column | str | None = None,
    home_zone: Column | str | None = None,
    intervals: DataFrame | None = None,
    epoch_span: tuple[int, int] = EPOCH_SPAN,
) -> DataFrame:
    """``df`` with one column of UTC milliseconds (or null) for each of ``texts``: new name -> text column.

    A zone or offset in the text decides; else ``offset_min`` (null and NaN are none); else ``home_zone``. An abbreviation of
    several meanings has the one that ``home_zone`` gives it, else that of ``offset_min`` if it is one of them. Bare
    numbers count within ``epoch_span``, wall times in named zones within the years of ``intervals`` (by default ``YEARS``).
    Defined results: null, empty, blank and unreadable texts, impossible dates and times, ambiguous and nonexistent
    wall times, abbreviations left open and unknown zone names give null. Rows are neither dropped nor added, equal rows stay, other columns
    keep their names; an existing column of a new name is replaced. An empty table gives an empty table.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    intervals = intervals if intervals is not None else zone_intervals(df.sparkSession)
    # The interval table is bounded by the time-zone database, never by the data.
    spans = F.broadcast(intervals.select(F.col("zone").alias("__z_zone"), F.col("bucket").alias("__z_bucket"), F.col("spans").alias("__z_spans")))
    keep = [c for c in df.columns if c not in texts]
    # Names of our own on the way, so that no column of the table can clash.
    reads = {name: f"__read_{i}" for i, name in enumerate(texts)}
    found = {name: f"__found_{i}" for i, name in enumerate(texts)}
    extra = []
    if offset_min is not None:
        off = col(offset_min).cast("double")
        extra.append(F.when(~F.isnan(off) & (F.abs(off) <= 1440), off).alias("__off"))
    else:
        extra.append(F.lit(None).cast("double").alias("__off"))
    extra.append((col(home_zone) if home_zone is not None else F.lit(None).cast("string")).alias("__home"))
    out = df.select(*[F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)], *[col(t).alias(reads[n]) for n, t in texts.items()], *extra)
    meanings = F.create_map(*[F.lit(x) for kv in _meanings() for x in kv])
    several = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    for name, read in reads.items():
        out = read_time_text(out, F.col(read), read, epoch_span).drop(read)
        epoch, wall, named, short = (F.col(f"{read}_{x}") for x in ("epoch_ms", "wall_ms", "zone", "short"))
        own = F.try_element_at(meanings, F.concat_ws(" ", F.col("__home"), short)).cast("double")
        offset = F.when(short.isNotNull(), F.coalesce(own, F.when(F.array_contains(F.try_element_at(several, short), F.col("__off").cast("int")), F.col("__off"))))
        by_row = wall - F.round(offset.when(named.isNull(), F.col("__off")) * 60_000).cast("bigint")
        kept = [F.col(f"`{c}`") for c in out.columns if not c.startswith(f"{read}_")]
        zone = F.when(short.isNull(), F.coalesce(named, F.col("__home")))
        out = out.select(*kept, F.coalesce(epoch, by_row).alias("__ms"), wall.alias("__wall"), zone.alias("__zone"))
        local = F.when(F.col("__ms").isNull(), F.col("__wall"))
        out = out.select(*kept, "__ms", local.alias("__wall"), F.when(local.isNotNull(), F.col("__zone")).alias("__zone"), F.floor(local / F.lit(_MS_BUCKET)).cast("int").alias("__bucket"))
        out = out.join(spans, (F.col("__zone") == F.col("__z_zone")) & (F.col("__bucket") == F.col("__z_bucket")), "left")
        out = out.select(*kept, "__ms", "__wall", F.filter("__z_spans", _covers(F.col("__wall"))).alias("__hits"))
        by_zone = F.when(F.size("__hits") == 1, F.col("__wall") - F.col("__hits")[0]["offset_ms"])
        out = out.select(*kept, F.coalesce(F.col("__ms"), by_zone).alias(found[name]))
    return out.select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(found[n]).alias(n) for n in texts])
