"""Coverage, travel statistics, rankings and chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.calendar import DAY_MS, local_date, month_key
from geotrail.functions.text import PASSED_COLOR, UNVISITED_COLOR, heat_color

#: Longest stay that counts, in ms; length of the walking comparison, in km.
MOST_DWELL_MS, WALK_KM = DAY_MS, 490.0


def dwell_ms(start: str = "start_ms", end: str = "end_ms") -> Column:
    """Length of a stay: none for nulls and negative spans, a day at most."""
    span = F.col(end) - F.col(start)
    return F.coalesce(F.least(F.greatest(span, F.lit(0)), F.lit(MOST_DWELL_MS)), F.lit(0)).cast("bigint")


def travel_totals(moves: DataFrame) -> DataFrame:
    """Total distance and number of moves."""
    return moves.agg(F.coalesce(F.sum("distance_m"), F.lit(0)).alias("total_m"), F.count("*").alias("trips"))


def travel_by_mode(moves: DataFrame) -> DataFrame:
    """Distance, count, time and mean speed of each mode; moves that end before they start have no time."""
    spent = F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms") - F.col("start_ms")).otherwise(0)
    out = moves.groupBy("mode").agg(F.sum("distance_m").alias("distance_m"), F.count("*").alias("trips"), F.sum(spent).alias("duration_ms"))
    speed = F.when(F.col("duration_ms") > 0, (F.col("distance_m") / 1000.0) / (F.col("duration_ms") / 3_600_000.0))
    return out.withColumn("avg_speed_kmh", F.round(speed, 6))


def travel_monthly(moves: DataFrame, by_mode: bool = False) -> DataFrame:
    """Distance by month, and by mode within it."""
    rows = moves.where(F.col("month").isNotNull()).withColumn("month_key", month_key(F.col("year"), F.col("month")))
    return rows.groupBy("month_key", *(["mode"] if by_mode else [])).agg(F.sum("distance_m").alias("distance_m"))


def walking_ratio(moves: DataFrame) -> DataFrame:
    """Walked kilometres as a share of a well-known long way."""
    walked = F.coalesce(F.sum(F.when(F.col("mode") == "WALKING", F.col("distance_m"))), F.lit(0))
    return moves.agg(F.round(walked / 1000.0 / WALK_KM, 6).alias("walking_ratio"))


def longest_trips(moves: DataFrame, limit: int = 10) -> DataFrame:
    """The longest moves; of equal ones the earlier."""
    return moves.orderBy(F.desc("distance_m"), "activity_idx").limit(limit)


def day_of_week_means(moves: DataFrame, weekdays: DataFrame) -> DataFrame:
    """Mean of the daily distances for each weekday (Sunday 0), 0 where no day has a move."""
    days = moves.where(F.col("date_str").isNotNull()).groupBy("subject_id", "date_str").agg(F.min("dow").alias("dow"), F.sum("distance_m").alias("m"))
    means = days.groupBy("dow").agg(F.avg("m").alias("mean_m"))
    return weekdays.join(means, "dow", "left").select("dow", F.round(F.coalesce("mean_m", F.lit(0.0)), 3).alias("mean_m"))


def hourly_histogram(moves: DataFrame, hours: DataFrame) -> DataFrame:
    """Number of moves by starting hour, all 24."""
    return hours.join(moves.groupBy("hour").agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def top_days(moves: DataFrame, limit: int = 5) -> DataFrame:
    """The days with most distance."""
    return moves.groupBy("subject_id", "date_str").agg(F.sum("distance_m").alias("distance_m"), F.count("*").alias("trips")).orderBy(F.desc("distance_m"), "date_str", "subject_id").limit(limit)


def dwell_note(stays: DataFrame) -> DataFrame:
    """How many stays are cut to the longest that counts."""
    return stays.agg(F.count_if(F.col("end_ms") - F.col("start_ms") > MOST_DWELL_MS).alias("capped"), F.count("*").alias("visits"))


def first_level_coverage(stays: DataFrame, points: DataFrame, dimension: DataFrame) -> DataFrame:
    """Stays, places, first and last time of each first-level region; path points count for the times; all regions are there."""
    times = stays.select("pref_code", F.col("start_ms").alias("t"), F.lit(1).alias("stay"), "cluster_id").unionByName(
        points.select("pref_code", F.col("t_ms").alias("t"), F.lit(0).alias("stay"), F.lit(None).cast("bigint").alias("cluster_id"))
    )
    found = times.where(F.col("pref_code") > 0).groupBy("pref_code").agg(
        F.sum("stay").alias("stay_count"), F.countDistinct("cluster_id").alias("place_count"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms")
    )
    out = dimension.join(found, F.col("code") == F.col("pref_code"), "left")
    return out.select(F.col("code").alias("pref_code"), F.coalesce("stay_count", F.lit(0)).alias("stay_count"), F.coalesce("place_count", F.lit(0)).alias("place_count"), "first_ms", "last_ms")


def second_level_coverage(stays: DataFrame, points: DataFrame, dimension: DataFrame) -> DataFrame:
    """Stays, places, passes, first and last stay of each second-level region; ``pass_only`` where there are only passes."""
    s = stays.groupBy("muni_code").agg(F.count("*").alias("stay_count"), F.countDistinct("cluster_id").alias("place_count"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    p = points.groupBy("muni_code").agg(F.count("*").alias("pass_count"))
    s, p = s.withColumnRenamed("muni_code", "s_code"), p.withColumnRenamed("muni_code", "p_code")
    out = dimension.join(s, F.col("code") == F.col("s_code"), "left").join(p, F.col("code") == F.col("p_code"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select(F.col("code").alias("muni_code"), "pref_code", zero("stay_count"), zero("place_count"), zero("pass_count"), "first_ms", "last_ms")
    return out.withColumn("pass_only", (F.col("stay_count") == 0) & (F.col("pass_count") > 0))


def visited_rates(coverage: DataFrame) -> DataFrame:
    """Visited, only passed and all second-level regions of each first-level region, best rate first."""
    out = coverage.groupBy("pref_code").agg(F.count_if(F.col("stay_count") > 0).alias("visited"), F.count_if("pass_only").alias("pass_only"), F.count("*").alias("total"))
    return out.withColumn("rate", F.round(F.col("visited") / F.col("total"), 6)).orderBy(F.desc("rate"), "pref_code")


def heat(coverage: DataFrame) -> DataFrame:
    """Class and intensity of each region for a map: logarithm of its places as a share of the greatest."""
    most = F.max("place_count").over(Window.partitionBy(F.lit(0)))
    # One row for each region of the dimension, so a single window partition is bounded by it.
    out = coverage.withColumn("most", most)
    kind = F.when(F.col("stay_count") > 0, "heat").when(F.col("pass_only"), "pass_only").otherwise("unvisited")
    t = F.when((F.col("stay_count") > 0) & (F.col("most") > 0), F.log1p("place_count") / F.log1p("most")).otherwise(0.0)
    return out.select("muni_code", kind.alias("kind"), F.round(t, 6).alias("intensity"))


def newly_visited(coverage: DataFrame, year: int) -> DataFrame:
    """First-level regions first visited in a year, by the default local date, in order."""
    return coverage.where(F.year(local_date(F.col("first_ms"))) == year).select("pref_code", "first_ms").orderBy("first_ms", "pref_code")


def first_visits(stays: DataFrame, key: str) -> DataFrame:
    """The first stay of each region: earliest start, then input order."""
    first = F.min(F.struct("start_ms", "visit_idx", "muni_code")).alias("f")
    return stays.where(F.col(key).isNotNull() & F.col("start_ms").isNotNull()).groupBy(key).agg(first).select(key, F.col("f.start_ms").alias("first_ms"), F.col("f.muni_code").alias("hint"))


def chronology(stays: DataFrame, second_level: bool) -> DataFrame:
    """First-visit events of first-level regions with the second-level region as hint, and on demand of second-level ones."""
    out = first_visits(stays, "pref_code").select(F.lit("prefecture").alias("kind"), F.col("pref_code").cast("string").alias("code"), "first_ms", "hint")
    if second_level:
        m = first_visits(stays, "muni_code").select(F.lit("municipality").alias("kind"), F.col("muni_code").alias("code"), "first_ms", F.lit(None).cast("string").alias("hint"))
        out = out.unionByName(m)
    day = local_date(F.col("first_ms"))
    return out.withColumn("date_str", day.cast("string")).orderBy("first_ms", F.desc("kind"), "code")


def place_ranking(stays: DataFrame, sort_by: str = "visits", limit: int | None = 50) -> DataFrame:
    """Stay points by visits or by dwell; the place shown is that of the first stay in input order, which also breaks ties."""
    first = F.min(F.struct("visit_idx", "lat", "lng", "muni_code")).alias("f")
    out = stays.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count("*").alias("visits"), F.sum(dwell_ms()).alias("dwell_ms"), first, F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms")
    )
    out = out.select("cluster_id", "visits", "dwell_ms", "first_ms", "last_ms", F.col("f.lat").alias("lat"), F.col("f.lng").alias("lng"), F.col("f.muni_code").alias("muni_code"), F.col("f.visit_idx").alias("first_idx"))
    out = out.withColumn("avg_dwell_ms", F.round(F.col("dwell_ms") / F.col("visits"), 3)).orderBy(F.desc(sort_by), "first_idx")
    return out.limit(limit) if limit is not None else out


def region_ranking(stays: DataFrame, sort_by: str = "visits") -> DataFrame:
    """The same rolled up to second-level regions, so that nothing finer shows."""
    out = stays.groupBy(F.coalesce("muni_code", F.lit("unknown")).alias("muni_code")).agg(F.count("*").alias("visits"), F.sum(dwell_ms()).alias("dwell_ms"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    return out.orderBy(F.desc(sort_by), "muni_code")


def modal_place(stays: DataFrame) -> DataFrame:
    """For each stay point the place of its most frequent place id, else of its most frequent exact spot; ties go to the first seen."""
    key = F.coalesce(F.concat(F.lit("i"), "place_id"), F.concat_ws(",", F.lit("c"), F.col("lat").cast("string"), F.col("lng").cast("string")))
    groups = stays.groupBy("cluster_id", key.alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("visit_idx", "lat", "lng", "place_id")).alias("f"))
    rank = F.struct(F.col("f.place_id").isNotNull().cast("int"), "n", -F.col("f.visit_idx"))
    best = groups.groupBy("cluster_id").agg(F.max_by("f", rank).alias("f"))
    return best.select("cluster_id", "f.lat", "f.lng", "f.place_id")


def frames(stays: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each month with data: regions, places seen up to then. Each thing counts from its first month on, so no row is read twice."""
    month = lambda: F.col("year") * 12 + F.col("month") - 1
    parts = [
        stays.select(month().alias("m"), F.lit("pref").alias("what"), F.col("pref_code").cast("string").alias("id")),
        points.select(month().alias("m"), F.lit("pref").alias("what"), F.col("pref_code").cast("string").alias("id")),
        stays.select(month().alias("m"), F.lit("muni").alias("what"), F.col("muni_code").alias("id")),
        stays.select(month().alias("m"), F.lit("place").alias("what"), F.col("cluster_id").cast("string").alias("id")),
    ]
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    seen = seen.where(F.col("m").isNotNull())
    new = seen.groupBy("what", "id").agg(F.min("m").alias("m")).groupBy("m").pivot("what", ["pref", "muni", "place"]).count()
    months = seen.select("m").distinct()
    # One row for each month of the data: a handful, whatever the input.
    run = Window.partitionBy(F.lit(0)).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(run).alias(f"{c}_count")
    return months.join(new, "m", "left").select(F.floor(F.col("m") / 12).cast("int").alias("year"), (F.col("m") % 12 + 1).cast("int").alias("month"), total("pref"), total("muni"), total("place"))


def visited_badges(first: DataFrame, second: DataFrame) -> DataFrame:
    """Numbers of visited regions of both levels and of those only passed; a pass counts as a visit on the first level alone."""
    zero = F.lit(0).cast("bigint")
    a = first.agg(F.count_if((F.col("stay_count") > 0) | F.col("first_ms").isNotNull()).alias("prefs")).select("prefs", zero.alias("munis"), zero.alias("pass_only"))
    b = second.agg(F.count_if(F.col("stay_count") > 0).alias("munis"), F.count_if("pass_only").alias("pass_only")).select(zero.alias("prefs"), "munis", "pass_only")
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in ("prefs", "munis", "pass_only")])


def region_detail(stays: DataFrame, second: DataFrame) -> DataFrame:
    """For each first-level region total and mean dwell and its visited, only passed and all second-level regions."""
    d = stays.groupBy("pref_code").agg(F.sum(dwell_ms()).alias("dwell_ms"), F.count("*").alias("visits"))
    m = second.groupBy(F.col("pref_code").alias("p")).agg(F.count_if(F.col("stay_count") > 0).alias("visited"), F.count_if("pass_only").alias("pass_only"), F.count("*").alias("total"))
    out = m.join(d, F.col("p") == F.col("pref_code"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(F.col("p").alias("pref_code"), zero("dwell_ms").alias("dwell_ms"), F.round(zero(F.col("dwell_ms") / F.col("visits")), 3).alias("avg_dwell_ms"), "visited", "pass_only", "total")


def place_detail(stays: DataFrame) -> DataFrame:
    """For each stay point total and mean dwell, the number of its days, and the first and last of them."""
    return stays.groupBy("cluster_id").agg(
        F.count("*").alias("visits"),
        F.sum(dwell_ms()).alias("dwell_ms"),
        F.round(F.avg(dwell_ms()), 3).alias("avg_dwell_ms"),
        F.countDistinct("date_str").alias("days"),
        F.min("date_str").alias("first_day"),
        F.max("date_str").alias("last_day"),
    )


def region_notes(coverage: DataFrame) -> DataFrame:
    """What a map says of each second-level region: its places, that it was only passed, or nothing."""
    note = F.when(F.col("pass_only"), "pass only").when(F.col("place_count") > 0, F.concat(F.col("place_count").cast("string"), F.when(F.col("place_count") == 1, " place").otherwise(" places"))).otherwise("unvisited")
    return coverage.select("muni_code", note.alias("note"))


def with_headings(events: DataFrame) -> DataFrame:
    """A chronology with flags where a new year and a new month begin; its rows are first visits, one for each region."""
    w = Window.partitionBy(F.lit(0)).orderBy("first_ms", F.desc("kind"), "code")
    year, month = F.substring("date_str", 1, 4), F.substring("date_str", 1, 7)
    new = lambda c: F.coalesce(F.lag(c).over(w) != c, F.lit(True))
    return events.select("kind", "code", "date_str", new(year).alias("new_year"), new(month).alias("new_month"))


def marker_sizes(ranking: DataFrame) -> DataFrame:
    """Radii of a place's pin and dot by its visits, less visited places first, as they are drawn."""
    n = F.log1p("visits")
    return ranking.select("cluster_id", F.round(6 + F.least(F.lit(10.0), 3 * n), 6).alias("pin_px"), F.round(2.5 + F.least(F.lit(4.0), n), 6).alias("dot_px")).orderBy("visits", "cluster_id")


def region_summaries(coverage: DataFrame, shown: DataFrame) -> DataFrame:
    """What is said of each second-level region: its shown stays, or why there are none: all excluded, only passed, or none at all.

    ``coverage`` knows nothing of zones, ``shown`` are the stays outside them.
    """
    s = region_ranking(shown).withColumnRenamed("muni_code", "__code")
    out = coverage.select("muni_code", "stay_count", "pass_only").join(s, F.col("muni_code") == F.col("__code"), "left")
    note = F.when(F.col("visits") > 0, "shown").when(F.col("stay_count") > 0, "all excluded").when(F.col("pass_only"), "pass only").otherwise("none")
    return out.select("muni_code", F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("dwell_ms", F.lit(0)).alias("dwell_ms"), F.col("first_ms"), F.col("last_ms"), note.alias("note"))


def fill_colors(coverage: DataFrame) -> DataFrame:
    """The colour of each second-level region on a map."""
    c = heat(coverage)
    color = F.when(F.col("kind") == "heat", heat_color(F.col("intensity"))).when(F.col("kind") == "pass_only", PASSED_COLOR).otherwise(UNVISITED_COLOR)
    return c.select("muni_code", color.alias("color"))


def stats_report(moves: DataFrame, coverage: DataFrame, hours: DataFrame, weekdays: DataFrame) -> DataFrame:
    """``section, label, value``: what a page of statistics shows: distance and trips in all and by mode, months, weekdays, hours, and visited
    shares of first-level regions in whole per cent."""
    say = lambda df, section, label, value: df.select(F.lit(section).alias("section"), F.col(label).cast("string").alias("label") if isinstance(label, str) else label.alias("label"), F.round(value.cast("double"), 3).alias("value"))
    modes = travel_by_mode(moves)
    parts = [
        say(modes.agg(F.coalesce(F.sum("trips"), F.lit(0)).alias("n")), "trips", F.lit("all"), F.col("n")),
        say(modes, "mode_km", "mode", F.col("distance_m") / 1000),
        say(travel_monthly(moves), "month_km", "month_key", F.col("distance_m") / 1000),
        say(day_of_week_means(moves, weekdays), "weekday_km", "dow", F.col("mean_m") / 1000),
        say(hourly_histogram(moves, hours), "hour", "hour", F.col("n")),
        say(visited_rates(coverage), "visited_percent", "pref_code", F.floor(F.col("rate") * 100 + 0.5)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_visit_targets(events: DataFrame, shown: DataFrame, regions: DataFrame, private: bool = False) -> DataFrame:
    """Where the events of a chronology lead: ``kind, code, pref_code, cluster_id, muni_code``.

    A first-level event leads to its region. A second-level one leads to the place of its earliest stay outside the zones, under privacy
    to the region itself; with no stay left to show, only to the first-level region.
    """
    first = shown.groupBy("muni_code").agg(F.min(F.struct("start_ms", "visit_idx", "cluster_id")).alias("f")).select(F.col("muni_code").alias("__m"), F.col("f.cluster_id").alias("__c"))
    r = regions.select(F.col("code").alias("__r"), F.col("pref_code").cast("string").alias("__p"))
    out = events.join(r, (F.col("kind") == "municipality") & (F.col("code") == F.col("__r")), "left").join(first, (F.col("kind") == "municipality") & (F.col("code") == F.col("__m")), "left")
    seen = F.col("__m").isNotNull()
    place, muni = (F.lit(None).cast("bigint"), F.when(seen, F.col("code"))) if private else (F.when(seen, F.col("__c")), F.lit(None).cast("string"))
    return out.select("kind", "code", F.coalesce("__p", "code").alias("pref_code"), place.alias("cluster_id"), muni.alias("muni_code"))
