"""Days: timelines, recorded days, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.calendar import grid_cell, grid_level


def day_timeline(stays: DataFrame, moves: DataFrame) -> DataFrame:
    """Stays (numbered by start within their day) and visible moves of each subject's days in order of time."""
    w = Window.partitionBy("subject_id", "date_str").orderBy("start_ms", "visit_idx")
    s = stays.select("subject_id", "date_str", F.lit("stay").alias("kind"), F.col("visit_idx").alias("idx"), "start_ms", "end_ms", F.row_number().over(w).alias("stay_no"), F.lit(None).cast("double").alias("distance_m"))
    m = moves.select("subject_id", "date_str", F.lit("move").alias("kind"), F.col("activity_idx").alias("idx"), "start_ms", "end_ms", F.lit(None).cast("int").alias("stay_no"), "distance_m")
    order = Window.partitionBy("subject_id", "date_str").orderBy("start_ms", "kind", "idx")
    return s.unionByName(m).withColumn("position", F.row_number().over(order))


def day_summary(timeline: DataFrame) -> DataFrame:
    """Distance, time on the way and stops of each day."""
    move = F.col("kind") == "move"
    return timeline.groupBy("subject_id", "date_str").agg(
        F.round(F.coalesce(F.sum(F.when(move, F.col("distance_m"))), F.lit(0.0)), 3).alias("distance_m"),
        F.coalesce(F.sum(F.when(move, F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))), F.lit(0)).alias("moving_ms"),
        F.count_if(~move).alias("stops"),
    )


def neighbour_days(stays: DataFrame) -> DataFrame:
    """For each day at a stay point the days before and after it there."""
    days = stays.select("cluster_id", "date_str").distinct()
    w = Window.partitionBy("cluster_id").orderBy("date_str")
    return days.select("cluster_id", "date_str", F.lag("date_str").over(w).alias("prev_day"), F.lead("date_str").over(w).alias("next_day"))


def day_counts(*sources: DataFrame) -> DataFrame:
    """Records of each subject's days over any number of tables with ``subject_id, date_str``."""
    both = None
    for s in sources:
        s = s.select("subject_id", "date_str").where(F.col("date_str").isNotNull())
        both = s if both is None else both.unionByName(s)
    return both.groupBy("subject_id", "date_str").agg(F.count("*").alias("n"))


def recorded_days(counts: DataFrame) -> DataFrame:
    """Recorded days with the ones before and after."""
    w = Window.partitionBy("subject_id").orderBy("date_str")
    return counts.select("subject_id", "date_str", F.lag("date_str").over(w).alias("prev_day"), F.lead("date_str").over(w).alias("next_day"))


def calendar_grid(counts: DataFrame, year: int) -> DataFrame:
    """Every day of a year with its place in the grid, its records and their level from 0 to 4."""
    spark = counts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{year}-01-01")), F.to_date(F.lit(f"{year}-12-31")))).alias("d"))
    n = counts.groupBy("date_str").agg(F.sum("n").alias("n"))
    out = days.join(n, F.col("d").cast("string") == F.col("date_str"), "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))
    # The days of one year: 366 rows at most, whatever the input.
    out = out.withColumn("most", F.max("n").over(Window.partitionBy(F.year("d"))))
    cell = grid_cell(F.col("d"))
    return out.select(F.col("d").cast("string").alias("date_str"), cell["grid_col"].alias("grid_col"), cell["grid_row"].alias("grid_row"), "n", grid_level(F.col("n"), F.col("most")).alias("level"))


def anniversary(counts: DataFrame, today: str) -> DataFrame:
    """For each subject the recorded day nearest to a year before ``today``, within a week; of equal ones the earlier."""
    target = F.add_months(F.to_date(F.lit(today)), -12)
    diff = F.datediff(F.to_date("date_str"), target)
    near = counts.withColumn("diff", diff).where(F.abs("diff") <= 7)
    return near.groupBy("subject_id").agg(F.min(F.struct(F.abs("diff").alias("a"), "diff", "date_str")).alias("b")).select("subject_id", "b.date_str", F.col("b.diff").alias("days_off"))


def default_comparison(years: DataFrame, year: int | None) -> DataFrame:
    """The year to compare with: the latest before ``year``, else the latest other; the latest of all without one."""
    y = years.select("year").where(F.col("year").isNotNull()).distinct()
    if year is None:
        return y.agg(F.max("year").alias("year"))
    return y.agg(F.coalesce(F.max(F.when(F.col("year") < year, F.col("year"))), F.max(F.when(F.col("year") != year, F.col("year")))).alias("year"))


def year_options(*years: DataFrame) -> DataFrame:
    """The years that any table has (each with a column ``year``), for a choice; nulls and 0 are none."""
    both = None
    for y in years:
        y = y.select(F.col("year").cast("int").alias("year"))
        both = y if both is None else both.unionByName(y)
    return both.where(F.col("year") != 0).distinct().orderBy("year")


def comparison_years(years: DataFrame) -> DataFrame:
    """``year, other``: for each year the one to compare with, as in ``default_comparison``."""
    y = years.select("year").where(F.col("year").isNotNull()).distinct()
    # One row for each year of the data: a handful, whatever the input.
    w = Window.partitionBy(F.lit(0)).orderBy("year")
    later = F.max("year").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return y.select("year", F.coalesce(F.lag("year").over(w), F.nullif(later, F.col("year"))).alias("other"))


def random_day(counts: DataFrame, seed: int) -> DataFrame:
    """One recorded day of each subject, the same for the same seed: the least of the days' hashes."""
    return counts.groupBy("subject_id").agg(F.min_by("date_str", F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("subject_id").cast("string"), "date_str")), "date_str")).alias("date_str"))
