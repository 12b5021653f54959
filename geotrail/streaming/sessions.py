"""Path points that keep coming: sessions that end after a pause, and running totals by day."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import haversine_m
from geotrail.operators.asof import BLOCK_MS, runs


def point_sessions(points: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """``subject_id, start, end, points, reach_m`` of each session of a stream (or table) of ``subject_id, ts, lat, lng``.

    A session ends after a pause of ``gap``; rows later than ``late`` behind the newest are dropped by the watermark. The reach is the
    diagonal of the session's box, which can be kept up without order. Rows of a table are cut into blocks of time (``operators.asof.runs``), so
    that a subject with a third of all rows is not one task's work; a stream keeps the state of its open sessions only.
    """
    sums = [F.count("*").alias("points"), F.min("lat").alias("a"), F.min("lng").alias("b"), F.max("lat").alias("c"), F.max("lng").alias("d")]
    reach = F.round(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 3)
    if not points.isStreaming:
        pause = pd.Timedelta(gap) // pd.Timedelta(microseconds=1)
        rows = points.where(F.col("ts").isNotNull()).select("subject_id", "lat", "lng", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(0).alias("one"))
        # A pause of the gap itself ends a session.
        numbered = runs(rows, by="subject_id", time="us", order=["us"], value="one", gap_ms=pause - 1, block_ms=BLOCK_MS * 1000)
        out = numbered.groupBy("subject_id", "run_no").agg(F.min("us").alias("s"), F.max("us").alias("e"), *sums)
        return out.select("subject_id", F.timestamp_micros("s").alias("start"), F.timestamp_micros(F.col("e") + pause).alias("end"), "points", reach.alias("reach_m"))
    w = points.withWatermark("ts", late).groupBy("subject_id", F.session_window("ts", gap).alias("w"))
    out = w.agg(*sums)
    return out.select("subject_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "points", reach.alias("reach_m"))


def daily_distance(moves: DataFrame, late: str = "1 day") -> DataFrame:
    """``day, mode, distance_m, trips`` of a stream (or table) of ``ts, mode, distance_m``."""
    w = moves.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "mode")
    return w.agg(F.sum("distance_m").alias("distance_m"), F.count("*").alias("trips")).select(F.col("w.start").alias("day"), "mode", "distance_m", "trips")
