"""Route segments: modes of path points, runs, inferred lines, and what exclusion zones leave of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import haversine_m
from geotrail.operators.asof import around, runs, with_global_index
from geotrail.operators.filters import flag_near
from geotrail.session import ensure_checkpoint_dir

#: The longest pause within a run and the shortest cut that is marked, in ms.
MOST_GAP_MS, CUT_MS = 20 * 60_000, 60_000


def point_modes(points: DataFrame, moves: DataFrame) -> DataFrame:
    """``points`` with ``mode`` and ``inside_idx``: the last move that began, if the point lies in it; else the nearest by start; else UNKNOWN.

    Only the last move that began is asked whether it still goes on; a move without an end does. Of two starts equally near
    the later one is nearest. Runs and inferred lines both read the result, runs twice; whoever asks for both should keep it.
    """
    starts = moves.select("subject_id", "start_ms", "activity_idx", "mode", "end_ms")
    out = around(points, starts, by="subject_id", left_time="t_ms", right_time="start_ms", payload=["activity_idx", "mode", "end_ms"], ways={"__last": False, "__next": True})
    last, following = F.col("__last"), F.col("__next")
    inside = last.isNotNull() & (last["end_ms"].isNull() | (F.col("t_ms") <= last["end_ms"]))
    later = following.isNotNull() & (last.isNull() | (following["__rt"] - F.col("t_ms") <= F.col("t_ms") - last["__rt"]))
    mode = F.when(inside, last["mode"]).when(later, following["mode"]).otherwise(F.coalesce(last["mode"], F.lit("UNKNOWN")))
    tier = F.when(inside, "inside").when(last.isNotNull() | following.isNotNull(), "nearest").otherwise("none")
    return out.select(*points.columns, mode.alias("mode"), F.when(inside, last["activity_idx"]).alias("inside_idx"), tier.alias("tier"))


#: Points of a subject that one task numbers where they keep the order they came in.
SOURCE_BLOCK = 100_000


def route_runs(points: DataFrame, source_order: str | None = None) -> DataFrame:
    """Rows of points per run: a run ends where the mode changes or after a pause, and the point there also ends the run before.

    ``points`` need ``mode``. They follow each other by time, or as they came by the integer column ``source_order``; then the pause is
    counted from the last point with a time. Runs of fewer than two points are left out.
    """
    if source_order is None:
        numbered = runs(points, by="subject_id", time="t_ms", order=["t_ms", "point_idx"], value="mode", gap_ms=MOST_GAP_MS)
    else:
        block = F.floor(F.col(source_order) / F.lit(SOURCE_BLOCK)).cast("bigint")
        numbered = runs(points, by="subject_id", time="t_ms", order=[source_order], value="mode", gap_ms=MOST_GAP_MS, block=block)
    # The breaking point closes the run before: same place and time, run number one less.
    part = lambda less: F.struct((F.col("run_no") - less).alias("run_no"), F.lit(less).alias("shared"))
    runs_of = F.when(F.col("is_break"), F.array(part(0), part(1))).otherwise(F.array(part(0)))
    return numbered.withColumn("__of", F.explode(runs_of)).withColumns({"run_no": F.col("__of.run_no"), "shared": F.col("__of.shared")}).drop("__of")


def run_segments(run_points: DataFrame, source_order: str | None = None) -> DataFrame:
    """One row per run: ``points`` in order, the mode of the run's own points, and its times."""
    pack = F.sort_array(F.collect_list(F.struct(*([source_order] if source_order else []), F.col("t_ms").alias("t"), F.col("point_idx").alias("i"), "lat", "lng")))
    mode = F.max(F.when(F.col("shared") == 0, F.col("mode")))
    out = run_points.groupBy("subject_id", "run_no").agg(pack.alias("points"), mode.alias("mode")).where(F.size("points") >= 2)
    return out.select("subject_id", "run_no", "mode", F.lit(False).alias("inferred"), "points", F.col("points")[0]["t"].alias("start_ms"), F.element_at("points", -1)["t"].alias("end_ms"))


def inferred_segments(moves: DataFrame, modes: DataFrame) -> DataFrame:
    """Straight lines for moves that no path point lies in and whose both ends are known."""
    covered = modes.where(F.col("inside_idx").isNotNull()).select(F.col("inside_idx").alias("activity_idx")).distinct()
    bare = moves.join(covered, "activity_idx", "left_anti")
    return bare.where(F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull() & F.col("end_lat").isNotNull() & F.col("end_lng").isNotNull())


def trimmed_segments(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """What zones leave of each segment: pieces of at least two points, with their own times; ``trimmed`` unless nothing was cut. ``segments`` are read twice."""
    points = segments.select("subject_id", "run_no", "mode", F.size("points").alias("whole"), F.posexplode("points").alias("n", "p"))
    points = points.select("*", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    flagged = flag_near(points, "lat", "lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), "hidden")
    key = ["subject_id", "run_no"]
    w = Window.partitionBy(*key).orderBy("n")
    piece = F.sum(F.col("hidden").cast("int")).over(w)
    left = flagged.withColumn("piece", piece).where(~F.col("hidden"))
    out = left.groupBy(*key, "piece").agg(F.first("mode").alias("mode"), F.first("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("n", "p"))).alias("np")).where(F.size("np") >= 2)
    out = out.withColumn("points", F.transform("np", lambda x: x["p"])).withColumn("trimmed", F.size("np") != F.col("whole"))
    return out.select(*key, "piece", "mode", "trimmed", "points", F.col("points")[0]["t"].alias("start_ms"), F.element_at("points", -1)["t"].alias("end_ms"))


#: Stretches of time whose rows one task reads in order.
SEEN_BLOCK_MS = 86_400_000
#: Lengths are added as whole metres and these parts of one, both as integers, so that what is left of large sums is as exact as a sum of its own.
_PARTS = 100_000_000_000
_SUMS = ["__n", "__metres", "__parts", "__c"]


def _marks(segments: DataFrame) -> DataFrame:
    """``subject_id``, two times ``__from`` and ``__to``, and ``_SUMS``: a row for each line between successive points, and one for each cut piece.

    A line counts for a move if it begins from the move's start on and ends by its end; a cut piece if it ends and begins so.
    """
    n = F.size("points")
    # The last point goes with the first: the piece as a whole, with its end before its begin.
    pairs = F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", 2, n - 1), F.slice("points", 1, 1)).alias("q"))
    out = segments.select("subject_id", "trimmed", (n - 1).alias("lines"), F.posexplode(pairs).alias("i", "l"))
    line = F.col("i") < F.col("lines")
    out = out.where((line | F.col("trimmed")) & F.col("l.p.t").isNotNull() & F.col("l.q.t").isNotNull())
    m = F.when(line, haversine_m(F.col("l.p.lat"), F.col("l.p.lng"), F.col("l.q.lat"), F.col("l.q.lng")))
    out = out.select("subject_id", F.col("l.p.t").alias("__from"), F.col("l.q.t").alias("__to"), line.cast("bigint").alias("__n"), F.coalesce(m, F.lit(0.0)).alias("m"), (~line).cast("bigint").alias("__c"))
    whole = F.floor("m")
    return out.select("subject_id", "__from", "__to", "__n", whole.alias("__metres"), F.floor((F.col("m") - whole) * _PARTS + 0.5).alias("__parts"), "__c")


def _seen_block(at: Column) -> Column:
    return F.floor(at / SEEN_BLOCK_MS).cast("bigint")


def _seen_heads(marks: DataFrame, moves: DataFrame) -> DataFrame:
    """What each block of a subject starts with, for both ways: what those before it add up to; turned round, less all there is."""
    both = lambda a, b: F.explode(F.array(F.struct(F.lit(-1).alias("__way"), (-a).alias("__at")), F.struct(F.lit(1).alias("__way"), b.alias("__at"))))
    rows = marks.select("subject_id", both(F.col("__from"), F.col("__to")).alias("r"), *_SUMS).select("subject_id", "r.*", *_SUMS, F.when(F.col("__n") > 0, F.col("r.__at")).alias("__last"))
    asked = moves.where(F.col("start_ms") <= F.col("end_ms")).select("subject_id", both(F.col("start_ms"), F.col("end_ms")).alias("r")).select("subject_id", "r.*", *[F.lit(0).cast("bigint").alias(c) for c in _SUMS], F.lit(None).cast("bigint").alias("__last"))
    blocks = rows.unionByName(asked).groupBy("subject_id", "__way", _seen_block(F.col("__at")).alias("__b")).agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("__last").alias("__last"))
    blocks = blocks.withColumn("__metres", F.col("__metres") + F.expr(f"__parts div {_PARTS}")).withColumn("__parts", F.col("__parts") % _PARTS)
    every = Window.partitionBy("subject_id", "__way")
    before = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) - F.when(F.col("__way") < 0, F.sum(c).over(every)).otherwise(0)
    return blocks.select("subject_id", "__way", "__b", *[carried(c).alias(c) for c in _SUMS], F.max("__last").over(before).alias("__last"))


def _seen_upto(asks: DataFrame, marks: DataFrame, heads: DataFrame, way: int, asked: Column, at: str, name: str) -> DataFrame:
    """``asks`` with a struct ``name`` of what the marks up to ``asked`` add up to (way -1: from ``asked`` on, as time is turned round) and the last line's time."""
    sums = [*_SUMS, "__last"]
    lines = marks.select("subject_id", (F.col(at) * way).alias("__at"), *_SUMS).withColumn("__last", F.when(F.col("__n") > 0, F.col("__at")))
    blocked = lines.withColumn("__side", F.lit(0)).unionByName(asks.withColumn("__at", asked * way).withColumn("__side", F.lit(1)), allowMissingColumns=True).withColumn("__b", _seen_block(F.col("__at")))
    rows = blocked.unionByName(heads.where(F.col("__way") == way).drop("__way").withColumn("__side", F.lit(0)), allowMissingColumns=True)
    # Heads have no time and come first; at one instant lines and cuts come before what is asked. What has no time meets nothing.
    upto = Window.partitionBy("subject_id", "__b").orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.struct(*[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in _SUMS], (F.max("__last").over(upto) * way).alias("__last"))
    return rows.select(*asks.columns, "__side", found.alias(name)).where(F.col("__side") == 1).drop("__side")


def _seen_parts(moves: DataFrame, segments: DataFrame) -> DataFrame:
    """``moves`` with ``cut, v0, v1, v_m``: whether a trimmed piece overlaps the move, and the times and length of the path within it.

    Pieces of a subject follow each other in time, so the lines between successive points are in order by their begins and by their ends.
    Those within a move are what ended by its end, and what began from its start on, less all of them. One running sum has the first; the
    second is the same sum with time turned round. A move is one row of each of the two, however many pieces it meets, and keeps its
    columns, so that nothing is joined.
    """
    ensure_checkpoint_dir(moves.sparkSession)
    marks = _marks(segments).checkpoint()
    heads = _seen_heads(marks, moves).checkpoint()
    timed = F.col("start_ms") <= F.col("end_ms")
    out = _seen_upto(moves, marks, heads, 1, F.when(timed, F.col("end_ms")), "__to", "__up")
    out = _seen_upto(out, marks, heads, -1, F.when(timed, F.col("start_ms")), "__from", "__down")
    both = lambda c: F.col(f"__up.{c}") + F.col(f"__down.{c}")
    seen = lambda c: F.when(both("__n") > 0, c)
    return out.select(*moves.columns, (both("__c") > 0).alias("cut"), seen(F.col("__down.__last")).alias("v0"), seen(F.col("__up.__last")).alias("v1"), seen(both("__metres") + both("__parts") / _PARTS).alias("v_m"))


def visible_moves(moves: DataFrame, segments: DataFrame, zones: DataFrame) -> DataFrame:
    """What may be shown of each move: all of it if it touches no zone, else the visible part of its path, or nothing.

    ``segments`` are trimmed ones of runs by time. A move touches a zone if an end lies in one or a piece that overlaps it in time was cut.
    """
    ends = flag_near(moves, "start_lat", "start_lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), "start_hidden")
    ends = flag_near(ends, "end_lat", "end_lng", zones, "zone_lat", "zone_lng", F.col("radius_m"), "end_hidden")
    ends = ends.select("subject_id", "activity_idx", "mode", "date_str", "start_ms", "end_ms", "distance_m", (F.col("start_hidden") | F.col("end_hidden")).alias("hidden"))
    out = _seen_parts(ends, segments)
    touches = F.col("hidden") | F.col("cut")
    part = lambda a, b: F.when(touches, a).otherwise(b)
    out = out.withColumn("partial", touches).where(~F.col("partial") | F.col("v0").isNotNull())
    return out.select(
        "subject_id",
        "activity_idx",
        "mode",
        "date_str",
        "partial",
        part(F.col("v0"), F.col("start_ms")).alias("start_ms"),
        part(F.col("v1"), F.col("end_ms")).alias("end_ms"),
        F.round(part(F.col("v_m"), F.col("distance_m").cast("double")), 3).alias("distance_m"),
        part(F.col("v0") - F.col("start_ms") > CUT_MS, F.lit(False)).alias("start_cut"),
        part(F.col("end_ms") - F.col("v1") > CUT_MS, F.lit(False)).alias("end_cut"),
    )


def without_modes(segments: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Segments but for those of hidden modes."""
    return segments.where(~F.coalesce(F.col("mode").isin(*hidden), F.lit(False))) if hidden else segments


def even_sample(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows, evenly spread over the order; the feature is the thinning itself."""
    n = df.count()
    if n <= most:
        return df
    ranked = with_global_index(df, [order], "__i")
    # Row i is kept if it is the floor of some j * n / most.
    j = F.ceil(F.col("__i") * most / n)
    return ranked.where(F.floor(j * n / most) == F.col("__i")).drop("__i")
