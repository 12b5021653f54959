"""As-of joins and runs against plain Python, and the shape of their plans."""

import random

from pyspark.sql import functions as F

from geotrail.operators import routes as U
from geotrail.operators.asof import asof, runs

DAY = 86_400_000


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_frame_is_read_again_for_each_row(spark):
    """A frame from the current row to the end costs the square of a block's rows; a dense table is one block for each subject."""
    points = spark.range(4).selectExpr("id % 2 AS subject_id", "id AS point_idx", "id * 1000 AS t_ms", "1.0D AS lat", "2.0D AS lng")
    moves = spark.range(4).selectExpr("id % 2 AS subject_id", "id AS activity_idx", "id * 900 AS start_ms", "id * 900 + 500 AS end_ms", "'BUS' AS mode")
    assert "unboundedfollowing" not in plan(asof(points, moves, by="subject_id", left_time="t_ms", right_time="start_ms", payload=["activity_idx"], forward=True))
    modes = U.point_modes(points, moves)
    assert "unboundedfollowing" not in plan(modes) and "unboundedfollowing" not in plan(U.route_runs(modes))


def test_both_ways_with_ties_gaps_and_no_times(spark):
    rng = random.Random(5)
    # Blocks without right rows, subjects without any, equal times, and rows without a time.
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *[rng.randrange(60) * DAY // 2 - 9 * DAY for _ in range(9)]])) for i in range(300)]
    right = [(rng.choice([1, 2, None]), rng.choice([None, rng.randrange(8) * DAY // 2, rng.randrange(30, 34) * DAY // 2]), i) for i in range(40)]
    a = spark.createDataFrame(left, "i int, who int, t bigint")
    b = spark.createDataFrame(right, "who int, r bigint, k int")
    for forward in (False, True):
        got = {x["i"]: (x["r"], x["k"]) for x in asof(a, b, by="who", left_time="t", right_time="r", payload=["k"], forward=forward).collect()}
        assert len(got) == len(left)
        for i, who, t in left:
            near = [(r, k) for w, r, k in right if w == who and None not in (r, t) and (r >= t if forward else r <= t)]
            assert got[i] == ((min if forward else max)(near) if near else (None, None)), (i, who, t, forward)


def test_runs_over_blocks(spark):
    rng = random.Random(8)
    rows, t = [], {1: 0, 2: 0}
    for i in range(400):
        who = rng.choice([1, 2])
        t[who] += rng.choice([0, 1, 1, 40, 3000])
        rows.append((i, who, None if rng.random() < 0.1 else t[who], rng.choice(["a", "a", "a", "b", None])))
    df = spark.createDataFrame(rows, "i int, who int, t bigint, v string")
    got = {x["i"]: (x["is_break"], x["run_no"]) for x in runs(df, by="who", time="t", order=["i"], value="v", gap_ms=100, block=F.floor(F.col("i") / 7)).collect()}
    want = {}
    for who in (1, 2):
        n, before, last = 0, None, None
        for i, w, at, v in rows:
            if w == who:
                new = (None not in (before, v) and before != v) or (None not in (at, last) and at - last > 100)
                n += new
                want[i], before, last = (new, n), v, last if at is None else at
    assert got == want
