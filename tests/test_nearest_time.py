import random

import pytest

from geotrail.operators.nearest_time import nearest_in_time
from geotrail.plans.problems import p3_found


def brute(lefts, rights, tol):
    out = []
    for lid, le, lt in lefts:
        best = None
        for rid, ro, re_, rt in rights:
            if None in (lid, le, lt, rid, ro, re_, rt) or le != re_ or abs(lt - rt) > tol:
                continue
            key = (abs(lt - rt), -rt, rid, ro)
            best = min(best, key) if best else key
        if best:
            out.append((lid, best[2], best[3], best[0]))
    return sorted(out)


def run(spark, lefts, rights, tol, block=86_400_000):
    l = spark.createDataFrame(lefts, "photo bigint, e bigint, t bigint")
    r = spark.createDataFrame(rights, "seg bigint, o int, e bigint, t bigint")
    return sorted(map(tuple, nearest_in_time(l, r, left_keys=("photo", "e", "t"), right_keys=("seg", "o", "e", "t"), tolerance_ms=tol, block_ms=block).collect()))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("batch", ["7", "10000"])
def test_against_brute_force(spark, seed, batch):
    g = random.Random(seed)
    lefts = [(i, 1 if g.random() < 0.4 else g.randrange(5), g.randrange(-400, 900)) for i in range(150)]
    rights = [(g.randrange(40), g.randrange(3), 1 if g.random() < 0.4 else g.randrange(6), g.randrange(-400, 900)) for i in range(160)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for tol, block in ((0, 50), (13, 50), (50, 50), (30, 10_000)):
            assert run(spark, lefts, rights, tol, block) == brute(lefts, rights, tol)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_ties_nulls_repeats_and_empty_sides(spark):
    rights = [(5, 1, 1, 90), (4, 2, 1, 110), (4, 1, 1, 110), (9, 0, 1, None), (None, 0, 1, 100), (3, 0, None, 100)]
    lefts = [(1, 1, 100), (1, 1, 100), (2, 1, None), (3, None, 100), (None, 1, 100)]
    assert run(spark, lefts, rights, 10) == [(1, 4, 1, 10)] * 2
    assert run(spark, [], rights, 10) == [] and run(spark, lefts, [], 10) == []
    with pytest.raises(ValueError):
        run(spark, lefts, rights, 100, 10)


def test_many_lefts_after_the_last_right(spark):
    lefts = [(i, 1, 1000 + i) for i in range(500)]
    assert run(spark, lefts, [(1, 0, 1, 1000)], 20) == [(i, 1, 0, i) for i in range(21)]


def test_query_runs(spark, data):
    assert p3_found(spark, data).columns == ["photo_id", "segment_id", "point_no"]
    assert p3_found(spark, data).count() > 0
