import random

import pytest

from geotrail.operators.periods import combine, periods_and_gaps
from geotrail.plans.problems import p4_found


def brute(rows):
    by = {}
    for e, a, b in rows:
        if None not in (e, a, b) and b >= a:
            by.setdefault(e, []).append((a, b))
    out = set()
    for e, spans in by.items():
        spans.sort()
        start, top = spans[0]
        for a, b in spans[1:]:
            if a > top:
                out |= {(e, "period", start, top), (e, "gap", top, a)}
                start, top = a, b
            top = max(top, b)
        out.add((e, "period", start, top))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "e bigint, a bigint, b bigint, kind string")
    return sorted(map(tuple, periods_and_gaps(df, "e", "a", "b").collect()))


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force_over_many_partitions(spark, seed):
    g = random.Random(seed)
    rows = []
    for _ in range(400):
        a = g.randrange(3000)
        # One entity holds a third of the rows; a few spans are so long that they cover whole partitions.
        rows.append((7 if g.random() < 0.33 else g.randrange(12), a, a + (g.randrange(1500) if g.random() < 0.03 else g.randrange(-3, 12))))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false" if seed % 2 else "true")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_touching_nested_inverted_empty_and_null(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 12, 15), (1, 30, 25), (1, 40, 40), (1, 40, 40), (2, None, 5), (None, 1, 2), (2, 1, None)]
    assert run(spark, rows) == [(1, "gap", 20, 40), (1, "period", 0, 20), (1, "period", 40, 40)]
    assert run(spark, []) == []


def test_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(e, a, a + 5) for e in range(3) for a in (0, 3, 20, 22, 50)]
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_summaries_combine_in_order():
    # One entity over three partitions; its long first span hides the break that the second one sees.
    carried, closing = combine([(0, 1, 1, 0, 100), (1, 1, 1, 50, 60), (2, 1, 2, 5, 9)])
    assert carried == {0: None, 1: (1, 0, 100), 2: (1, 0, 100)} and closing == {2}


def test_query_runs(spark, data):
    found = p4_found(spark, data)
    assert found.columns == ["device_id", "kind", "from_ms", "to_ms"] and found.count() > 0
