"""Problem 4: overlapping and gapped intervals as continuous periods and the gaps between them.

Method: the intervals are range-sorted globally by entity and start, so an entity of any size spreads over as many
partitions as it needs. A first scan sums every partition up (its first and last entity, the last entity's maximum
end and last break), the summaries, a handful of numbers per partition, are prefix-combined, and a second scan
reads the sorted intervals again with the state carried in from the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.session import ensure_checkpoint_dir


def _scan(batches: Iterator[pa.RecordBatch], carry):
    """Yields (entity, breaks' starts, ends before the breaks, is first break) per batch and returns the open period.

    ``carry`` is (entity, start, maximum end) of the period open at the end of the partitions before, or None.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, start, end = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.empty(len(entity), bool)
        new[1:] = entity[1:] != entity[:-1]
        new[0] = carry is None or carry[0] != entity[0]
        heads = np.flatnonzero(new)
        top = np.empty_like(end)  # the running maximum end of the entity, with the row
        edges = [*(() if new[0] else (0,)), *heads, len(entity)]
        if len(edges) - 1 > 64:
            group = np.cumsum(new)
            order = np.argsort(end, kind="stable")
            rank = np.empty(len(end), np.int64)
            rank[order] = np.arange(len(end))
            joined = np.maximum.accumulate(group.astype(np.int64) * len(end) + rank) - group.astype(np.int64) * len(end)
            top = end[order][joined]
        else:
            for i, j in zip(edges, edges[1:]):
                top[i:j] = np.maximum.accumulate(end[i:j])
        if not new[0]:
            until = heads[0] if len(heads) else len(entity)
            top[:until] = np.maximum(top[:until], carry[2])
        before = np.empty_like(top)
        before[1:] = top[:-1]
        before[0] = carry[2] if carry is not None else 0
        breaks = np.flatnonzero(new | (start > before))
        yield entity, start, top, before, new, breaks, carry
        if len(breaks):
            carry = (int(entity[-1]), int(start[breaks[-1]]), int(top[-1]))
        else:
            carry = (carry[0], carry[1], int(top[-1]))
    return carry


def _summary(batches):
    first = None
    state = [None]

    def walk():
        state[0] = yield from _scan(batches, None)

    for entity, *_ in walk():
        first = first if first is not None else int(entity[0])
    if first is not None:
        e, s, m = state[0]
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": [first], "last": [e], "start": [s], "top": [m]})


def combine(summaries: list[tuple[int, int, int, int, int]]) -> tuple[dict, set]:
    """State carried into each partition, and the partitions whose last period ends with them.

    A summary is (partition, first entity, last entity, start of the last entity's last period as the partition alone
    sees it, its maximum end). Seen from all partitions, a break stays one only if it lies beyond the carried end.
    """
    carry, carried, closing = None, {}, set()
    ordered = sorted(summaries)
    for i, (part, first, last, start, top) in enumerate(ordered):
        carried[part] = carry
        if carry is not None and carry[0] == last:
            carry = (last, start if start > carry[2] else carry[1], max(top, carry[2]))
        else:
            carry = (last, start, top)
        if i + 1 == len(ordered) or ordered[i + 1][1] != last:
            closing.add(part)
    return carried, closing


def _rescan(carried: dict, closing: set, schema: pa.Schema):
    def run(batches):
        part = TaskContext.get().partitionId()
        state = [None]

        def walk():
            state[0] = yield from _scan(batches, carried.get(part))

        for entity, start, top, before, new, breaks, carry in walk():
            if not len(breaks):
                continue
            # A break closes the period before it, the first one the period carried in.
            opened = np.concatenate([[carry[1] if carry is not None else 0], start[breaks[:-1]]])
            owner = np.concatenate([[carry[0] if carry is not None else 0], entity[breaks[:-1]]])
            closed = before[breaks]
            ok = np.ones(len(breaks), bool)
            if carry is None:
                ok[0] = False
            elif new[breaks[0]] and breaks[0] == 0 and carry[3:] == ("done",):
                ok[0] = False
            gap = ~new[breaks]
            yield _rows(schema, owner[ok], "period", opened[ok], closed[ok])
            if gap.any():
                yield _rows(schema, entity[breaks][gap], "gap", closed[gap], start[breaks][gap])
        if state[0] is not None and part in closing and state[0][3:] != ("done",):
            e, s, m = state[0][:3]
            yield _rows(schema, np.array([e]), "period", np.array([s]), np.array([m]))

    return run


def _rows(schema, entity, kind, start, end):
    return pa.RecordBatch.from_arrays([pa.array(entity, pa.int64()), pa.array([kind] * len(entity), pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema=schema)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``entity, kind, from_ms, to_ms``: each maximal continuous stretch (``period``) and each stretch between two (``gap``).

    Intervals that touch are continuous; an interval of no length counts. Rows with a null in one of the three columns
    or an end before the start are left out; equal rows count once; an empty table gives none; other columns, whatever
    their names, do not matter. The three columns are integers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    c = lambda x: F.col(x).cast("bigint")
    rows = df.select(c(entity).alias("entity"), c(start).alias("start"), c(end).alias("end"))
    # The range sort reads its input twice, once for the bounds; what comes in is computed once and written as three numbers a row.
    rows = rows.checkpoint().where(F.col("entity").isNotNull() & F.col("start").isNotNull() & (F.col("end") >= F.col("start")))
    # Both scans must see the same partitions, also after the loss of an executor: written once, in order.
    ordered = rows.repartitionByRange("entity", "start", "end").sortWithinPartitions("entity", "start", "end").checkpoint()
    found = ordered.mapInArrow(_summary, "part bigint, first bigint, last bigint, start bigint, top bigint").collect()
    carried, closing = combine([tuple(r) for r in found])
    # A period that ends with its partition is emitted there; the next partition must not emit it again.
    parts = sorted(carried)
    for previous, part in zip(parts, parts[1:]):
        if previous in closing and carried[part] is not None:
            carried[part] = (*carried[part], "done")
    schema = pa.schema([("entity", pa.int64()), ("kind", pa.string()), ("from_ms", pa.int64()), ("to_ms", pa.int64())])
    return ordered.mapInArrow(_rescan(carried, closing, schema), "entity bigint, kind string, from_ms bigint, to_ms bigint")
