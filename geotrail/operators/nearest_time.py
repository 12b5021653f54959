"""Problem 3: the nearest record in time of the same entity.

Method: both sides are put into one stream, repartitioned by entity and block of time, sorted within partitions, and
read by a two-pointer streaming merge that holds only the neighbouring right records. An entity's time is cut
into blocks, so that an entity with a third of all rows spreads over many tasks; right records within the
tolerance of a block's edge are also sent to the neighbouring block, so no pair is lost at an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = np.iinfo(np.int64).min // 4
_HIGH = np.iinfo(np.int64).max // 4


class _Merge:
    """The streaming merge over batches sorted by group, time, side (right first), rank."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.group = None  # (entity, block) at the end of what was read
        self.last = (_LOW, 0, 0)  # the last right time with its smallest record
        self.wait = np.zeros((0, 5), np.int64)  # lefts after the last right: id, time, and their backward neighbour

    def batch(self, entity, block, time, right, a, b):
        n = len(time)
        new = np.empty(n, bool)
        new[1:] = (entity[1:] != entity[:-1]) | (block[1:] != block[:-1])
        new[0] = self.group != (entity[0], block[0])
        group = np.cumsum(new) if not new[0] else np.cumsum(new) - 1
        carried = not new[0]  # group 0 goes on from the batch before
        at = np.flatnonzero(right)
        # Of rights at one instant only the first, the smallest record, can be a match.
        if len(at):
            first = np.ones(len(at), bool)
            first[1:] = (group[at][1:] != group[at][:-1]) | (time[at][1:] != time[at][:-1])
            if carried and group[at[0]] == 0 and time[at[0]] == self.last[0]:
                first[0] = False
            at = at[first]
        left = np.flatnonzero(~right)
        out = []
        # Backward neighbour: the last right of the group at or before the left.
        k = np.searchsorted(at, left) - 1
        has = (k >= 0) & (group[at[np.maximum(k, 0)]] == group[left]) if len(at) else np.zeros(len(left), bool)
        back = np.full((len(left), 3), (_LOW, 0, 0), np.int64)
        if len(at):
            j = at[np.maximum(k, 0)]
            back[has] = np.stack([time[j], a[j], b[j]], 1)[has]
        if carried:
            back[~has & (group[left] == 0)] = self.last
        # Forward neighbour: the first right of the group after the left, if this batch has it.
        f = np.searchsorted(at, left)
        fwd = np.full((len(left), 3), (_HIGH, 0, 0), np.int64)
        seen = np.zeros(len(left), bool)
        if len(at):
            j = at[np.minimum(f, len(at) - 1)]
            seen = (f < len(at)) & (group[j] == group[left])
            fwd[seen] = np.stack([time[j], a[j], b[j]], 1)[seen]
        lefts = np.stack([a[left], time[left]], 1) if len(left) else np.zeros((0, 2), np.int64)
        # Lefts that waited for a right of their group, now the first one in group 0.
        if len(self.wait):
            if not carried:
                out.append(self._pick(self.wait[:, :2], self.wait[:, 2:], None))
                self.wait = self.wait[:0]
            elif len(at) and group[at[0]] == 0:
                j = at[0]
                out.append(self._pick(self.wait[:, :2], self.wait[:, 2:], np.tile(np.array([time[j], a[j], b[j]]), (len(self.wait), 1))))
                self.wait = self.wait[:0]
            else:
                late = time[-1] - self.wait[:, 1] > self.tolerance if group[-1] == 0 else np.ones(len(self.wait), bool)
                out.append(self._pick(self.wait[late, :2], self.wait[late, 2:], None))
                self.wait = self.wait[~late]
        # Only lefts in the last group, near its end, may still meet a right.
        open_ = ~seen & (group[left] == group[-1]) & (time[-1] - time[left] <= self.tolerance)
        out.append(self._pick(lefts[~open_], back[~open_], fwd[~open_]))
        self.wait = np.concatenate([self.wait, np.concatenate([lefts[open_], back[open_]], 1)])
        if len(at) and group[at[-1]] == group[-1]:
            j = at[-1]
            self.last = (time[j], a[j], b[j])
        elif group[-1] != 0 or not carried:
            self.last = (_LOW, 0, 0)
        self.group = (entity[-1], block[-1])
        return [x for x in out if len(x)]

    def _pick(self, lefts, back, fwd):
        before = lefts[:, 1] - back[:, 0]
        after = (fwd[:, 0] if fwd is not None else _HIGH) - lefts[:, 1]
        later = after <= before
        gap = np.where(later, after, before)
        chosen = np.where(later[:, None], fwd, back) if fwd is not None else back
        ok = gap <= self.tolerance
        return np.concatenate([lefts[ok, :1], chosen[ok, 1:], gap[ok, None]], 1)

    def end(self):
        rows = self._pick(self.wait[:, :2], self.wait[:, 2:], None)
        return [rows] if len(rows) else []


def _merge_batches(tolerance: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _Merge(tolerance)
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], schema=schema)
        for batch in batches:
            if batch.num_rows:
                entity, block, time, side, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for rows in merge.batch(entity, block, time, side == 0, a, b):
                    yield emit(rows)
        for rows in merge.end():
            yield emit(rows)

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_keys: tuple[str, str, str],
    right_keys: tuple[str, str, str, str],
    tolerance_ms: int,
    block_ms: int = 86_400_000,
) -> DataFrame:
    """Each left record with the nearest right record of its entity, if one is within ``tolerance_ms``.

    ``left_keys`` are the columns (id, entity, time), ``right_keys`` (id, order, entity, time); ids and orders are
    integers, times milliseconds. Returns ``left_id, right_id, right_order, gap_ms``. Of two equally near records the later
    one wins, of records at one instant the smallest id, then order. Rows with a null entity, time or id match nothing;
    equal left rows each give their row; equal right rows count once; empty tables give none. Other columns do
    not matter, whatever their names. Works on at most one block of one entity's time in order, never holding more
    than the left records of one tolerance.
    """
    if not 0 <= tolerance_ms <= block_ms:
        raise ValueError("tolerance_ms must lie between 0 and block_ms")
    c = lambda name: F.col(name).cast("bigint")
    block = lambda t: F.floor(t / F.lit(block_ms)).cast("bigint")
    lid, lent, lt = (c(x) for x in left_keys)
    rid, rord, rent, rt = (c(x) for x in right_keys)
    whole = lambda *cs: [x.isNotNull() for x in cs]

    def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
        for x in conditions:
            df = df.where(x)
        return df

    lefts = where_all(left, whole(lid, lent, lt)).select(
        lent.alias("entity"), block(lt).alias("block"), lt.alias("time"), F.lit(1).alias("side"), lid.alias("a"), F.lit(0).cast("bigint").alias("b")
    )
    rights = where_all(right, whole(rid, rord, rent, rt)).select(
        rent.alias("entity"),
        F.explode(F.array_distinct(F.array(block(rt), block(rt - tolerance_ms), block(rt + tolerance_ms)))).alias("block"),
        rt.alias("time"),
        F.lit(0).alias("side"),
        rid.alias("a"),
        rord.alias("b"),
    )
    schema = pa.schema([(x, pa.int64()) for x in ("left_id", "right_id", "right_order", "gap_ms")])
    return (
        lefts.unionByName(rights)
        .repartition("entity", "block")
        .sortWithinPartitions("entity", "block", "time", "side", "a", "b")
        .mapInArrow(_merge_batches(tolerance_ms, schema), "left_id bigint, right_id bigint, right_order bigint, gap_ms bigint")
    )
