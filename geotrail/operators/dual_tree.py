"""Problem 2: points near other points, and the region that contains a point, by dual-tree joins.

Method: both sides are summed up into the leaves of a quad tree (counts and bounding boxes, never points), the nodes of
two trees over them are compared recursively from the roots: pairs that cannot be near are discarded, and the other pairs of leaves
become tasks. Every task holds a bounded number of points, builds a tree over each side and goes on in the same way down to single points,
where pairs of nodes that are certainly near are accepted wholesale.

Boxes are those of unit vectors, so distances have no seam at the date line or the poles. The tree is cut where a node has
few enough points; a node that cannot be cut (many points at one spot) is dealt out in blocks, each block against
each, so that no place needs more memory than others and no pair is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.session import ensure_checkpoint_dir

EARTH_M = 6_371_000.0
#: The finest level of the quad tree; bounds of what the driver holds of it and sends out: cut nodes of a level, pairs of near leaves.
FINE, MOST_NODES, MOST_PAIRS = 16, 20_000, 5_000_000
#: Edges of regions that one task holds.
TASK_EDGES = 2_000_000
_FRINGE = 1e-9


def xyz_columns(lat: Column, lng: Column) -> list[Column]:
    """The unit vector of a place."""
    a, b = F.radians(lat), F.radians(lng)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def _xyz(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


def haversine_m(lat1, lng1, lat2, lng2) -> np.ndarray:
    """Great-circle metres."""
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.subtract(lng2, lng1)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class Tree:
    """A balanced box tree over items that are boxes (points are boxes of no size)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, leaf: int = 32):
        n = len(low)
        self.order = np.arange(n)
        centre = (low + high) / 2
        starts, ends, kids, stack = [], [], [], [(0, n, -1, 0)]
        while stack:
            s, e, parent, slot = stack.pop()
            me = len(starts)
            starts.append(s)
            ends.append(e)
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][slot] = me
            if e - s > leaf:
                part = centre[self.order[s:e]]
                axis = int(np.argmax(part.max(0) - part.min(0)))
                m = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(part[:, axis], m)]
                stack += [(s, s + m, me, 0), (s + m, e, me, 1)]
        self.start, self.end, self.kids = np.array(starts, np.int64), np.array(ends, np.int64), np.array(kids, np.int64).reshape(-1, 2)
        self.low, self.high = np.empty((len(starts), low.shape[1])), np.empty((len(starts), low.shape[1]))
        ordered_low, ordered_high = low[self.order], high[self.order]
        for i in range(len(starts) - 1, -1, -1):
            a, b = self.kids[i]
            if a < 0:
                self.low[i], self.high[i] = ordered_low[starts[i] : ends[i]].min(0), ordered_high[starts[i] : ends[i]].max(0)
            else:
                self.low[i], self.high[i] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])


def _bounds2(al, ah, bl, bh):
    apart = np.maximum(0.0, np.maximum(al - bh, bl - ah))
    across = np.maximum(ah - bl, bh - al)
    return (apart**2).sum(1), (across**2).sum(1)


def dual_traverse(a: Tree, b: Tree, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """(certain, uncertain) pairs of nodes; the uncertain ones are leaves on both sides."""
    far, near = (chord * (1 + _FRINGE) + 1e-12) ** 2, (chord * (1 - 1e-6)) ** 2
    pairs = np.zeros((1, 2), np.int64)
    certain, unsure = [], []
    while len(pairs):
        i, j = pairs[:, 0], pairs[:, 1]
        least, most = _bounds2(a.low[i], a.high[i], b.low[j], b.high[j])
        maybe = least <= far
        sure = maybe & (most <= near)
        certain.append(pairs[sure])
        pairs = pairs[maybe & ~sure]
        i, j = pairs[:, 0], pairs[:, 1]
        a_leaf, b_leaf = a.kids[i, 0] < 0, b.kids[j, 0] < 0
        unsure.append(pairs[a_leaf & b_leaf])
        size_a, size_b = a.end[i] - a.start[i], b.end[j] - b.start[j]
        cut_a = ~a_leaf & (b_leaf | (size_a >= size_b))
        cut_b = ~b_leaf & ~cut_a
        pa_, pb_ = pairs[cut_a], pairs[cut_b]
        pairs = np.concatenate(
            [np.stack([a.kids[pa_[:, 0], k], pa_[:, 1]], 1) for k in (0, 1)] + [np.stack([pb_[:, 0], b.kids[pb_[:, 1], k]], 1) for k in (0, 1)]
        )
    return np.concatenate(certain), np.concatenate(unsure)


def _expand(a: Tree, b: Tree, pairs: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The items of pairs of nodes, in pieces of bounded size."""
    size_a, size_b = a.end[pairs[:, 0]] - a.start[pairs[:, 0]], b.end[pairs[:, 1]] - b.start[pairs[:, 1]]
    total = np.cumsum(size_a * size_b)
    at = 0
    while at < len(pairs):
        base = total[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(total, base + at_once, "right")))
        for p in (pairs[at:until],) if until > at + 1 or total[until - 1] - base <= at_once else ():
            sa, sb = size_a[at:until], size_b[at:until]
            n = sa * sb
            which = np.repeat(np.arange(len(p)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield a.order[a.start[p[which, 0]] + k // sb[which]], b.order[b.start[p[which, 1]] + k % sb[which]]
        if until == at + 1 and total[at] - base > at_once:
            # One pair of large nodes, all of it near: row by row of the left side.
            (i, j) = pairs[at]
            right = b.order[b.start[j] : b.end[j]]
            step = max(1, at_once // len(right))
            for s in range(a.start[i], a.end[i], step):
                left = a.order[s : min(s + step, a.end[i])]
                yield np.repeat(left, len(right)), np.tile(right, len(left))
        at = until


def near_pairs(lat_a, lng_a, lat_b, lng_b, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of all pairs at most ``radius_m`` apart, in pieces."""
    if not len(lat_a) or not len(lat_b):
        return
    xa, xb = _xyz(lat_a, lng_a), _xyz(lat_b, lng_b)
    a, b = Tree(xa, xa), Tree(xb, xb)
    certain, unsure = dual_traverse(a, b, chord_of(radius_m))
    yield from _expand(a, b, certain)
    for i, j in _expand(a, b, unsure):
        ok = haversine_m(lat_a[i], lng_a[i], lat_b[j], lng_b[j]) <= radius_m
        yield i[ok], j[ok]


def chord_of(radius_m: float) -> float:
    """The straight distance of two unit vectors ``radius_m`` apart on the earth."""
    return 2 * float(np.sin(min(radius_m / EARTH_M, np.pi) / 2))


# ---- the upper tree -------------------------------------------------------------------------------------------------


def _cell(lat: Column, lng: Column) -> Column:
    """The cell of the finest level: row times 2**16 and column."""
    n = 1 << FINE
    ix = F.least(F.lit(n - 1), F.floor((lng + 180) / 360 * n).cast("int"))
    iy = F.least(F.lit(n - 1), F.floor((lat + 90) / 180 * n).cast("int"))
    return (iy.cast("bigint") * n + ix).alias("cell")


def _morton(cell: np.ndarray) -> np.ndarray:
    """Cells in the order of the quad tree, in which every node is one stretch of numbers."""

    def spread(v):
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v | (v << shift)) & mask
        return v

    return (spread(cell >> FINE) << 1) | spread(cell & ((1 << FINE) - 1))


@dataclass
class Leaves:
    """The leaves of the quad tree in its order: where each begins, and per side its count and box (x, y, z, lat, lng)."""

    starts: np.ndarray
    count: np.ndarray  # leaf x side
    low: np.ndarray  # leaf x side x 5
    high: np.ndarray

    def of(self, cell: np.ndarray) -> np.ndarray:
        """The leaf of each cell."""
        return np.searchsorted(self.starts, _morton(cell), "right") - 1


_AXES = ("x", "y", "z", "lat", "lng")


def cell_summaries(points: list[DataFrame]) -> DataFrame:
    """One row for each occupied cell of the finest level and side: count and box. Written once, as the tree is cut and summed up from it."""
    frames = []
    for side, p in enumerate(points):
        p = p.select(_cell(F.col("lat"), F.col("lng")), *xyz_columns(F.col("lat"), F.col("lng")), "lat", "lng")
        frames.append(p.groupBy("cell").agg(F.lit(side).alias("side"), F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in _AXES], *[F.max(c).alias(f"hi_{c}") for c in _AXES]))
    both = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    ensure_checkpoint_dir(both.sparkSession)
    return both.checkpoint()


def quad_leaves(summaries: DataFrame, sides: int, leaf_points: int) -> Leaves:
    """Leaves of at most ``leaf_points`` points of all sides together, as far as cells of the finest level allow.

    The tree is cut by Spark: every cell is added to its ancestors, and only nodes with more points than a leaf come to the driver, at
    most points / ``leaf_points`` of each level; then one summary of each leaf. ``leaf_points`` grows with the points so that
    there are never more than ``MOST_NODES`` such nodes of a level, so what is collected and sent out has a bound.
    """
    names = [f"{e}_{c}" for e in ("lo", "hi") for c in _AXES]
    merged = [F.sum("n").alias("n"), *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in _AXES], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in _AXES]]

    def filled(starts: np.ndarray, rows: pa.Table) -> Leaves:
        out = Leaves(starts, np.zeros((len(starts), sides)), np.full((len(starts), sides, 5), np.inf), np.full((len(starts), sides, 5), -np.inf))
        if rows.num_rows:
            at = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            values = np.stack([rows.column(k).to_numpy().astype(float) for k in range(2, 13)], 1)
            out.count[at], out.low[at], out.high[at] = values[:, 0], values[:, 1:6], values[:, 6:]
        return out

    root = summaries.groupBy("side").agg(*merged).select(F.lit(0).alias("leaf"), "side", "n", *names).toArrow()
    total = sum(root.column(2).to_pylist())
    if total <= leaf_points:
        return filled(np.zeros(1, np.int64), root)
    leaf_points = max(leaf_points, -(-total // MOST_NODES))
    shift = f"shiftright(shiftright(cell, {FINE}), {FINE} - level) * {1 << FINE} + shiftright(cell & {(1 << FINE) - 1}, {FINE} - level)"
    above = summaries.select(F.explode(F.sequence(F.lit(0), F.lit(FINE))).alias("level"), "cell", "n").select("level", F.expr(shift).alias("node"), "n")
    heavy = above.groupBy("level", "node").agg(F.sum("n").alias("n")).where(F.col("n") > leaf_points).select("level", "node").toArrow()
    level, node = (heavy.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    row, column = (node >> FINE) << (FINE - level), (node & ((1 << FINE) - 1)) << (FINE - level)
    start = _morton((row << FINE) | column)
    # Leaves are the children of heavy nodes that are not heavy themselves or cannot be cut, and the root if it is none.
    cut = level < FINE
    child = (start[cut][:, None] + np.arange(4) * (np.int64(1) << (2 * (FINE - 1 - level[cut])))[:, None]).ravel()
    below = np.repeat(level[cut] + 1, 4)
    known = set(zip(level.tolist(), start.tolist()))
    leaf = np.array([b == FINE or (b, c) not in known for b, c in zip(below.tolist(), child.tolist())], bool)
    starts = np.sort(child[leaf]) if len(child) else np.zeros(1, np.int64)
    shared = summaries.sparkSession.sparkContext.broadcast(starts)
    schema = pa.schema([("leaf", pa.int64()), ("side", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in names]])

    def place(batches):
        for batch in batches:
            cell = batch.column(0).to_numpy()
            found = np.searchsorted(shared.value, _morton(cell), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(found), *batch.columns[1:]], schema=schema)

    placed = summaries.select("cell", "side", "n", *names).mapInArrow(place, "leaf bigint, side int, n bigint, " + ", ".join(f"{c} double" for c in names))
    return filled(starts, placed.groupBy("leaf", "side").agg(*merged).select("leaf", "side", "n", *names).toArrow())


def _mixed(ids: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """A number that deals rows out evenly, the same whenever a task runs again."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for v in (lat, lng):
            h ^= np.ascontiguousarray(v, np.float64).view(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(1)


def _spread_rows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position among its copies) of each row repeated ``n`` times."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def located_points(df: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """``id, lat, lng`` of the rows with a key and a place within range."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    return rows.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal leading ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns[:keys])
        bounds = [0, *(k for k in np.flatnonzero(new) if k), batch.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            if held and (s or new[0]):
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append([c[s:e] for c in columns])
        last = tuple(c[-1] for c in columns[:keys])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def distance_join(
    left: DataFrame, right: DataFrame, radius_m: float, *, left_cols=("id", "lat", "lng"), right_cols=("id", "lat", "lng"), leaf_points: int = 40_000, task_points: int | None = None
) -> DataFrame:
    """``left_id, right_id``: every pair at most ``radius_m`` metres of great circle apart.

    Columns are named (id, latitude, longitude); ids are integers, places are degrees. Rows with a null or NaN in one of
    the three or a place out of range match nothing; equal rows each count, so equal pairs repeat; ties are all
    kept; an empty side gives no rows; other columns do not matter, whatever their names. A task holds at most ``task_points``
    (``leaf_points``, where none are given) left and twice as many right points, however wide the radius and however crowded a spot.
    """
    task_points = task_points or leaf_points
    spark = left.sparkSession
    a, b = located_points(left, *left_cols), located_points(right, *right_cols)
    summaries = cell_summaries([a, b])
    chord = chord_of(radius_m)
    while True:
        leaves = quad_leaves(summaries, 2, leaf_points)
        pairs = _near_leaves(leaves, chord)
        if len(pairs) <= MOST_PAIRS:
            break
        leaf_points *= 4
    if not len(pairs):
        return spark.createDataFrame([], "left_id bigint, right_id bigint")
    plan = _Deal(leaves, pairs, task_points)
    shared = spark.sparkContext.broadcast(plan)
    wire = pa.schema([("a_leaf", pa.int64()), ("block", pa.int64()), ("slot", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())])
    ddl = "a_leaf bigint, block bigint, slot bigint, side int, id bigint, lat double, lng double"
    limit = (chord * (1 + _FRINGE) + 1e-12) ** 2

    def deal(side):
        def run(batches):
            for batch in batches:
                cell, ids, lat, lng = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                # A row goes to many tasks where a radius is wide against the leaves; so it is dealt out a few thousand rows at a time.
                for s in range(0, len(ids), 4096):
                    part = slice(s, s + 4096)
                    which, leaf, block, slot = (shared.value.left if side == 0 else shared.value.right)(cell[part], ids[part], lat[part], lng[part], limit)
                    arrays = [leaf, block, slot, np.full(len(which), side, np.int32), ids[part][which], lat[part][which], lng[part][which]]
                    for k in range(0, len(which), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000], f.type) for x, f in zip(arrays, wire)], schema=wire)

        return run

    sides = [p.select(_cell(F.col("lat"), F.col("lng")), "id", "lat", "lng").mapInArrow(deal(k), ddl) for k, p in enumerate((a, b))]
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

    def run(batches):
        for _, _, _, side, ids, lat, lng in _groups(batches, 3):
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i, j in near_pairs(lat[l], lng[l], lat[r], lng[r], radius_m):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[l[i]]), pa.array(ids[r[j]])], schema=schema)

    return (
        sides[0]
        .unionByName(sides[1])
        .repartition(_width(spark, plan.tasks), "a_leaf", "block", "slot")
        .sortWithinPartitions("a_leaf", "block", "slot")
        .mapInArrow(run, "left_id bigint, right_id bigint")
    )


def _near_leaves(leaves: Leaves, chord: float) -> np.ndarray:
    """Rows (left leaf, right leaf) of all pairs that may hold near points, by the dual traversal from the roots."""
    at_a, at_b = np.flatnonzero(leaves.count[:, 0] > 0), np.flatnonzero(leaves.count[:, 1] > 0)
    if not len(at_a) or not len(at_b):
        return np.zeros((0, 2), np.int64)
    tree_a = Tree(leaves.low[at_a, 0, :3], leaves.high[at_a, 0, :3], 1)
    tree_b = Tree(leaves.low[at_b, 1, :3], leaves.high[at_b, 1, :3], 1)
    found = [np.stack([at_a[i], at_b[j]], 1) for part in dual_traverse(tree_a, tree_b, chord) for i, j in _expand(tree_a, tree_b, part)]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


class _Deal:
    """Which task each point goes to, so that none holds more than ``task_points`` left and twice as many right points.

    A task is (left leaf, block, slot). A left leaf of many points is dealt out in blocks. Its right leaves fill slots one after the other by
    their counts; a right leaf of more points than a slot holds is dealt out over slots of its own. Each block meets each slot.
    """

    def __init__(self, leaves: Leaves, pairs: np.ndarray, task_points: int):
        self.starts = leaves.starts
        self.blocks = np.ceil(leaves.count[:, 0] / task_points).astype(np.int64).clip(1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        a, n = pairs[:, 0], leaves.count[pairs[:, 1], 1].astype(np.int64)
        parts = np.where(n > task_points, -(-n // task_points), 0)
        first = np.searchsorted(a, a)
        before = lambda v: np.cumsum(v) - v - (np.cumsum(v) - v)[first]
        small = np.where(parts > 0, 0, n)
        slot = before(small) // task_points
        shared = np.zeros(len(leaves.starts), np.int64)
        np.maximum.at(shared, a[parts == 0], slot[parts == 0] + 1)
        slot = np.where(parts > 0, shared[a] + before(parts), slot)
        self.slots = shared.copy()
        np.add.at(self.slots, a, parts)
        self.tasks = int((self.blocks * self.slots).sum())
        self.low, self.high = leaves.low[:, 0, :3], leaves.high[:, 0, :3]
        # The pairs by right leaf, for looking up where its points go.
        by_right = np.argsort(pairs[:, 1], kind="stable")
        self.a, self.slot, self.parts = a[by_right], slot[by_right], parts[by_right]
        self.first = np.searchsorted(pairs[by_right, 1], np.arange(len(leaves.starts) + 1))

    def _leaf(self, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, _morton(cell), "right") - 1

    def left(self, cell, ids, lat, lng, limit):
        """(row, left leaf, block, slot) of all copies of left points."""
        leaf = self._leaf(cell)
        which, slot = _spread_rows(self.slots[leaf])
        block = (_mixed(ids, lat, lng) % self.blocks[leaf].astype(np.uint64)).astype(np.int64)
        return which, leaf[which], block[which], slot

    def right(self, cell, ids, lat, lng, limit):
        """The same of right points; only those that the box of the left leaf may reach go there."""
        leaf = self._leaf(cell)
        which, at = _spread_rows(self.first[leaf + 1] - self.first[leaf])
        at = at + self.first[leaf][which]
        p, a = _xyz(lat, lng)[which], self.a[at]
        out = np.maximum(0.0, np.maximum(self.low[a] - p, p - self.high[a]))
        near = (out**2).sum(1) <= limit
        which, at, a = which[near], at[near], a[near]
        dealt = (_mixed(ids, lat, lng)[which] % self.parts[at].clip(1).astype(np.uint64)).astype(np.int64)
        again, block = _spread_rows(self.blocks[a])
        return which[again], a[again], block, (self.slot[at] + dealt)[again]


def _width(spark: SparkSession, tasks: int) -> int:
    return max(1, min(tasks, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


# ---- regions --------------------------------------------------------------------------------------------------------


def _edges(geometry) -> np.ndarray:
    """Rows (x1, y1, x2, y2) of all rings of a multi-polygon; rings that are open are closed."""
    out = []
    for polygon in geometry or ():
        for ring in polygon or ():
            p = np.array([q[:2] for q in ring or () if q is not None and len(q) >= 2 and None not in q[:2]], float).reshape(-1, 2)
            if len(p) >= 3:
                out.append(np.concatenate([p, np.roll(p, -1, 0)], 1))
    e = np.concatenate(out) if out else np.zeros((0, 4))
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def _even_odd(x, y, edges, owner_start, owner_size, owner):
    """Whether point k (x, y) lies in the region ``owner[k]``, whose edges are a slice; the border counts as inside."""
    n = owner_size[owner]
    which = np.repeat(np.arange(len(x)), n)
    at = owner_start[owner][which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x1, y1, x2, y2 = edges[at].T
    px, py = x[which], y[which]
    cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
    between = (y1 > py) != (y2 > py)
    right = between & ((cross > 0) == (y2 > y1))
    on = (cross == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    inside = np.bincount(which, right, len(x)).astype(int) % 2 == 1
    return inside | (np.bincount(which, on, len(x)) > 0)


def _contain(lat, lng, boxes: np.ndarray, edges: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each point the position of the containing region of least order, or -1; ``boxes`` are those of the whole regions.

    Nodes of the points' tree against regions: boxes apart are discarded, nodes that no edge touches are decided by one of
    their points, the rest by every point.
    """
    best = np.full(len(lat), -1)
    known = [k for k, e in enumerate(edges) if len(e)]
    if not known or not len(lat):
        return best
    points = np.stack([lng, lat], 1)
    tree = Tree(points, points, 24)
    low, high = boxes[known, :2], boxes[known, 2:]
    regions = Tree(low, high, 1)
    size = np.array([len(edges[k]) for k in known])
    start = np.cumsum(size) - size
    flat = np.concatenate([edges[k] for k in known])
    e_low, e_high = np.minimum(flat[:, :2], flat[:, 2:]), np.maximum(flat[:, :2], flat[:, 2:])
    nodes, which = [], []
    stack = np.zeros((1, 2), np.int64)
    while len(stack):
        i, j = stack[:, 0], stack[:, 1]
        apart = (tree.low[i] > regions.high[j]).any(1) | (tree.high[i] < regions.low[j]).any(1)
        stack = stack[~apart]
        i, j = stack[:, 0], stack[:, 1]
        cut_i, cut_j = tree.kids[i, 0] >= 0, regions.kids[j, 0] >= 0
        done = stack[~cut_i & ~cut_j]
        nodes.append(done[:, 0])
        which.append(regions.order[regions.start[done[:, 1]]])
        si, sj = stack[cut_i], stack[~cut_i & cut_j]
        stack = np.concatenate([np.stack([tree.kids[si[:, 0], k], si[:, 1]], 1) for k in (0, 1)] + [np.stack([sj[:, 0], regions.kids[sj[:, 1], k]], 1) for k in (0, 1)])
    node, region = np.concatenate(nodes), np.concatenate(which)
    rank = np.array([order[k] for k in known])
    best_rank = np.full(len(lat), np.iinfo(np.int64).max)
    step = 2_000_000
    edges_of = np.cumsum(size[region])
    at = 0
    while at < len(node):
        base = edges_of[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(edges_of, base + step, "right")))
        nd, rg = node[at:until], region[at:until]
        n = size[rg]
        pair = np.repeat(np.arange(len(nd)), n)
        e = start[rg][pair] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        touch = (e_low[e] <= tree.high[nd][pair]).all(1) & (e_high[e] >= tree.low[nd][pair]).all(1)
        mixed = np.bincount(pair, touch, len(nd)) > 0
        for wholesale in (True, False):
            sel = np.flatnonzero(mixed != wholesale)
            if not len(sel):
                continue
            counts = tree.end[nd[sel]] - tree.start[nd[sel]]
            own = np.repeat(np.arange(len(sel)), counts)
            item = tree.order[tree.start[nd[sel]][own] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            reg = rg[sel]
            if wholesale:
                one = tree.order[tree.start[nd[sel]]]
                hit = _even_odd(lng[one], lat[one], flat, start, size, reg)[own]
            else:
                hit = np.zeros(len(item), bool)
                most = max(1, 4_000_000 // max(1, int(size[reg].max())))
                for s in range(0, len(item), most):
                    q = slice(s, s + most)
                    hit[q] = _even_odd(lng[item[q]], lat[item[q]], flat, start, size, reg[own[q]])
            item, who = item[hit], reg[own[hit]]
            for r in np.unique(who):
                these = item[who == r]
                better = rank[r] < best_rank[these]
                best_rank[these[better]] = rank[r]
                best[these[better]] = known[r]
        at = until
    return best


def containment_join(points: DataFrame, regions: DataFrame, *, point_cols=("id", "lat", "lng"), region_cols=("key", "order", "geometry"), leaf_points: int = 40_000, task_edges: int = TASK_EDGES) -> DataFrame:
    """``id, region_key``: for each point the region that contains it, of several the one of least order.

    ``geometry`` is array<polygon<ring<[lng, lat]>>>, even-odd, so later rings cut holes; a border belongs to its regions.
    Regions are dealt to the leaves of the points' tree that their boxes meet, with only the edges that matter there, so neither
    side is ever broadcast; the regions of a leaf fill slots of about ``task_edges`` edges, and its points go to each. Rows with nulls or places out of range, regions without geometry or key, and
    points in no region give nothing; equal rows each count; empty tables give none; other columns do not matter.
    """
    found = _contained(points, regions, point_cols, region_cols, leaf_points, task_edges)
    return found.select("id", "region_key")


def contained_spots(points: DataFrame, regions: DataFrame, *, point_cols=("id", "lat", "lng"), region_cols=("key", "order", "geometry"), leaf_points: int = 40_000) -> DataFrame:
    """The same with the place instead of the id, under the names of its columns."""
    found = _contained(points, regions, point_cols, region_cols, leaf_points, TASK_EDGES)
    return found.select(F.col("lat").alias(point_cols[1]), F.col("lng").alias(point_cols[2]), "region_key")


def _contained(points: DataFrame, regions: DataFrame, point_cols, region_cols, leaf_points: int, task_edges: int) -> DataFrame:
    spark = points.sparkSession
    a = located_points(points, *point_cols)
    leaves = quad_leaves(cell_summaries([a]), 1, leaf_points)
    used = np.flatnonzero(leaves.count[:, 0] > 0)
    if not len(used):
        return spark.createDataFrame([], "id bigint, lat double, lng double, region_key string")
    # low and high hold x, y, z, lat, lng
    boxes = np.stack([leaves.low[used, 0, 4], leaves.low[used, 0, 3], leaves.high[used, 0, 4], leaves.high[used, 0, 3]], 1)
    shapes = spark.sparkContext.broadcast((used, boxes))
    key, order, geometry = region_cols
    known = regions.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("order"), F.col(geometry).alias("geometry")).where("key IS NOT NULL AND geometry IS NOT NULL")
    counted = pa.schema([("leaf", pa.int64()), ("n", pa.int64())])

    def count(batches):
        leaf_no, _ = shapes.value
        total = np.zeros(len(leaf_no), np.int64)
        for batch in batches:
            for _, _, _, hits, kept in _meeting(batch, *shapes.value):
                total[hits] += np.array([len(e) for e in kept], np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(leaf_no[at]), pa.array(total[at])], schema=counted)

    # How many edges each leaf meets: at most one number for each leaf.
    sums = known.mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    blocks, slots = np.ones(len(leaves.starts), np.int64), np.ones(len(leaves.starts), np.int64)
    blocks[used] = np.ceil(leaves.count[used, 0] / leaf_points)
    slots[sums.column(0).to_numpy()] = np.ceil(sums.column(1).to_numpy() / task_edges)
    tasks = spark.sparkContext.broadcast((leaves.starts, blocks, slots))
    wire = pa.schema(
        [("leaf", pa.int64()), ("block", pa.int64()), ("slot", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("key", pa.string()), ("edges", pa.list_(pa.float64()))]
    )
    ddl = "leaf bigint, block bigint, slot bigint, side int, id bigint, lat double, lng double, key string, edges array<double>"

    def deal_regions(batches):
        leaf_no, _ = shapes.value
        _, blocks, slots = tasks.value
        for batch in batches:
            rows = []
            for name, place, box, hits, kept in _meeting(batch, *shapes.value):
                for k, e in zip(hits, kept):
                    leaf = int(leaf_no[k])
                    slot = zlib.crc32(f"{place} {name}".encode()) % int(slots[leaf])
                    rows += [(leaf, n, slot, 0, place, None, None, name, np.concatenate([box, e.ravel()])) for n in range(blocks[leaf])]
                    if len(rows) > 500:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), wire)], schema=wire)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), wire)], schema=wire)

    def deal_points(batches):
        starts, blocks, slots = tasks.value
        for batch in batches:
            cell, ids, lat, lng = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            leaf = np.searchsorted(starts, _morton(cell), "right") - 1
            block = (_mixed(ids, lat, lng) % blocks[leaf].astype(np.uint64)).astype(np.int64)
            which, slot = _spread_rows(slots[leaf])
            for s in range(0, len(which), 100_000):
                w = which[s : s + 100_000]
                arrays = [leaf[w], block[w], slot[s : s + 100_000], np.ones(len(w), np.int32), ids[w], lat[w], lng[w]]
                columns = [pa.array(x, f.type) for x, f in zip(arrays, wire)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(w), pa.string()), pa.nulls(len(w), wire.field("edges").type)], schema=wire)

    pieces = known.mapInArrow(deal_regions, ddl)
    placed = a.select(_cell(F.col("lat"), F.col("lng")), "id", "lat", "lng").mapInArrow(deal_points, ddl)
    schema = pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("slot", pa.int64()), ("order", pa.int64()), ("region_key", pa.string())])

    def run(batches):
        for leaf, block, slot, side, ids, lat, lng, keys, edges in _groups(batches, 3):
            r, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(r) or not len(p):
                continue
            shapes = [np.asarray(edges[k], float) for k in r]
            found = _contain(lat[p], lng[p], np.array([s[:4] for s in shapes]), [s[4:].reshape(-1, 4) for s in shapes], ids[r])
            ok = np.flatnonzero(found >= 0)
            if len(ok):
                at, region = p[ok], r[found[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[at], lat[at], lng[at], slot[at], ids[region], keys[region]), schema)], schema=schema)

    found = (
        pieces.unionByName(placed)
        .repartition(_width(spark, int((blocks[used] * slots[used]).sum())), "leaf", "block", "slot")
        .sortWithinPartitions("leaf", "block", "slot", "side")
        .mapInArrow(run, "id bigint, lat double, lng double, slot bigint, order bigint, region_key string")
    )
    if slots.max() == 1:
        return found.select("id", "lat", "lng", "region_key")
    # Where the regions of a leaf fill several slots, a point has an answer from each; equal rows have as many answers each.
    by_slot = found.groupBy("id", "lat", "lng", "slot").agg(F.count("*").alias("n"), F.min(F.struct("order", "region_key")).alias("b"))
    best = by_slot.groupBy("id", "lat", "lng").agg(F.max("n").alias("n"), F.min("b").alias("b"))
    return best.select("id", "lat", "lng", F.col("b.region_key").alias("region_key"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("col")


def _meeting(batch: pa.RecordBatch, used: np.ndarray, boxes: np.ndarray) -> Iterator[tuple]:
    """(key, order, box, positions of the leaves whose points it may hold, its edges for each) of every region of a batch."""
    for key, order, geometry in zip(*(c.to_pylist() for c in batch.columns)):
        e = _edges(geometry)
        if not len(e):
            continue
        lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        box = np.concatenate([lo.min(0), hi.max(0)])
        hits = np.flatnonzero((boxes[:, 0] <= box[2]) & (boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[3]) & (boxes[:, 3] >= box[1]))
        # A ray to the east only meets edges at the leaf's heights that are not all to its west.
        kept = [e[(lo[:, 1] <= boxes[k, 3]) & (hi[:, 1] >= boxes[k, 1]) & (hi[:, 0] >= boxes[k, 0])] for k in hits]
        some = np.array([k for k, x in enumerate(kept) if len(x)], int)
        yield key, order if order is not None else 2**62, box, hits[some], [kept[k] for k in some]
