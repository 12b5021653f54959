"""Stay points: stays merged into places by distance or by a shared place id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.operators.asof import with_global_index
from geotrail.operators.dual_tree import _groups, near_pairs
from geotrail.operators.dual_tree import haversine_m as sphere_m
from geotrail.session import ensure_checkpoint_dir

#: So many edges are closed within one task (some 200 MB); more are contracted by rounds of joins first.
TASK_EDGES = 2_000_000


def close_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of the component of each) of a set of edges.

    Roots hang themselves below the least root that any of their nodes touches, and every path is halved until it ends at its root;
    so whole chains close in few passes, in any order of the ids.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        p, q = root[i], root[j]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return nodes, nodes[root]


def connected_components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``id, label``: every node with the least id of its component. Edges are ``a, b`` in either or both directions.

    While there are more than ``task_edges`` edges, a round labels each node with the least of its neighbours, jumps to the label of that
    label, and puts labels in the place of nodes in the edges; edges that have closed fall away, and a label that is no root yet keeps
    a link to its own. What is left is closed within one task of bounded size. There is no limit of rounds: they end when few
    enough edges are left, and each takes nodes away as long as there are any. Lineage is cut by ``checkpoint`` into the shared folder.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64())])

    def close(batches):
        parts = [tuple(c.to_numpy() for c in x.columns) for x in batches if x.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, close_edges(*(np.concatenate(c) for c in zip(*parts))))), schema=schema)

    left = tidy(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    labels = None
    while left.count() > task_edges:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("label"))
        jump = near.select(F.col("id").alias("j"), F.col("label").alias("jumped"))
        step = near.join(jump, F.col("label") == F.col("j")).select("id", F.least("label", "jumped").alias("label")).checkpoint()
        # A node whose label is no root yet stays linked to it, so that no component falls apart.
        name = lambda end, other: step.select(F.col("id").alias(end), F.col("label").alias(other))
        renamed = left.join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        hooks = step.select(F.col("id").alias("label"), F.col("label").alias("up")).where("label <> up").join(step.select("label").distinct(), "label", "left_semi")
        left = tidy(renamed.unionByName(hooks.select(F.col("label").alias("a"), F.col("up").alias("b"))))
        if labels is None:
            labels = step
        else:
            known = labels.join(step.select(F.col("id").alias("j"), F.col("label").alias("new")), F.col("label") == F.col("j"), "left").select("id", F.coalesce("new", "label").alias("label"))
            labels = known.unionByName(step.join(labels.select("id"), "id", "left_anti")).checkpoint()
    closed = left.repartition(1).mapInArrow(close, "id bigint, label bigint")
    if labels is not None:
        closed = closed.checkpoint()
        last = closed.select(F.col("id").alias("j"), F.col("label").alias("new"))
        known = labels.join(last, F.col("label") == F.col("j"), "left").select("id", F.coalesce("new", "label").alias("label"))
        closed = known.unionByName(closed.join(labels.select("id"), "id", "left_anti"))
    found = closed.select(F.col("id").alias("__n"), "label")
    return nodes.join(found, F.col("id") == F.col("__n"), "left").select("id", F.coalesce("label", "id").alias("label"))


def _short_links(groups: list[tuple], threshold_m: float, d: float) -> pa.RecordBatch:
    """The (label, label) of those groups of a few spots that any two near ones link, all groups at once."""
    n, m = (np.array([len(g[k]) for g in groups]) for k in (2, 4))
    lat_l, lng_l, lat_r, lng_r = (np.concatenate([g[k] for g in groups]) for k in (2, 3, 4, 5))
    first_l, first_r = np.cumsum(n) - n, np.cumsum(m) - m
    group = np.repeat(np.arange(len(groups)), n * m)
    at = np.arange(len(group)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    i, j = first_l[group] + at // m[group], first_r[group] + at % m[group]
    near = (np.abs(lat_l[i] - lat_r[j]) <= d) & (np.abs(lng_l[i] - lng_r[j]) <= d) & (sphere_m(lat_l[i], lng_l[i], lat_r[j], lng_r[j]) <= threshold_m)
    hit = np.flatnonzero(np.bincount(group, near, len(groups)))
    return pa.RecordBatch.from_arrays([pa.array(np.array([groups[k][c] for k in hit], np.int64)) for c in (0, 1)], names=["a", "b"])


def stay_points(stays: DataFrame, threshold_m: float = 50.0) -> DataFrame:
    """``stays`` with ``cluster_id``: stays of a subject are one place if linked by a shared place id or by a chain of short distances.

    A link is short if both coordinates differ by at most ``threshold / 111000 + 0.001`` degrees and the distance is at most the
    threshold. A place's id is the least index of its stays. Rows without coordinates are left out.

    Spots in one fine cell, and in two that touch, are always linked, so a cell with any number of spots is one node and costs no
    pairs. What these links leave apart is compared cell by cell, by boxes, and of two cells that may still link the spots within reach
    of the other's box go to one task, which asks by dual traversal whether any two are near. Shared ids are linked to their first spot.
    """
    ensure_checkpoint_dir(stays.sparkSession)
    spot, cell = ["subject_id", "lat", "lng"], ["subject_id", "fy", "fx"]
    side, d = threshold_m / 333_000, threshold_m / 111_000 + 0.001
    grid = lambda c, size: F.floor(F.col(c) / F.lit(size)).cast("bigint")
    spots = stays.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy(*spot).agg(F.min("visit_idx").alias("id"))
    spots = spots.withColumn("fy", grid("lat", side)).withColumn("fx", grid("lng", side)).checkpoint()
    cells = spots.groupBy(*cell).agg(F.min("id").alias("cid"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("lo", F.min), ("hi", F.max))])
    half = F.explode_outer(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    beside = cells.select("subject_id", F.col("cid").alias("b"), "fy", "fx", half.alias("o")).select("subject_id", "b", (F.col("fy") + F.col("o.y")).alias("fy"), (F.col("fx") + F.col("o.x")).alias("fx"))
    touching = cells.join(beside, cell).select(F.col("cid").alias("a"), "b")
    first = connected_components(cells.select(F.col("cid").alias("id")), touching)
    cells = cells.join(first, F.col("cid") == F.col("id")).drop("id").checkpoint()
    # Cells that may still link: a bounded number of fine cells lies in a coarse one, however many spots they hold.
    wide = d + side
    here = cells.withColumn("cy", grid("lo_lat", wide)).withColumn("cx", grid("lo_lng", wide))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    there = here.select(*[F.col(c).alias(f"o_{c}") for c in cells.columns], F.explode_outer(F.transform(around, lambda k: F.col("cy") + k)).alias("cy"), F.col("cx").alias("ocx"))
    there = there.select("*", F.explode_outer(F.transform(around, lambda k: F.col("ocx") + k)).alias("cx")).drop("ocx")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"o_lo_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"o_hi_{c}"))
    near = (gap("lat") <= d) & (gap("lng") <= d) & (gap("lat") * 111_190 <= threshold_m * 1.001)
    pair = here.join(there, (F.col("subject_id") == F.col("o_subject_id")) & (here["cy"] == there["cy"]) & (here["cx"] == there["cx"]))
    pair = pair.where((F.col("cid") < F.col("o_cid")) & (F.col("label") != F.col("o_label")) & near)
    ends = ("fy", "fx", "cid", "label", "lo_lat", "hi_lat", "lo_lng", "hi_lng")
    pair = pair.select("subject_id", *ends, *[F.col(f"o_{c}").alias(f"o_{c}") for c in ends]).checkpoint()
    off = lambda v, c: F.greatest(F.lit(0.0), F.col(f"o_lo_{c}") - F.col(v), F.col(v) - F.col(f"o_hi_{c}"))
    reach = (off("lat", "lat") <= d) & (off("lng", "lng") <= d) & (off("lat", "lat") * 111_190 <= threshold_m * 1.001)

    def side(n: int) -> DataFrame:
        """The spots of one cell of each pair that the box of the other may reach; both sides carry the pair's name."""
        turned = pair if n == 0 else pair.select("subject_id", *[F.col(f"o_{c}").alias(c) for c in ends], *[F.col(c).alias(f"o_{c}") for c in ends])
        a, b = ("", "o_") if n == 0 else ("o_", "")
        met = turned.join(spots.select(*cell, "lat", "lng"), cell).where(reach)
        return met.select(*[F.col(f"{x}{c}").alias(o) for c, o1, o2 in (("cid", "c1", "c2"), ("label", "a", "b")) for x, o in ((a, o1), (b, o2))], F.lit(n).alias("side"), "lat", "lng")

    def linked(batches):
        held, size = [], 0
        for _, _, a, b, which, lat, lng in _groups(batches, 2):
            l, r = np.flatnonzero(which == 0), np.flatnonzero(which == 1)
            if len(l) * len(r) <= 1000:
                if len(l) and len(r):
                    held.append((a[0], b[0], lat[l], lng[l], lat[r], lng[r]))
                    size += len(l) * len(r)
                if size > 200_000:
                    yield _short_links(held, threshold_m, d)
                    held, size = [], 0
                continue
            for i, j in near_pairs(lat[l], lng[l], lat[r], lng[r], threshold_m):
                if ((np.abs(lat[l[i]] - lat[r[j]]) <= d) & (np.abs(lng[l[i]] - lng[r[j]]) <= d)).any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[:1]), pa.array(b[:1])], names=["a", "b"])
                    break
        if held:
            yield _short_links(held, threshold_m, d)

    links = side(0).unionByName(side(1)).repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(linked, "a bigint, b bigint")
    owned = spots.join(cells.select(*cell, "label"), cell).select(*spot, "label")
    named = stays.where(F.col("place_id").isNotNull()).select(*spot, "place_id").distinct().join(owned, spot).select("subject_id", "place_id", "label").distinct()
    least = named.groupBy("subject_id", "place_id").agg(F.min("label").alias("a"))
    shared = named.join(least, ["subject_id", "place_id"]).where("label <> a").select("a", F.col("label").alias("b"))
    final = connected_components(first.select(F.col("label").alias("id")).distinct(), links.unionByName(shared))
    placed = owned.join(final.select(F.col("id").alias("__l"), F.col("label").alias("cluster_id")), F.col("label") == F.col("__l")).select(*spot, "cluster_id")
    return stays.join(placed, spot)


def numbered(clusters: DataFrame) -> DataFrame:
    """``subject_id, cluster_id, cluster_no``: each subject's places from 0 in the order of their first stay, one row for each place.

    Numbers come from one global order, so that a subject with many places needs no task of its own.
    """
    ordered = with_global_index(clusters.select("subject_id", "cluster_id").distinct(), ["subject_id", "cluster_id"], "__i")
    first = ordered.groupBy("subject_id").agg(F.min("__i").alias("__first"))
    return ordered.join(first, "subject_id").select("subject_id", "cluster_id", (F.col("__i") - F.col("__first")).alias("cluster_no"))


def centres(clusters: DataFrame) -> DataFrame:
    """``cluster_id, lat, lng, stays``: the mean of each place's stays and their number."""
    return clusters.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("stays"))
