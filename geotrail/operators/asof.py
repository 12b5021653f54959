"""Order-based operators that no single key can overload.

A window over one entity puts all its rows into one task. Here time is cut into blocks: windows run within (entity, block),
and what a block needs from those before it comes from a window over one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.session import ensure_checkpoint_dir, free_name

BLOCK_MS = 7 * 86_400_000


def _block(time: Column, block_ms: int) -> Column:
    return F.floor(time / F.lit(block_ms)).cast("bigint")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def around(left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str, payload: list[str], ways: dict[str, bool], block_ms: int = BLOCK_MS) -> DataFrame:
    """``left`` with a struct ``__rt, *payload`` for each of ``ways`` (name: forward), as ``asof`` picks it; all ways share one shuffle.

    A block's last and first right row also go to the blocks after and before it, as far as the next block that has one itself.
    """
    pack = F.struct(F.col(right_time).alias("__rt"), *[F.col(p) for p in payload])
    rights = right.where(F.col(right_time).isNotNull()).select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), pack.alias("__pack"))
    lefts = left.select(F.col(by), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(rights.schema["__pack"].dataType).alias("__pack"), F.struct("*").alias("__row"))
    no_row = F.lit(None).cast(lefts.schema["__row"].dataType)
    block = _block(F.col("__t"), block_ms)
    both = rights.withColumn("__row", no_row).unionByName(lefts).withColumn("__b", block)
    # Least and greatest structs are found by sorting, so only right rows are asked for them; left rows name their blocks. A row without a time has no block and meets nothing.
    edges = rights.groupBy(by, block.alias("__b")).agg(F.max("__pack").alias("__max"), F.min("__pack").alias("__min"))
    edges = edges.unionByName(lefts.where(F.col("__t").isNotNull()).select(by, block.alias("__b")).distinct(), allowMissingColumns=True)
    edges = edges.groupBy(by, "__b").agg(F.max("__max").alias("__max"), F.max("__min").alias("__min"))
    turn = lambda c, forward: c.desc() if forward else c.asc()
    far = [F.last("__min" if f else "__max", True).over(Window.partitionBy(by).orderBy(turn(F.col("__b"), f)).rowsBetween(Window.unboundedPreceding, -1)) for f in ways.values()]
    carried = edges.select(by, "__b", F.array(*far).alias("__far")).select(by, "__b", F.explode("__far").alias("__pack")).where(F.col("__pack").isNotNull())
    both = both.unionByName(carried.select(by, F.col("__pack.__rt").alias("__t"), F.lit(0).alias("__side"), "__pack", no_row.alias("__row"), "__b"))
    # All ways read one order. Forward, a frame that begins with the current row would be read again for every row; the next pack that there is, is found by
    # going on from the last one, and of the right rows at the same instant, which come before, the first is the least.
    inside = Window.partitionBy(by, "__b").orderBy("__t", "__side", "__pack")
    at_once = Window.partitionBy(by, "__b", "__t").orderBy("__side", "__pack").rowsBetween(Window.unboundedPreceding, 0)
    following = F.expr(f"lead(__pack) IGNORE NULLS OVER (PARTITION BY {quoted(by)}, __b ORDER BY __t, __side, __pack)")
    for name, f in ways.items():
        both = both.withColumn(name, F.coalesce(F.first("__pack", True).over(at_once), following) if f else F.last("__pack", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where(F.col("__row").isNotNull()).select("__row.*", *ways)


def asof(
    left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str, payload: list[str], forward: bool = False, block_ms: int = BLOCK_MS
) -> DataFrame:
    """``left`` with ``payload`` of the last right row at or before its time (``forward``: the first at or after it), else nulls.

    Of right rows at one instant the one with the greatest payload (forward: the least) is taken, in the order of ``payload``.
    The columns ``by`` and the payload's names must not clash with those of ``left`` except for ``by`` itself.
    """
    hit = around(left, right, by=by, left_time=left_time, right_time=right_time, payload=payload, ways={"__hit": forward}, block_ms=block_ms)
    return hit.select(*left.columns, F.col("__hit.__rt").alias(right_time), *[F.col(f"__hit.{p}").alias(p) for p in payload])


def runs(df: DataFrame, *, by: str, time: str, order: list[str], value: str, gap_ms: int, block_ms: int = BLOCK_MS, block: Column | None = None) -> DataFrame:
    """``df`` with ``is_break`` and ``run_no`` (from 0): a new run where ``value`` changes or more than ``gap_ms`` pass since the last time.

    ``order`` sorts rows within an entity, by time or as they came; ``block`` grows with it and cuts an entity's rows into parts that
    fit into tasks (where none is given, ``order`` begins with ``time`` and blocks are stretches of ``block_ms``). Rows without a time make no gap.
    """
    blocked = df.withColumn("__b", block if block is not None else _block(F.col(time), block_ms)).withColumn("__own", F.lit(1))
    key = F.struct(*order)
    last = blocked.groupBy(by, "__b").agg(F.max_by(F.struct(F.col(value).alias("v")), key).alias("__v"), F.max_by(time, F.when(F.col(time).isNotNull(), key)).alias("__t"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # What a block needs from those before it is one more row at its head.
    carried = last.select(by, "__b", F.last("__v").over(before).alias("__cv"), F.last("__t", True).over(before).alias("__ct")).where(F.col("__cv").isNotNull())
    carried = carried.select(by, "__b", F.lit(0).alias("__own"), F.col("__cv.v").alias(value), F.col("__ct").alias(time))
    out = blocked.unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(by, "__b").orderBy("__own", *order)
    out = out.withColumn("__pv", F.lag(value).over(inside)).withColumn("__pt", F.last(time, True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.coalesce(F.col("__pv") != F.col(value), F.lit(False)) | F.coalesce(F.col(time) - F.col("__pt") > gap_ms, F.lit(False))
    out = out.withColumn("is_break", changed & (F.col("__own") == 1))
    out = out.withColumn("__n", F.sum(F.col("is_break").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__own") == 1).drop("__own", "__pv", "__pt")
    # Used twice below; written once, so that what came before is not computed again.
    ensure_checkpoint_dir(df.sparkSession)
    out = out.checkpoint()
    count = out.groupBy(by, "__b").agg(F.max("__n").alias("__n"))
    count = count.select(F.col(by).alias("__by"), F.col("__b").alias("__cb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = out.join(count, F.col(by).eqNullSafe(F.col("__by")) & F.col("__b").eqNullSafe(F.col("__cb")), "left")
    return out.withColumn("run_no", (F.col("__base") + F.col("__n")).cast("bigint")).drop("__b", "__n", "__by", "__cb", "__base")


def with_global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the position of each row in a global order, from 0, without gathering all rows in one task.

    The rows are range-sorted and written to the checkpoint folder, so that the partitions stay as they are; each partition's
    offset comes from the row counts of those before it, one number for each partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    part = free_name(df.columns, "__part")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    base, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part).count().collect()):
        offsets.append((p, base))
        base += n
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, __base bigint")
    at = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ordered.withColumn(name, at).join(F.broadcast(table), part).withColumn(name, F.col(name) + F.col("__base")).drop(part, "__base")
