"""Keeping work even when one key holds a large part of the rows.

Every helper here gives the same rows as its plain counterpart; only the distribution differs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# row_number() <= k is cut down before the shuffle by Spark itself up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


MAX_HEAVY = 1000
# Rows of a short side, some keys and a number each, that are sent to every task at most.
SENT_ROWS = 50_000


def shared_folder(spark) -> str:
    """Checkpoint folder of the session, ``spark.checkpoint.dir``, which all machines must share.

    Only a session that runs in a single process may leave it unset; it gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a shared folder.")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the checkpoint folder of the session and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_columns(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the checkpoint folder of the session and read it from there.

    For wide rows that several steps read: each of them reads its own columns and decodes no others, which a checkpoint,
    whole rows one after the other, cannot offer. How the rows are partitioned or sorted is not kept. Types that Parquet does not
    know make it a checkpoint.
    """
    spark = df.sparkSession
    if any(re.search("void|interval", t) for _, t in df.dtypes):
        return cut_lineage(df)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_keys(df: DataFrame, keys: Sequence[str], least: int = 1_000_000) -> DataFrame:
    """The keys with at least ``least`` rows, the most frequent ``MAX_HEAVY`` of them at most.

    Any other key has fewer rows than that or less than one row in ``MAX_HEAVY``. The counts are combined
    on the map side, so a heavy key costs one row per task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return counts.orderBy(F.col("_n").desc(), *keys).limit(MAX_HEAVY).drop("_n")


def splits_skew(spark) -> bool:
    """Does the session split skewed join partitions at run time?"""
    on = lambda key: str(spark.conf.get(key, "true")).lower() == "true"
    return on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled")


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hit: str = "hit", least: int = 1_000_000) -> DataFrame:
    """Left join to a side that is unique on ``keys``; its other columns arrive as the struct ``hit``.

    The sides meet on one struct of the keys. An aggregate on the same keys would otherwise lend its
    partitioning to the join, and adaptive execution splits a skewed partition only when both sides were
    shuffled for the join itself. Where adaptive skew handling is off, the rows of heavy keys are taken out
    first and meet their partners, at most ``MAX_HEAVY`` rows, in a broadcast join.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(f"`{c}`") for c in right.columns if c not in keys], F.lit(True).alias("_found"))
    lookup = right.select(*keys, payload.alias("_hit"))

    def meet(some: DataFrame, table: DataFrame, small: bool = False) -> DataFrame:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        key = F.when(known, F.struct(*keys))
        side = table.select(key.alias("_side_key"), F.col("_hit").alias(hit))
        tagged = some.withColumn("_key", key)
        joined = tagged.join(F.broadcast(side) if small else side, F.col("_key") == F.col("_side_key"), "left")
        return joined.drop("_key", "_side_key")

    if splits_skew(left.sparkSession):
        return meet(left, lookup)
    heavy = F.broadcast(heavy_keys(left.select(*keys), keys, least))
    usual = meet(left.join(heavy, keys, "left_anti").select(*left.columns), lookup)
    crowded = left.join(heavy, keys, "left_semi").select(*left.columns)
    return usual.unionByName(meet(crowded, lookup.join(heavy, keys, "left_semi"), small=True))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every group. Spark cuts each task down to one row per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None, ways: int | None = None
) -> DataFrame:
    """First ``k`` rows of every group, with their rank when asked for.

    Beyond ``GROUP_LIMIT`` each group is first cut down in up to ``ways`` slices and then as a whole. Slices
    follow the input partitions, so copies of a row do not gather in one of them.
    """
    out = df
    if k > GROUP_LIMIT:
        ways = ways or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        out = out.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(ways)))
        out = out.withColumn("_rn", F.row_number().over(sliced)).where(F.col("_rn") <= k).drop("_rn", "_slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def ranked_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, single: bool = False) -> DataFrame:
    """Row numbers within groups of any size: rows are sorted by ranges, counted per range, and shifted.

    Only one count per range and group is summed up in one place. The sorted rows are stored by columns and shuffled no more:
    the shifts, one per range and one per group more, are sent to them while they are few. ``single`` says that the rows are one
    group: the shifts are then as many as there are ranges.
    """
    by = [*keys, *order]
    placed = stored_columns(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from") + 1).drop("_from", "_n")
    placed = placed.withColumn("_part", part)
    out = placed.join(F.broadcast(sizes.drop(*keys)), "_part") if single else attach_few(placed, sizes, [*keys, "_part"])
    return out.withColumn(rank, (F.col("_at") + F.col("_shift")).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], rank)


def previous_value(
    df: DataFrame, keys: Sequence[str], position: str, value: str, name: str, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """``lag(value)`` by an integer ``position`` within each group, computed in slices of the position.

    The first row of a slice takes the last value of the slice before it, so a group of any size is
    spread over as many tasks as it has slices.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", F.floor(F.col(position) / F.lit(rows_per_slice)))
    ends = sliced.where(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.max_by(value, position).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))
    # The end of the slice before comes as a row in front of the slice, so the rows themselves are shuffled once and joined with nothing.
    ends = ends.withColumn("_end", before).where(F.col("_end").isNotNull())
    front = ends.withColumnRenamed("_end", value).withColumn("_front", F.lit(True))
    both = sliced.withColumn("_front", F.lit(False)).unionByName(front, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.col("_front").desc(), position)
    return both.withColumn(name, F.lag(value).over(inside)).where(~F.col("_front")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def running(df: DataFrame, keys: Sequence[str], position: str, name: str, value: Column, how: str = "sum", before: bool = False, rows_per_slice: int = 100_000) -> DataFrame:
    """Running ``sum`` of ``value``, or its ``last`` non-null one, by an integer ``position`` within each group.

    Groups are cut into slices of the position. Each slice is gone through by itself and takes on what the slices in
    front of it add up to, so no task holds a group. The rows are stored; where no group is longer than a slice
    that is all. ``before`` leaves out the row itself. Rows of a null key take on nothing from slice to slice.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_slice").orderBy(position).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0)) if how == "sum" else F.last("_value", ignorenulls=True).over(inside)
    step = df.withColumn("_slice", F.floor(F.col(position) / F.lit(rows_per_slice))).withColumn("_value", value)
    step = cut_lineage(step.withColumn(name, own))
    columns = [F.col(f"`{c}`") for c in df.columns if c != name]
    if step.where("_slice <> 0").isEmpty():
        return step.select(*columns, name)
    total = F.sum("_value") if how == "sum" else F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position)))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.sum("_total").over(earlier) if how == "sum" else F.last("_total", ignorenulls=True).over(earlier)
    ends = step.groupBy(*keys, "_slice").agg(total.alias("_total")).select(*keys, "_slice", carried.alias("_carried"))
    out = attach(step, ends, [*keys, "_slice"], "left")
    both = F.col(name) + F.coalesce("_carried", F.lit(0)) if how == "sum" else F.coalesce(name, "_carried")
    return out.select(*columns, both.alias(name))


def dense_ids(df: DataFrame, name: str, after: Column, position: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive ids ``after + 1, after + 2, …`` without bringing the rows together.

    Ids follow ``position`` and then ``by``, which together identify a row. The rows are sorted by ranges that follow
    their distribution, so slices grow neither with the data nor with a skewed position.
    """
    order = [*([position] if position else []), *by]
    out = ranked_per_group(df.withColumn("_all", F.lit(0)), ["_all"], order, "_place", single=True)
    return out.withColumn(name, (after + F.col("_place")).cast("long")).drop("_place", "_all")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of a side that is unique on ``keys``, joined without gathering a heavy key; see ``lookup_join``."""
    hit = lookup_join(left, right, keys, "_attached")
    if how == "inner":
        hit = hit.where(F.col("_attached").isNotNull())
    elif how == "semi":
        return hit.where(F.col("_attached").isNotNull()).drop("_attached")
    elif how == "anti":
        return hit.where(F.col("_attached").isNull()).drop("_attached")
    extra = [F.col(f"_attached.`{c}`").alias(c) for c in right.columns if c not in keys]
    return hit.select(*[F.col(f"`{c}`") for c in left.columns], *extra)


def attach_few(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` to a side that is expected to be short, such as a row per file or slice.

    The short side is stored and, up to ``SENT_ROWS`` rows, sent: rows of the other one stay where they are. No key may be null.
    """
    right = cut_lineage(right)
    if right.count() > SENT_ROWS:
        return attach(left, right, keys, how)
    out = left.join(F.broadcast(right), list(keys), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    extra = [] if how in ("semi", "anti") else [F.col(f"`{c}`") for c in right.columns if c not in keys]
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *extra)


def number_rows(df: DataFrame, keys: Sequence[str], position: str, name: str, rows_per_slice: int = 1_000_000) -> DataFrame:
    """0, 1, 2, … within each group by an integer ``position`` that is unique in it, computed in slices of it."""
    keys = list(keys)
    sliced = df.withColumn("_slice", F.floor(F.col(position) / F.lit(rows_per_slice)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(position)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = sliced.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, [*keys, "_slice"])
    return out.withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], name)
