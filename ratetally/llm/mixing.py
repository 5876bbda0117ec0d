"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.llm.common import stored

# Slices of each source's seeded order; only the slice in which the wanted amount is reached is sorted.
HEX_DIGITS = 3


def source_targets(sizes: DataFrame, source_col: str, size_col: str, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): the target each source gets, at most ``max_epochs`` times its size.

    Sources in code-point order, null last, take the weights in turn. A level is raised until the shares add up
    to ``share`` times all sizes: sources whose share would pass their limit are clamped, and the others share
    the rest by weight, until no further source is clamped. Only the three sums of a round reach the driver.
    """
    spread = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    ordered = stored(
        spread.withColumn("_none", F.col("source").isNull()).repartitionByRange("_none", "source").sortWithinPartitions("_none", "source")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    slices = ordered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = slices.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ordered.withColumn("_part", F.shiftright("_at", 33)).join(before.drop("_n"), "_part")
    ranked = ranked.select("source", "source_size", F.get(wheel, F.pmod(place, F.lit(len(weights))).cast("int")).alias("_w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap"))
    ranked = stored(ranked)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    if total is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    whole = share * total
    left, free, clamped = whole, weight, 0
    while True:
        over = F.lit(float(left)) * F.col("_w") / F.lit(float(free)) > F.col("_cap")
        n, used, gone = ranked.where(over).agg(F.count(F.lit(1)), F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if n == clamped or gone == weight:
            fair = F.lit(float(left)) * F.col("_w") / F.lit(float(free))
            return ranked.select("source", "source_size", F.least(fair, F.col("_cap")).alias("target"))
        left, free, clamped = whole - used, weight - gone, n


def seeded_order(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, sizes: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """``docs`` with source_size, target and taken (size units that the mix takes of the row, repeats counted).

    A row is taken as often as its source's target holds the whole source; the rest of the target is filled in
    an order seeded by the id, and the last row of it gives only what is missing. So the taken amounts of a
    source add up to its target, rounded, and no row exceeds ``max_epochs`` rounded up. Reruns agree. ``sizes``
    may be a narrow stored copy (id, source, size) of ``docs`` for the statistics. Rows with a null source form
    a source of their own; null sizes count as 0; a source without any size gets 0; rows that share an id are
    ranked by size, and equal rows are interchangeable; an empty table gives an empty result. The result's own
    columns replace columns of those names.
    """
    taken_names = ("source_size", "target", "taken")
    docs = docs.drop(*taken_names)
    src, size = F.col(source_col), F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    digest = seeded_order(id_col, seed)
    slice_no = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("int")
    facts = [F.col(id_col).alias("_i"), src.alias("_src"), size.alias("_size"), slice_no.alias("_slice")]
    narrow = (docs if sizes is None else sizes).select(facts)
    goals = stored(source_targets(narrow, "_src", "_size", weights, share, max_epochs))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("_times", times.cast("long"))
    goals = goals.withColumn("_want", F.floor(F.col("target") + 0.5).cast("long") - F.col("_times") * F.col("source_size"))
    goals = goals.withColumnRenamed("source", "_goal")
    sums = narrow.groupBy("_src", "_slice").agg(F.sum("_size").alias("_n"))
    upto = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # The slice in which the wanted amount is reached: the one that starts below it and ends at or above it.
    met = sums.join(goals, F.col("_src").eqNullSafe(F.col("_goal"))).where("_before < _want and _before + _n >= _want")
    edge = met.select(F.col("_src").alias("_edge_of"), F.col("_slice").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_rest"))
    goals = goals.join(edge, F.col("_goal").eqNullSafe(F.col("_edge_of")), "left").drop("_edge_of", "_want")
    goals = stored(goals)
    # The caller's row travels in one struct, so its columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest.alias("_md5"), *facts)
    rows = rows.join(goals, F.col("_src").eqNullSafe(F.col("_goal")), "left")
    inside = Window.partitionBy("_goal").orderBy("_md5", "_i", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where("_slice = _edge").withColumn("_sum", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("_rest") - F.col("_sum")))).drop("_sum")
    others = rows.where("_edge is null or _slice <> _edge").withColumn("_part", F.when(F.col("_slice") < F.col("_edge"), F.col("_size")).otherwise(0))
    out = others.unionByName(at_edge)
    return out.select("_row.*", "source_size", "target", (F.col("_times") * F.col("_size") + F.col("_part")).cast("long").alias("taken"))
