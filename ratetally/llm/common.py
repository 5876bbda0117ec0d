"""What several operators of this package share: words, case folding, stored steps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ratetally.operators.spread import cut_lineage as stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["LOWER", "UPPER", "WORD", "components", "fold", "forget", "kept", "sliced", "stored", "text_or_empty", "word_count"]


# What a worker process keeps between its tasks, of one operator at a time.
_KEPT: dict = {}


def kept(name: str, make: Callable):
    """What ``make`` gives, kept in the worker process between tasks until something of another name is wanted.

    Spark uses a worker for one operator after the other: what the one before remembers would add to what the next one needs.
    """
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drop what this worker process keeps for earlier tasks."""
    _KEPT.clear()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """Lower case for A-Z only. Pure ASCII, where ``lower`` does the same, takes the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def sliced(batch: pa.RecordBatch, text_col: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, one row at least, so that what a task builds of them stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype("int64")
    piece = (np.cumsum(sizes) - sizes) // most
    heads = np.flatnonzero(np.append(True, np.diff(piece) != 0)) if len(piece) else []
    for at, end in zip(heads, [*heads[1:], len(piece)]):
        yield batch.slice(at, end - at)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b) of longs; component: its smallest node.

    Alternates "every larger neighbour points to my smallest" and "every smaller neighbour points to my
    smallest", which ends with one star per component after a number of rounds that grows with the logarithm of
    the longest path. A node only ever needs the minimum of its neighbours, which is combined before the
    shuffle, so a hub with very many edges is not gathered anywhere. Each round is stored, so a lost executor
    costs one round. Self edges and nulls are ignored; a node without a proper edge has no row.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        key = F.struct("a").alias("k")
        large = both.where("b > a").select(key, F.col("b").alias("v")).join(low.select(key, "m"), "k").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.select(key, F.col("b").alias("v")).join(low.select(key, "m"), "k").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small)
        # The edges of a round are a set; its size and two sums tell whether it has changed.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.sum(F.pmod(F.hash("a", "b"), F.lit(1 << 30)))).first()
        if mark == seen:
            nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        seen = mark
