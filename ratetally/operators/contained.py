"""Texts that contain other texts of their scope, counted by one multi-pattern index per part of a scope."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratetally.operators.spread import attach

# Characters of patterns in one index, and of texts that one task runs along it.
PATTERN_CHARS = 4_000_000
TEXT_CHARS = 16_000_000


def index_of(patterns: list[str]) -> ahocorasick.Automaton:
    """All patterns in one automaton; a match gives the place of the pattern in the list."""
    index = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        index.add_word(pattern, i)
    if patterns:
        index.make_automaton()
    return index


def summed(id_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """One row per asking text of a group: added weights and smallest id of the others that it meets."""
    schema = pa.schema([("scope", pa.string()), ("title", pa.string()), ("n", pa.int64()), ("a_id", id_type)])

    def meet(table: pa.Table) -> pa.Table:
        titles, weights, ids = (table[c].to_pylist() for c in ("title", "n", "a_id"))
        pattern, asks = (table[c].to_pylist() for c in ("pattern", "asks"))
        short = [i for i, p in enumerate(pattern) if p]
        total: dict[int, list] = {}
        if 0 < len(short) < len(titles):
            index = index_of([titles[i] for i in short])
            for at, is_pattern in enumerate(pattern):
                if is_pattern:
                    continue
                for i in {short[found] for _, found in index.iter(titles[at])}:
                    asker, other = (at, i) if asks[at] else (i, at)
                    got = total.get(asker)
                    if got is None:
                        total[asker] = [weights[other], ids[other]]
                    else:
                        got[0] += weights[other]
                        got[1] = min(got[1], ids[other])
        rows = [(table["scope"][0].as_py(), titles[i], n, a_id) for i, (n, a_id) in total.items()]
        return pa.table([list(c) for c in zip(*rows)] or [[]] * 4, schema=schema)

    return meet


def dealt(both: DataFrame, pattern_asks: bool) -> DataFrame:
    """The rows of one direction in the groups (scope, part, block) that meet; a scope that fits one index and block has one."""
    chars = lambda asks: F.coalesce(F.sum(F.when(F.col("asks") == asks, F.char_length("title"))), F.lit(0))
    sizes = both.groupBy("scope").agg(chars(pattern_asks).alias("short"), chars(not pattern_asks).alias("long")).where("short > 0 AND long > 0")
    many = lambda c, room: F.ceil(F.col(c) / room).cast("int")
    sized = attach(both, sizes.select("scope", many("short", PATTERN_CHARS).alias("parts"), many("long", TEXT_CHARS).alias("blocks")), ["scope"])
    place = lambda c: F.array(F.pmod(F.hash("title"), F.col(c)))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pattern = F.col("asks") == pattern_asks
    parts = sized.withColumn("pattern", pattern).withColumn("part", F.explode(F.when(pattern, place("parts")).otherwise(every("parts"))))
    blocks = parts.withColumn("block", F.explode(F.when(pattern, every("blocks")).otherwise(place("blocks"))))
    return blocks.select("scope", "part", "block", "title", "n", "a_id", "asks", "pattern")


def contained_or_containing(asking: DataFrame, known: DataFrame) -> DataFrame:
    """Per asking (scope, title): n and a_id over the titles known in its scope that it contains or that contain it.

    ``known`` has distinct (scope, title) with n and a_id; n is added up, the smallest a_id is kept. Each direction
    builds an index of the titles that may be contained and runs the others along it, letter by letter: a title of one
    letter costs one step where it occurs, whatever else holds it. Patterns of a scope are dealt to indexes of bounded
    size, texts to blocks, so a scope of any size is spread over tasks. A group sends one row per asking title at most.
    Titles that are equal on both sides count as well, in both directions; empty titles contain nothing.
    """
    id_type = known.schema["a_id"].dataType
    asked = asking.select("scope", "title", F.lit(None).cast("long").alias("n"), F.lit(None).cast(id_type).alias("a_id"), F.lit(True).alias("asks"))
    both = asked.unionByName(known.select("scope", "title", "n", "a_id", F.lit(False).alias("asks"))).where("title <> ''")
    work = summed({"bigint": pa.int64(), "int": pa.int32()}.get(id_type.simpleString(), pa.string()))
    schema = f"scope string, title string, n long, a_id {id_type.simpleString()}"
    met = None
    for pattern_asks in (True, False):
        some = dealt(both, pattern_asks).groupBy("scope", "part", "block").applyInArrow(work, schema)
        met = some if met is None else met.unionByName(some)
    return met.groupBy("scope", "title").agg(F.sum("n").alias("n"), F.min("a_id").alias("a_id"))
