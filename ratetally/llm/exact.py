"""Exact deduplication by content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import fold, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The groups are those of the
    128-bit hash *and* the bytes, so two texts with one hash stay apart. ``keep`` ("min" or "max") names the
    id that stays. Copies are counted before the shuffle, so a group of any size reaches it as a row per task;
    groups of one never meet the join. A row without an id never stays before one with an id; where no row of
    a group has an id, keep_id is null and all of them are kept. Rows that repeat an id with the same text
    count separately and share its decision. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), fold(text_or_empty(F.col(text_col))).alias("_text"))
    rows = rows.withColumn("_hash", F.unhex(F.md5("_text")))
    pick = F.max if keep == "max" else F.min
    groups = rows.groupBy("_hash", "_text").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Both sides meet on a struct: the grouping does not lend its partitioning, so a skewed partition can be split.
    groups = groups.select(F.struct("_hash").alias("_key"), F.col("_text").alias("_same"), "_keep", "_n")
    rows = rows.withColumn("_key", F.struct("_hash"))
    met = rows.join(groups, (rows["_key"] == groups["_key"]) & (F.col("_text") == F.col("_same")), "left")
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return met.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("_id")).alias("kept"),
        F.sha2("_text", 256).alias("text_sha256"),
    )
