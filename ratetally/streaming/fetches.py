"""Streams of fetch events: exactly one row per content, and current versions kept up to date."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ratetally.functions.text import strip
from ratetally.operators.versions import effective_day, state_key


def stream_dedupe(events: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First event per key within the watermark; a key may come again once ``delay`` has passed. See ``stream_once``."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def start_folder(spark: SparkSession, folder: str, schema: StructType) -> None:
    """An empty batch, so that the folder can be read before the first batch is written."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch_id=-1")


class FirstOfKey(StatefulProcessor):
    """Of every key the first row it ever brings; what is kept is that the key has come, nothing else."""

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.came = handle.getValueState("came", "came boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.came.exists():
            return
        first = None
        for some in rows:
            some = some if first is None else pd.concat([first, some])
            first = some.sort_values(self.order, kind="stable", na_position="first").head(1)
        if first is not None:
            self.came.update((True,))
            yield first

    def close(self) -> None:
        pass


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, with a log of changes per batch; the session is left as it was."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_once(events: DataFrame, keys: Sequence[str], path: str, checkpoint: str, order: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Write exactly one event per key under ``path``, however late or often it is repeated.

    Which keys have come is the state of the query, a keyed store on disk under ``checkpoint``: a batch looks up its own
    keys only and reads nothing of what other batches have written. With ``order`` the first event of the batch that
    brings a key is kept, nulls first; without it any one of them, by Spark's own operator inside the JVM. A batch is written
    into a folder named by it, so one that is repeated after a failure or a restart overwrites itself. Null is a key
    like any other. The state holds every key ever seen; ``stream_dedupe`` forgets them after a delay.
    """
    spark, keys, columns = events.sparkSession, list(keys), list(events.columns)
    start_folder(spark, path, events.schema)
    if order:
        firsts = events.groupBy(*keys).transformWithStateInPandas(FirstOfKey(order), events.schema, "Append", "None")
    else:
        firsts = events.dropDuplicates(keys)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with state_on_disk(spark):
        return firsts.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The events that ``stream_once`` has stored."""
    return spark.read.parquet(path).drop("batch_id")


def best_version(versions: DataFrame) -> DataFrame:
    """Best version per (state, key) as one struct; applying it again to its own results gives the same winner."""
    rank = F.struct(
        (~F.coalesce(F.col("is_superseded_hint"), F.lit(False))).alias("live"),
        effective_day(F.col("portal_effective_date"), F.col("fetched_at_utc")).alias("day"),
        F.col("artifact_id").alias("artifact_id"), F.col("content_sha256").alias("content_sha256"),
    )
    keyed = versions.select(state_key(F.col("state_code")).alias("state_code"), strip(F.col("logical_schedule_key")).alias("logical_schedule_key"), rank.alias("best"))
    return keyed.where("logical_schedule_key <> ''").groupBy("state_code", "logical_schedule_key").agg(F.max("best").alias("best"))


BEST = "state_code string, logical_schedule_key string, best struct<live:boolean,day:date,artifact_id:bigint,content_sha256:string>"
BUCKETS = 64


def stream_current(versions: DataFrame, path: str, checkpoint: str, compact_every: int = 16, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Keep the best version per key under ``path``.

    Each batch writes its own winners, by key bucket, into a folder named by the batch, so a repeated batch
    overwrites itself. Every ``compact_every`` batches the buckets that were touched since the last time, and no
    others, are merged with what they held and written as a new version of these buckets. Readers take the
    last version of every bucket and the batches after the last merge. ``buckets`` must stay the same for a ``path``.
    """
    spark = versions.sparkSession
    schema = StructType.fromDDL(f"{BEST}, bucket int")
    for part in ("base", "tail"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{part}/batch_id=-1")

    def save(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        best_version(batch).withColumn("bucket", key_bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tail/batch_id={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            merge_buckets(own, path, batch_id, buckets)

    return versions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def key_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("state_code", "logical_schedule_key"), F.lit(buckets)).cast("int")


def folders(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The buckets of every batch folder under ``path``; names are listed, no file is opened. At most one per bucket and batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = re.compile(r".*=(-?\d+)")
    inside = lambda p: [(int(m[1]), x.getPath()) for x in files.listStatus(p) if x.isDirectory() and (m := name.fullmatch(x.getPath().getName()))]
    return {batch: sorted(b for b, _ in inside(p)) for batch, p in inside(root) if files.exists(hadoop.Path(p, "_SUCCESS"))}


def last_versions(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, int], int]:
    """The last batch that rewrote every bucket of the base, and the last merge; of those before a batch where it is given."""
    base = {n: b for n, b in folders(spark, f"{path}/base").items() if before is None or n < before}
    versions = {b: n for n in sorted(base) for b in base[n]}
    return versions, max(base, default=-1)


def parts_of(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    schema = StructType.fromDDL(BEST)
    paths = [f"{path}/{n}" for n in names]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state_code", "logical_schedule_key").agg(F.max("best").alias("best"))


def merge_buckets(spark: SparkSession, path: str, batch_id: int, buckets: int) -> None:
    """Write a new version of every bucket that a batch since the last merge has touched."""
    versions, last = last_versions(spark, path, batch_id)
    tail = [(n, b) for n, bs in folders(spark, f"{path}/tail").items() if last < n <= batch_id for b in bs]
    touched = sorted({b for _, b in tail})
    names = [f"tail/batch_id={n}/bucket={b}" for n, b in tail] + [f"base/batch_id={versions[b]}/bucket={b}" for b in touched if b in versions]
    rows = parts_of(spark, path, names)
    merged(rows).withColumn("bucket", key_bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/batch_id={batch_id}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Current version per (state, key) over all batches written so far."""
    versions, last = last_versions(spark, path)
    names = [f"base/batch_id={n}/bucket={b}" for b, n in sorted(versions.items())]
    names += [f"tail/batch_id={n}/bucket={b}" for n, bs in sorted(folders(spark, f"{path}/tail").items()) if n > last for b in bs]
    best = merged(parts_of(spark, path, names))
    return best.select("state_code", "logical_schedule_key", "best.artifact_id", "best.content_sha256", F.col("best.day").alias("effective_day"), F.col("best.live").alias("live"))
