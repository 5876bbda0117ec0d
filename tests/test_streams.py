"""Streams: keyed state instead of reading back, and merges that touch only their buckets."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ratetally.streaming import fetches

EVENTS = "n int, state string, sha string"


def feed(spark, folder, rows):
    """One file, hence one micro-batch."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, order):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = fetches.stream_once(events, ["state", "sha"], f"{folder}/out", f"{folder}/log", order=order)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("order", [["n"], []])
def test_no_batch_reads_what_earlier_ones_wrote(spark, tmp_path, order):
    folder = str(tmp_path)
    batches = [[(5, "a", "x"), (3, "a", "x"), (9, None, "x")], [(1, "a", "x"), (2, "a", "y")], [(4, None, "x"), (4, "b", None)], [(7, "b", None), (8, "c", "z"), (8, "c", "z")], [(0, "c", "z")]]
    got = []
    for n, batch in enumerate(batches):
        feed(spark, folder, batch)
        run(spark, folder, order)
        got.append(list(tuple(r)[1:] for r in spark.read.schema(EVENTS).parquet(f"{folder}/out/batch_id={n}").collect()))
        # A restart follows, and nothing that was written is there any more.
        shutil.rmtree(f"{folder}/out/batch_id={n}")
    assert [set(g) for g in got] == [{("a", "x"), (None, "x")}, {("a", "y")}, {("b", None)}, {("c", "z")}, set()]
    assert [len(g) for g in got] == [2, 1, 1, 1, 0]


def test_the_first_event_of_a_batch_is_kept_and_batches_repeat_alike(spark, tmp_path):
    folder = str(tmp_path)
    feed(spark, folder, [(5, "a", "x"), (3, "a", "x"), (4, "a", "x"), (2, "b", "x")])
    run(spark, folder, ["n"])
    feed(spark, folder, [(1, "a", "x"), (None, "c", "x"), (6, "c", "x")])
    query = run(spark, folder, ["n"])
    assert {tuple(r) for r in fetches.read_once(spark, f"{folder}/out").collect()} == {(3, "a", "x"), (2, "b", "x"), (None, "c", "x")}
    state = query.lastProgress.stateOperators[0]
    assert (state.operatorName, state.numRowsTotal) == ("transformWithStateInPandasExec", 3)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


VERSIONS = "artifact_id long, state_code string, logical_schedule_key string, content_sha256 string, portal_effective_date date, fetched_at_utc timestamp, is_superseded_hint boolean"


def files_of(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/out/base/*/bucket=*/*.parquet")}


def test_a_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    folder = str(tmp_path)
    keys = [f"key{i}" for i in range(200)]

    def batch(rows):
        some = [(n, "GA", k, f"sha{n}", None, None, None) for n, k in rows]
        spark.createDataFrame(some, VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        versions = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        fetches.stream_current(versions, f"{folder}/out", f"{folder}/log", compact_every=1, buckets=16).awaitTermination()

    batch(list(enumerate(keys)))
    before = files_of(folder)
    assert len(before) == 16
    batch([(1000, "key7")])
    after = files_of(folder)
    assert {p: after.get(p) for p in before} == before
    bucket = spark.range(1).select(F.lit("GA").alias("state_code"), F.lit("key7").alias("logical_schedule_key")).select(fetches.key_bucket(16)).first()[0]
    assert {p.split("bucket=")[1].split("/")[0] for p in after.keys() - before.keys()} == {str(bucket)}
    current = {r["logical_schedule_key"]: r["artifact_id"] for r in fetches.read_current(spark, f"{folder}/out").collect()}
    assert current == {k: 1000 if k == "key7" else n for n, k in enumerate(keys)}
    # A merge that broke off has no marker and is not read.
    os.remove(f"{folder}/out/base/batch_id=1/_SUCCESS")
    current = {r["logical_schedule_key"]: r["artifact_id"] for r in fetches.read_current(spark, f"{folder}/out").collect()}
    assert current["key7"] == 1000 and len(current) == 200


def test_contents_that_repeat_in_the_files_of_one_run(spark, tmp_path):
    """Every content comes about nine times, four of them in the first run: the smallest id is the one that is kept."""
    from checks import load_all

    folder = str(tmp_path)
    spark.sql("SELECT 1L AS c_custkey, 'BUILDING' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    orders = "id AS o_orderkey, 1L AS o_custkey, '1-URGENT' AS o_orderpriority, timestamp_ntz'2024-01-01 00:00:00' AS o_orderdate, 'F' AS o_orderstatus"
    spark.range(8000).selectExpr(*orders.split(", ")).repartition(5).write.parquet(f"{folder}/orders.parquet")
    got = load_all()["stream_of_contents_once"].run(spark, folder).select("artifact_id", "logical_schedule_key").collect()
    firsts = {}
    for k in range(8000):
        firsts.setdefault((k % 900, k % 50 == 0), k)
    assert sorted(r["artifact_id"] for r in got) == sorted(firsts.values())
