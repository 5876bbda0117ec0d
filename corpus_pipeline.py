"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratetally.llm.common import WORD, stored, word_count
from ratetally.llm.jaccard import SENT_ROWS, near_copies
from ratetally.llm.lines import line_dedup
from ratetally.llm.mixing import mix
from ratetally.llm.packing import pack_documents
from ratetally.llm.quality import score, train
from ratetally.llm.substrings import keyed
from ratetally.operators.spread import shared_folder

# What a batch of rows for Python may hold; one of 10,000 texts, the default, is easily ten times that.
BATCH, BATCH_CONF = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject."""
    docs = docs.select(COLUMNS)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has as well; a document that loses its last line goes."""
    out = line_dedup(docs, carry=("lang", "source"))
    left = F.col("kept_text").rlike(WORD) | (F.col("n_removed") == 0)
    return out.where(left).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicate texts the row of the smallest id, null last; rows of no group all stay.

    Rows are told apart by id and text: different texts that share or lack an id are documents of their own. Of equal
    rows of a group one stays. Texts without words have no near duplicates.
    """
    marked = stored(near_copies(docs.select(COLUMNS)))
    more = F.hash(F.coalesce(F.col("text"), F.lit(""))).alias("_more")
    rows = keyed(docs, "doc_id", "text", more, *COLUMNS, apart=True).withColumn("_row", F.struct("_id", "_check", "_more"))

    def named(some: DataFrame) -> DataFrame:
        return F.broadcast(some.select("_key")) if some.count() <= SENT_ROWS else some.select("_key")

    met = F.col("_row") == F.col("_key")
    kept = rows.join(named(marked.where("NOT first")), met, "left_anti")
    repeated = marked.where("first AND copies > 1")
    if repeated.isEmpty():
        return kept.select(COLUMNS)
    repeated = named(repeated)
    # Spark cuts the equal rows down to one a task before they are shuffled.
    one = Window.partitionBy("_row").orderBy("n_chars", "source", "lang")
    single = kept.join(repeated, met, "left_semi").withColumn("_one", F.row_number().over(one)).where("_one = 1")
    return kept.join(repeated, met, "left_anti").select(COLUMNS).unionByName(single.select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the last document of a source may give its first words only."""
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    taken = mix(sized).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(0), whole)
    rows = taken.withColumn("_part", F.explode(F.when(part > 0, F.array_append(copies, part)).otherwise(copies)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_part") > 0, F.array_join(F.slice(words, F.lit(1), F.col("_part")), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def bounded(stage):
    """The stage with texts sent to Python ``BATCH`` at a time, where the session states no bytes itself.

    A batch is held several times, by Spark and by the worker, for every task of an executor; the session keeps the setting.
    """

    @functools.wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, BATCH)
        return stage(spark, docs, sf_dir)

    return run_bounded


STAGES = [
    ("quality classifier", bounded(quality)),
    ("line dedup", bounded(lines)),
    ("near duplicates", bounded(near_duplicates)),
    ("mixing", bounded(mixture)),
    ("packing", bounded(packed)),
]

# A classifier, an edit join and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
