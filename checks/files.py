"""Queries that write the given tables as files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import check, read
from checks.grids import FILES, parts
from ratetally.operators import grids as g
from ratetally.operators.spread import shared_folder
from ratetally.sources import files, sinks, tables, textfiles as tf

# Files that one task writes.
FILES_PER_TASK = 250


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@check("""SELECT '' || p_partkey AS id, p_name || ', "' || p_type || '"' AS name, '["' || p_brand || '"]' AS tags FROM part""")
def csv_written_and_read(spark, sf):
    out = folder(spark)
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit('"')).alias("name"), F.array("p_brand").alias("tags"))
    sinks.write_table(p, out, ["id", "name", "tags"])
    return tf.read_delimited(spark, out)


@check(f"""WITH {FILES} SELECT p_brand AS brand, '' || p_partkey AS code, p_name AS name, cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS rate FROM part""")
def delimited_files_read_as_grids(spark, sf):
    """Semicolon files of bounded length, each with a title line and a header."""
    out = folder(spark)
    p = parts(spark, sf)
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    rows = p.select(F.col("p_brand").alias("brand"), (F.col("p_partkey") + 2).alias("at"), line.alias("value"))
    brands = p.select(F.col("p_brand").alias("brand")).distinct()
    head = brands.select("brand", F.inline(F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("Rates of this brand").alias("value")), F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("Procedure Code;Service Name;Facility Rate").alias("value")))))
    both = rows.unionByName(head).repartition("brand").sortWithinPartitions("brand", "at")
    both.select("brand", "value").write.partitionBy("brand").text(out)
    grid = g.read_grid(tf.read_delimited_grid(spark, out), min_cols=2, two_row_headers=False, skip_notes=False)
    w = g.wide(grid, ["Procedure Code", "Service Name", "Facility Rate"])
    brand = F.replace(F.regexp_extract("file_id", "brand=([^/]*)/", 1), F.lit("%2523"), F.lit("#"))
    brand = F.replace(brand, F.lit("%23"), F.lit("#"))
    return w.select(brand.alias("brand"), F.col("`Procedure Code`").alias("code"), F.col("`Service Name`").alias("name"), F.col("`Facility Rate`").alias("rate"))


TEXTS = "SELECT '' || doc_id AS id, md5(coalesce(replace(trim(text), chr(13), ''), '')) AS text FROM documents"


def texts(spark, sf):
    """Ids and texts that go over many lines, null ones too."""
    d = read(spark, sf, "documents")
    return d.select("source", F.col("doc_id").cast("string").alias("id"), F.replace(F.trim("text"), F.lit("\r"), F.lit("")).alias("text"))


@check(TEXTS)
def delimited_cells_over_several_lines(spark, sf):
    """Comma files, one per source, whose quoted cells hold whole texts with their line breaks and quotes."""
    out = folder(spark)
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    texts(spark, sf).select("source", F.concat_ws(",", "id", quoted, F.lit('5" pipe')).alias("value")).write.partitionBy("source").text(out)
    cells = tf.read_delimited_grid(spark, out)
    rows = cells.groupBy("file_id", "row_idx").agg(*[F.max(F.when(F.col("col_idx") == i, F.col("cell"))).alias(n) for i, n in enumerate(("id", "text", "last"))])
    return rows.where("last = '5\" pipe'").select("id", F.md5("text").alias("text"))


@check(TEXTS)
def csv_of_texts_written_and_read(spark, sf):
    out = folder(spark)
    sinks.write_table(texts(spark, sf).select("id", "text"), out, ["id", "text"])
    return tf.read_delimited(spark, out).select("id", F.md5("text").alias("text"))


@check(TEXTS)
def csv_with_line_breaks_in_its_header(spark, sf):
    """Header cells of two lines; files of more than 1,000 bytes are read line by line in splits."""
    out = folder(spark)
    named = texts(spark, sf).select(F.col("id").alias("Document\nid"), F.col("text").alias('Its "text",\nwhole'))
    sinks.write_table(named, out)
    rows = tf.read_delimited(spark, out, whole_bytes=1000)
    return rows.select(F.col("`Document\nid`").alias("id"), F.md5('`Its "text",\nwhole`').alias("text"))


@check("""SELECT l_orderkey, l_linenumber, l_partkey, 'R' || l_returnflag AS flag FROM lineitem""")
def json_arrays_read(spark, sf):
    """One array of order lines per thousand order keys and file."""
    out = folder(spark)
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("R"), F.col("l_returnflag")).alias("flag"))
    rec = F.to_json(F.struct("l_orderkey", "l_linenumber", "l_partkey", "flag"))
    text = li.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("piece")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(rec), ","), F.lit("]")).alias("value"))
    text.select("piece", "value").write.partitionBy("piece").text(out)
    df = tf.read_json_rows(spark, f"{out}/*")
    return df.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "flag")


@check("""SELECT 'Document ' || doc_id || ' of ' || source AS line, count(*) AS n FROM documents GROUP BY 1""")
def text_files_read_as_lines(spark, sf):
    out = folder(spark)
    d = read(spark, sf, "documents").select(F.concat(F.lit(" Document "), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source"), F.lit("\n \n")).alias("value"))
    d.write.text(out)
    lines = tf.text_lines(tf.read_numbered(spark, out))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@check("""WITH f AS (SELECT s_name || repeat('x', s_nationkey) || chr(10) AS t, length(s_name) + 13 AS most FROM supplier)
SELECT cast(length(t) AS bigint) AS bytes_size, CASE WHEN length(t) <= most THEN sha256(t) END AS content_sha256, CASE WHEN length(t) > most THEN 'too_large' END AS error FROM f""")
def scanned_files(spark, sf):
    """A file per supplier; those over a limit are listed but not read. All names have one length."""
    out = folder(spark)
    s = read(spark, sf, "supplier")
    # Files cost their creation, not their bytes: they are dealt over tasks, and each task moves its own into place.
    each = s.select(F.concat("s_name", F.repeat(F.lit("x"), F.col("s_nationkey"))).alias("value")).repartition(s.count() // FILES_PER_TASK + 1)
    each.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(out)
    found = files.scan_files(spark, out, max_bytes=s.agg(F.max(F.length("s_name"))).first()[0] + 13)
    return found.select("bytes_size", "content_sha256", "error")


@check("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def scanned_table(spark, sf):
    name = f"t_{uuid.uuid4().hex}"
    read(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("State_Code"), F.lit(1).alias("row_id")).createOrReplaceTempView(name)
    return tables.scan_table(spark, name, " building ")
