"""Grid queries: delimited lines and messy grids that Spark writes from parts, one file per brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from checks import check, read
from ratetally.operators import grids as g
from ratetally.operators.spread import number_rows
from ratetally.sources import textfiles as tf


def parts(spark, sf) -> DataFrame:
    """Parts; their brand names a file, which grows with the table."""
    return read(spark, sf, "part")


FILES = "files AS (SELECT DISTINCT p_brand FROM part)"


def part_grid(spark, sf) -> DataFrame:
    """Title, label band, header, data on every second row, a note, a repeated header, an empty and an unnamed column."""
    part = number_rows(parts(spark, sf), ["p_brand"], "p_partkey", "n").withColumn("n", (F.col("n") + 1).cast("int"))
    cells = lambda *xs: F.array(*[F.struct(F.lit(i).alias("col_idx"), x.alias("cell")) for i, x in enumerate(xs)])
    head = [F.lit("Procedure Code"), F.lit(" Description"), F.lit("Facility Rate"), F.lit("Non-Facility Rate"), F.lit(""), F.lit("")]
    price = F.col("p_retailprice").cast("decimal(18,2)")
    data = part.select(F.col("p_brand").alias("file_id"), (F.col("n") * 2 + 3).alias("row_idx"), F.inline(cells(
        F.lpad(F.col("p_partkey").cast("string"), 6, "1"), F.concat(F.col("p_name"), F.lit(" of many words")), price.cast("string"), (price / 2).cast("decimal(18,2)").cast("string"), F.lit(" "), F.when(F.col("n") == 1, "x").otherwise("")
    )))
    fixed = F.array(
        F.struct(F.lit(0).alias("row_idx"), cells(F.concat(F.lit("Rates of "), F.col("file_id"))).alias("c")),
        F.struct(F.lit(2).alias("row_idx"), cells(F.lit(""), F.lit(""), F.lit("Workforce"), F.lit("Workforce")).alias("c")),
        F.struct(F.lit(3).alias("row_idx"), cells(*head).alias("c")),
        F.struct(F.lit(6).alias("row_idx"), cells(F.lit("Note: see below")).alias("c")),
        F.struct(F.lit(8).alias("row_idx"), cells(*head).alias("c")),
    )
    top = part.select(F.col("p_brand").alias("file_id")).distinct().select("file_id", F.inline(fixed)).select("file_id", "row_idx", F.inline("c"))
    return data.unionByName(top)


RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"""


@check(f"WITH {FILES}, {RANKED} SELECT p_brand AS file_id, 3 AS header_row, cast(greatest(max(n) * 2 + 3, 8) + 1 AS integer) AS n_rows FROM r GROUP BY p_brand")
def header_rows(spark, sf):
    return g.detect_header(part_grid(spark, sf)).select("file_id", "header_row", "n_rows")


@check("SELECT p_brand AS file_id, 700 AS header_row, cast(count(*) + 701 AS integer) AS n_rows FROM part GROUP BY p_brand HAVING count(*) >= 3")
def header_rows_far_down(spark, sf):
    """Seven hundred lines of text above the header of every file."""
    part = number_rows(parts(spark, sf), ["p_brand"], "p_partkey", "n").withColumn("row_idx", (F.col("n") + 701).cast("int"))
    cells = lambda *xs: F.array(*[F.struct(F.lit(i).alias("col_idx"), x.alias("cell")) for i, x in enumerate(xs)])
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    data = part.select(F.col("p_brand").alias("file_id"), "row_idx", F.inline(cells(F.lpad(F.col("p_partkey").cast("string"), 6, "1"), F.col("p_name"), price)))
    names = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select(F.col("p_brand").alias("file_id"))
    above = names.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(699))).alias("row_idx")).select("file_id", "row_idx", F.lit(0).alias("col_idx"), F.concat(F.lit("Line "), F.col("row_idx").cast("string")).alias("cell"))
    head = names.select("file_id", F.lit(700).alias("row_idx"), F.inline(cells(F.lit("Procedure Code"), F.lit("Description"), F.lit("Facility Rate"))))
    return g.detect_header(data.join(names, "file_id", "left_semi").unionByName(above).unionByName(head)).select("file_id", "header_row", "n_rows")


@check(f"""WITH {FILES}, {RANKED} SELECT p_brand AS file_id, cast(n * 2 + 3 AS integer) AS row_idx, lpad('' || p_partkey, 6, '1') AS code, p_name || ' of many words' AS description,
 cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS rate, CASE WHEN n = 1 THEN 'x' ELSE '' END AS extra FROM r""")
def grid_bodies(spark, sf):
    out = g.wide(g.read_grid(part_grid(spark, sf), repeated_headers=True), ["Procedure Code", "Description", "Workforce · Facility Rate", "col_6"])
    return out.select("file_id", "row_idx", F.col("`Procedure Code`").alias("code"), F.col("Description").alias("description"), F.col("`Workforce · Facility Rate`").alias("rate"), F.col("col_6").alias("extra"))


@check(f"""WITH {FILES} SELECT p_brand AS file_id, cast(c.i AS integer) AS col_idx, c.name AS name FROM (SELECT DISTINCT p_brand FROM part), (VALUES (0, 'Procedure Code'), (1, 'Description'), (2, 'Workforce · Facility Rate'), (3, 'Workforce · Non-Facility Rate'), (5, 'col_6')) c(i, name)""")
def grid_columns(spark, sf):
    return g.read_grid(part_grid(spark, sf)).columns


@check(f"""WITH {FILES}, {RANKED} SELECT p_brand AS file_id, count(*) + 2 AS rows_kept FROM r GROUP BY p_brand""")
def grid_rows_with_notes_and_repeats(spark, sf):
    out = g.as_rows(g.read_grid(part_grid(spark, sf), two_row_headers=False, skip_notes=False))
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows_kept"))


@check(f"""WITH {FILES}, {RANKED} SELECT p_brand AS file_id, (5 + max(n)) * 6 AS cells, cast(6 AS bigint) AS width FROM r GROUP BY p_brand""")
def padded_grids(spark, sf):
    out = g.pad_grid(part_grid(spark, sf))
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("cells"), (F.max("col_idx") + 1).cast("bigint").alias("width"))


@check("""SELECT p_partkey, p_name, '' AS Notes, 'x' AS col_3, CASE WHEN p_size % 2 = 0 THEN '50%' ELSE 'n/a' END AS rate FROM part WHERE p_partkey % 10 <> 0""")
def tidied_wide_table(spark, sf):
    k = F.col("p_partkey")
    t = parts(spark, sf).select(
        F.when(k % 10 == 0, F.lit("NOTE: none")).otherwise(F.col("p_name")).alias("p_name"), "p_partkey", F.lit("").alias("Notes"), F.lit(" ").alias("col_2"), F.lit("x").alias("col_3"),
        F.when(F.col("p_size") % 2 == 0, "0.5").otherwise("n/a").alias("rate"),
    )
    out = g.percent_columns(g.skip_note_rows(g.drop_placeholder_columns(t), "p_name"))
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@check(f"""WITH {FILES} SELECT p_brand AS file_id, cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, p_partkey) - 1 AS integer) AS row_idx, '' || p_partkey AS first, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS last FROM (SELECT * FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_partkey % 2) >= 2)""")
def merged_blocks(spark, sf):
    k = F.col("p_partkey")
    cells = lambda *xs: F.array(*[F.struct(F.lit(i).alias("col_idx"), x.alias("cell")) for i, x in enumerate(xs)])
    a, t, n = k.cast("string"), F.col("p_type"), F.col("p_name")
    p = parts(spark, sf).where("p_partkey % 2 = 0").select(F.col("p_brand").alias("file_id"), (k % 2).cast("int").alias("block_no"), (k * 3).cast("int").alias("row_idx"), F.inline(cells(a, t, t, n)))
    q = parts(spark, sf).where("p_partkey % 2 = 1").select(F.col("p_brand").alias("file_id"), (k % 2).cast("int").alias("block_no"), (k * 3).cast("int").alias("row_idx"), F.inline(cells(a, n, n, t)))
    far = parts(spark, sf).where("p_size > 48").select(F.col("p_brand").alias("file_id"), F.lit(7).alias("block_no"), k.cast("int").alias("row_idx"), F.inline(cells(a, a)))
    out = g.merge_blocks(p.unionByName(q).unionByName(far))
    return out.groupBy("file_id", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, F.col("cell"))).alias("first"), F.max(F.when(F.col("col_idx") == 3, F.col("cell"))).alias("last"))


def part_lines(spark, sf) -> DataFrame:
    """Delimited lines, a different delimiter per brand, quoted cells, blank lines."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 3
    sep = F.when(n == 0, ",").when(n == 1, "\t").otherwise(";")
    line = F.concat_ws("", F.col("p_partkey").cast("string"), sep, F.lit('"'), F.col("p_name"), sep, F.lit(' ""x"""'), sep, F.lit(""), sep, F.col("p_type"))
    lines = parts(spark, sf).select(F.col("p_brand").alias("file_id"), F.inline(F.array(
        F.struct((F.col("p_partkey") * 2).alias("line_no"), line.alias("line")), F.struct((F.col("p_partkey") * 2 + 1).alias("line_no"), F.lit("  ").alias("line"))
    )))
    return lines


SEP = "CASE cast(regexp_extract(p_brand, '\\d+') AS integer) % 3 WHEN 0 THEN ',' WHEN 1 THEN chr(9) ELSE ';' END"


@check(f"""WITH {FILES} SELECT p_brand AS file_id, cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS integer) AS row_idx, 4 AS cells, '' || p_partkey AS c0, p_name || {SEP} || ' "x"' AS c1, '' AS c2, p_type AS c3 FROM part""")
def delimited_lines(spark, sf):
    c = tf.delimited_cells(part_lines(spark, sf))
    at = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("cell"))).alias(f"c{i}")
    return c.groupBy("file_id", "row_idx").agg(F.count(F.lit(1)).cast("int").alias("cells"), *[at(i) for i in range(4)])


@check(f"WITH {FILES} SELECT DISTINCT p_brand AS file_id, {SEP} AS sep FROM part")
def sniffed_delimiters(spark, sf):
    return tf.sniff_delimiter(part_lines(spark, sf))


@check(r"""WITH l AS (SELECT doc_id, trim(x.line, E' \t\r\n') AS line, x.i AS i FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents) y, LATERAL (SELECT z[1] AS line, z[2] AS i) x)
SELECT cast(doc_id AS varchar) AS file_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, md5(line) AS line FROM l WHERE line <> ''""")
def numbered_text_lines(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return tf.text_lines(d).select("file_id", "n", F.md5("line").alias("line"))
