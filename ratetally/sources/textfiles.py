"""Text files as numbered lines and as grids of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ratetally.functions.text import strip
from ratetally.operators.spread import attach, attach_few, cut_lineage, first_per_group, number_rows

FILE_LINE = ["file_id", "line_no"]


def read_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, line_no, line) of every line, numbered from 0 in its file.

    A large file is read in splits. Lines are numbered within their split and shifted by the sizes of
    the splits before it, so no task holds more than one split, and lines are not shuffled.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_seen"), F.col("value").alias("line"),
    )
    # The ids of a split follow each other, so its smallest one and its size are all that the others need.
    sizes = raw.groupBy("file_id", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_from"))
    before = Window.partitionBy("file_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file_id", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_off"))
    out = attach_few(raw, offsets, ["file_id", "_at"])
    return out.select("file_id", (F.col("_off") + F.col("_seen")).alias("line_no"), F.regexp_replace("line", "^﻿", "").alias("line"))


def text_lines(lines: DataFrame, clip: int | None = None) -> DataFrame:
    """(file_id, n, line): filled lines, stripped, numbered from 1.

    ``clip`` shortens longer lines, and adds a column ``clipped`` that says which.
    """
    filled = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    out = number_rows(filled, ["file_id"], "line_no", "_n")
    out = out.select("file_id", (F.col("_n") + 1).alias("n"), "line")
    if clip is None:
        return out
    return out.withColumn("clipped", F.length("line") > clip).withColumn("line", F.substring("line", 1, clip))


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """(file_id, sep): the delimiter (comma, tab or semicolon) of each file by its filled lines.

    Wanted is the one that occurs in most lines, then the one with the most even count, then the most frequent.
    """
    first = lines.where(strip(F.col("line")) != "")
    bare = F.regexp_replace("line", r'"[^"]*"', "")
    counts = F.array(*[
        F.struct(F.lit(i).alias("pref"), F.lit(d).alias("sep"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"))
        for i, d in enumerate([",", "\t", ";"])
    ])
    c = first.select("file_id", F.inline(counts))
    g = c.groupBy("file_id", "pref", "sep").agg(F.count_if(F.col("n") > 0).alias("lines"), (F.max("n") - F.min("n")).alias("spread"), F.sum("n").alias("total"))
    order = [F.col("lines").desc(), F.col("spread").asc(), F.col("total").desc(), F.col("pref").asc()]
    return first_per_group(g, ["file_id"], order).select("file_id", F.when(F.col("lines") > 0, F.col("sep")).otherwise(",").alias("sep"))


def split_line(line: Column, sep: Column) -> Column:
    """Cells of a delimited line. Quotes protect the delimiter, two of them inside quotes stand for one."""
    led = F.concat(sep, line)
    by = lambda d: F.regexp_extract_all(led, F.lit(d + r'("(?:[^"]++|"")*+"[^' + d + r"]*|[^" + d + r"]*)"), 1)
    cut = F.when(sep == ",", by(",")).when(sep == "\t", by("\t")).otherwise(by(";"))
    quoted = r'^"((?:[^"]++|"")*+)"'
    return F.transform(
        cut, lambda c: F.when(c.rlike(quoted), F.replace(F.regexp_replace(c, quoted, "$1"), F.lit('""'), F.lit('"'))).otherwise(c)
    )


def _quoting(line: Column, sep: Column, blanks: bool = False) -> tuple[Column, Column]:
    """Does a quoted cell stay open at the end of the line: when none was open before it, and when one was.

    With ``blanks`` a quote may follow blanks behind its delimiter.
    """
    gap = r"[ \t]*" if blanks else ""

    def opens(text):
        led = F.concat(sep, text)
        by = lambda d: F.regexp_replace(led, d + gap + r'"(?:[^"]++|"")*+"', d + "x").rlike(d + gap + r'"')
        return F.when(sep == ",", by(",")).when(sep == "\t", by("\t")).otherwise(by(";")).cast("int")

    rest = F.regexp_extract(line, r'^(?:[^"]++|"")*+"(.*)$', 1)
    closes = line.rlike(r'^(?:[^"]++|"")*+"(?!")')
    quoted = line.contains('"')
    return F.when(quoted, opens(line)).otherwise(0), F.when(quoted & closes, opens(F.concat(F.lit("x"), rest))).otherwise(1)


def joined_lines(lines: DataFrame, seps: DataFrame, rows_per_slice: int = 1_000_000, blanks: bool = False) -> DataFrame:
    """(file_id, line_no, line, sep, torn) with the lines of a quoted cell put together, under the number of the first.

    Files in which no line leaves a cell open are passed on as they are. In the others, whether a cell is open when a line
    starts depends on all lines before it: a line keeps, opens or closes that state, or turns it around. Slices of
    a file are summed up first and then gone through by themselves, so no task holds a file. A cell that is still open
    when its file ends is no cell: the lines from its record on stay lines, with ``torn`` set.
    """
    tagged = attach_few(lines, seps, ["file_id"])
    calm, busy = _quoting(F.col("line"), F.col("sep"), blanks)
    plain = lambda df: df.select("file_id", "line_no", "line", "sep", F.lit(False).alias("torn"))
    opening = cut_lineage(tagged.where(calm == 1).select("file_id").distinct())
    if opening.isEmpty():
        return plain(tagged)
    rest = attach_few(tagged, opening, ["file_id"], "semi")
    step = rest.withColumns({"_f0": calm, "_f1": busy, "_slice": F.floor(F.col("line_no") / F.lit(rows_per_slice))})
    # Fixed: the state after the line whatever it was before; turn: the line turns the state around.
    step = step.withColumns({"_fixed": F.when(F.col("_f0") == F.col("_f1"), F.col("_f0")), "_turn": ((F.col("_f0") == 1) & (F.col("_f1") == 0)).cast("int")})
    w = Window.partitionBy("file_id", "_slice").orderBy("line_no")
    step = step.withColumn("_turns", F.sum("_turn").over(w))
    step = step.withColumn("_last", F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns")), ignorenulls=True).over(w))
    step = cut_lineage(step.drop("_f0", "_f1", "_fixed", "_turn"))
    state = lambda start: F.when(F.col("_last").isNull(), (start + F.col("_turns")) % 2).otherwise((F.col("_last._fixed") + F.col("_turns") - F.col("_last._turns")) % 2)
    ends = step.groupBy("file_id", "_slice").agg(F.max_by(F.struct(state(F.lit(0)).alias("calm"), state(F.lit(1)).alias("busy")), "line_no").alias("e"))
    in_order = F.array_sort(F.collect_list(F.struct("_slice", "e")))
    walk = lambda acc, x: F.array_append(acc, F.when(F.element_at(acc, -1) == 1, x["e"]["busy"]).otherwise(x["e"]["calm"]).cast("int"))
    starts = ends.groupBy("file_id").agg(in_order.alias("s")).select("file_id", F.col("s._slice").alias("s"), F.aggregate("s", F.array(F.lit(0)), walk).alias("at"))
    starts = starts.select("file_id", (F.element_at("at", -1) == 1).alias("_unclosed"), F.inline(F.arrays_zip(F.col("s").alias("_slice"), F.slice("at", F.lit(1), F.size("s")).alias("_start"))))
    step = attach_few(step, starts, ["file_id", "_slice"])
    after = state(F.col("_start"))
    before = F.coalesce(F.lag("_after").over(w), F.col("_start"))
    step = step.withColumn("_after", after).withColumn("_open", before)
    # A record takes the number of its first line: the last line before it, in its slice or an earlier one, that starts calm.
    own = F.last(F.when(F.col("_open") == 0, F.col("line_no")), ignorenulls=True).over(w)
    step = cut_lineage(step.select("file_id", "line_no", "line", "sep", "_slice", "_unclosed", own.alias("_record")))
    heads = step.groupBy("file_id", "_slice").agg(F.max("_record").alias("_head"))
    files = Window.partitionBy("file_id")
    earlier = files.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file_id", "_slice", F.last("_head", ignorenulls=True).over(earlier).alias("_head"), F.max("_head").over(files).alias("_final"))
    step = attach_few(step, heads, ["file_id", "_slice"]).withColumn("_record", F.coalesce("_record", "_head"))
    torn = F.col("_unclosed") & (F.col("_record") >= F.col("_final"))
    step = step.withColumn("torn", torn).withColumn("_record", F.when(torn, F.col("line_no")).otherwise(F.col("_record")))
    single = step.groupBy("file_id", "_record", "sep", "torn").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = single.select("file_id", F.col("_record").alias("line_no"), F.array_join("l.line", "\n").alias("line"), "sep", "torn")
    return plain(attach_few(tagged, opening, ["file_id"], "anti")).unionByName(joined)


def torn_files(lines: DataFrame, seps: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no, n_lines, error) of the files that end inside a quoted cell: where its record starts, and its lines."""
    records = joined_lines(lines, sniff_delimiter(lines) if seps is None else seps).where("torn")
    at = records.groupBy("file_id").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n_lines"))
    return at.withColumn("error", F.lit("A quoted cell is not closed before the file ends."))


def delimited_cells(lines: DataFrame, seps: DataFrame | None = None) -> DataFrame:
    """Grid cells (file_id, row_idx, col_idx, cell) of delimited lines; blank lines go, ragged rows stay ragged.

    A quoted cell may go over several lines; one that its file never closes is read line by line, see ``torn_files``.
    """
    seps = sniff_delimiter(lines) if seps is None else seps
    records = joined_lines(lines, seps).where(strip(F.col("line")) != "")
    rows = number_rows(records, ["file_id"], "line_no", "_row")
    return rows.select("file_id", F.col("_row").cast("int").alias("row_idx"), F.posexplode(split_line(F.col("line"), F.col("sep"))).alias("col_idx", "cell"))


def read_delimited_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid cells of delimited text files with sniffed delimiters; header detection is left to ``grids.read_grid``."""
    return delimited_cells(read_numbered(spark, path))


def read_delimited(spark: SparkSession, path: str, line_breaks: bool = True, whole_bytes: int | None = None) -> DataFrame:
    """Delimited files whose first record is the header. Tab is taken when the first line has more tabs than commas.

    Blank header cells become ``col_N``. Quoted cells, header cells too, may hold line breaks. Files of up to ``whole_bytes``
    (as a rule one split of the session) are read in one piece each; larger ones line by line in splits, where the
    lines of a cell are put together by ``joined_lines``. With ``line_breaks`` off every file is read in splits.
    """
    head = spark.read.text(path).where(F.length("value") > 0).limit(1).first()
    if head is None:
        raise ValueError(f"No lines in {path}")
    sep = "\t" if head["value"].count("\t") > head["value"].count(",") else ","
    pieces = line_breaks and sep == ","
    options = {
        "sep": sep, "quote": '"' if sep == "," else "\x00", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "multiLine": str(pieces).lower(),
    }
    first = spark.read.options(**options).csv(path, header=False).first()
    names = [(c or "").lstrip("\ufeff").strip() or f"col_{i + 1}" for i, c in enumerate(first)]
    schema = ", ".join(f"`_c{i}` string" for i in range(len(names)))
    shown = lambda df: df.select(*[F.coalesce(F.col(f"_c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])
    read = lambda at: shown(spark.read.options(**options).schema(schema).csv(at, header=True, enforceSchema=True))
    if not pieces:
        return read(path)
    limit = whole_bytes or int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    # Sizes come with the listing of the files; only the large ones are named.
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > limit).collect()]
    if not large:
        return read(path)
    small = [r["path"] for r in sizes.where(F.col("length") <= limit).collect()]
    lines = read_numbered(spark, large)
    records = joined_lines(lines, lines.select("file_id").distinct().withColumn("sep", F.lit(sep)), blanks=True).where(strip(F.col("line")) != "")
    records = cut_lineage(records.select("file_id", "line_no", "line"))
    heads = records.groupBy("file_id").agg(F.min("line_no").alias("_head"))
    rows = attach(records, heads, ["file_id"]).where("line_no > _head")
    out = shown(rows.select(F.from_csv("line", schema, options).alias("r")).select("r.*"))
    return out.unionByName(read(small)) if small else out


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a JSON array of objects: the members of the first object in their order, then all others by name."""
    df = spark.read.option("multiLine", True).json(path)
    named = spark.read.text(path, wholetext=True).select(F.struct(F.col("_metadata.file_path").alias("at"), F.json_object_keys(F.get_json_object("value", "$[0]")).alias("k")).alias("f"))
    first = named.agg(F.min("f").alias("f")).first()["f"]
    order = [k for k in (first["k"] or []) if k in df.columns] if first else []
    order += [c for c in df.columns if c not in order]
    return df.select(*[F.col(f"`{c}`") for c in order])
