"""Messy grids as long cells (file_id, row_idx, col_idx, cell): header rows, widths, notes, blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.functions.cells import header_bonus, is_data_like, is_number_text, is_percent_header, is_rate_id, percent_text
from ratetally.functions.text import strip
from ratetally.operators.spread import attach, cut_lineage, number_rows

FILE = ["file_id"]
LOOK_AHEAD = 14
# Rows of a file that one task judges.
SLICE_ROWS = 100_000
PLACEHOLDER = r"(?i)^col_\d+$"


def near_cells(cells: DataFrame, scan_rows: int | None) -> DataFrame:
    """All cells, or those of the first rows and of what follows them; the filter reaches the scan."""
    return cells if scan_rows is None else cells.where(F.col("row_idx") < scan_rows + LOOK_AHEAD + 1)


def row_features(cells: DataFrame) -> DataFrame:
    """One row per grid row: filled cells, data-like cells, rate ids, numbers, long cells, longest cell, header bonus."""
    s = strip(F.col("cell"))
    words = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("col_idx", F.lower(s).alias("t")))), lambda x: x["t"] != ""), lambda x: x["t"]), " ")
    f = cells.groupBy("file_id", "row_idx").agg(
        F.count_if(s != "").alias("width"), F.count_if(is_data_like(s)).alias("data_like"), F.count_if(is_rate_id(s)).alias("rate_ids"),
        F.count_if(is_number_text(s)).alias("numbers"), F.count_if(F.length(s) > 90).alias("long_cells"), F.max(F.length(s)).alias("longest"),
        words.alias("words"),
    )
    return f.withColumn("bonus", header_bonus(F.col("words")))


def detect_header(cells: DataFrame, min_cols: int = 3, scan_rows: int | None = None, fallback_rows: int | None = None) -> DataFrame:
    """(file_id, header_row, header_score): the row of each grid that is most likely its header.

    All rows are looked at, unless ``scan_rows`` says how many (``fallback_rows``: how many where no row scores).
    A row is judged with the ``LOOK_AHEAD`` rows below it; a long file is cut into slices that overlap by as
    many, so no task holds a whole file.
    """
    size = cells.groupBy(*FILE).agg((F.max("row_idx") + 1).alias("n_rows"))
    near = row_features(near_cells(cells, scan_rows)).join(size, FILE)
    own = F.floor(F.col("row_idx") / SLICE_ROWS)
    again = F.when((own > 0) & (F.col("row_idx") % SLICE_ROWS < LOOK_AHEAD), F.array(own, own - 1)).otherwise(F.array(own))
    near = near.withColumn("_own", own).withColumn("_slice", F.explode(again))
    ahead = Window.partitionBy("file_id", "_slice").orderBy("row_idx").rangeBetween(1, LOOK_AHEAD)
    top = F.slice(F.sort_array(F.collect_list("data_like").over(ahead), asc=False), 1, 2)
    near = near.withColumn("_top", top).where("_slice = _own")
    zero = F.lit(0).cast("long")
    top1 = F.coalesce(F.get("_top", F.lit(0)), zero)
    pair = top1 + F.coalesce(F.get("_top", F.lit(1)), zero)
    near = near.withColumn("pair", pair).withColumn("top1", top1)
    num = lambda c: F.col(c).cast("double")
    score = (
        num("width") * 8 + F.least(num("pair"), F.lit(18.0)) + F.col("bonus") - num("long_cells") * 0.3
        - F.least(num("data_like") * 3.8, F.lit(28.0)) - F.least(num("rate_ids") * 6, F.lit(24.0))
        - F.least(F.greatest(num("numbers") - 1, F.lit(0.0)) * 3, F.lit(18.0)) - F.when(F.col("longest") > 42, 1.5).otherwise(0.0)
    )
    signal = (F.col("pair") >= 2) | (F.col("top1") >= 3) | ((F.col("bonus") >= 14) & (F.col("top1") >= 2))
    prose = (F.col("long_cells") >= F.greatest(F.lit(1), F.expr("width DIV 2"))) & (F.col("width") <= 4)
    end = F.col("n_rows") - 2
    usable = (F.col("row_idx") < (end if scan_rows is None else F.least(end, F.lit(scan_rows)))) & (F.col("width") >= min_cols) & ~prose & signal
    scored = near.withColumn("score", F.round(score, 6))
    best = scored.where(usable & (F.col("score") >= 0)).groupBy(*FILE).agg(
        F.max(F.struct("score", (-F.col("row_idx")).alias("r"))).alias("b")
    ).select("file_id", (-F.col("b.r")).alias("header_row"), F.col("b.score").alias("header_score"))
    early = (scored if fallback_rows is None else scored.where(F.col("row_idx") < fallback_rows)).where(F.col("width") >= min_cols).groupBy(*FILE).agg(
        F.min(F.struct((-F.col("width")).alias("w"), "data_like", (-F.col("bonus")).alias("bonus"), "row_idx")).alias("b")
    ).select("file_id", F.col("b.row_idx").alias("_fallback"))
    out = size.join(best, FILE, "left").join(early, FILE, "left")
    return out.select("file_id", F.coalesce("header_row", "_fallback", F.lit(0)).cast("int").alias("header_row"), "header_score", "n_rows")


def header_band(cells: DataFrame, headers: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """``headers`` with ``band``: the row above the header is a label band that belongs to it.

    The row above must look like labels and the first filled row below like data.
    """
    h = headers.where("header_row > 0").select("file_id", "header_row", "n_rows")
    f = row_features(near_cells(cells, scan_rows)).join(h, FILE).where("row_idx >= header_row - 1 AND (row_idx <= header_row OR width > 0)")
    word = r"workforce|hcbs|rescue|rate increase"
    above, here = F.col("row_idx") == F.col("header_row") - 1, F.col("row_idx") == F.col("header_row")
    below = F.col("row_idx") > F.col("header_row")
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    g = f.groupBy(*FILE, "header_row", "n_rows").agg(
        *[pick(above, c).alias(f"p_{c}") for c in ("width", "data_like", "rate_ids", "numbers")],
        F.max(F.when(above, F.col("words").rlike(word))).alias("_marked"),
        *[pick(here, c).alias(f"q_{c}") for c in ("width", "data_like")],
        F.min(F.when(below, F.struct("row_idx", "width", "data_like"))).alias("_n"),
    )
    g = g.withColumn("n_width", F.col("_n.width")).withColumn("n_data", F.col("_n.data_like"))
    half = F.greatest(F.lit(2), F.expr("(n_width + 1) DIV 2"))
    worthy = (
        (F.col("header_row") < F.col("n_rows") - 1) & (F.col("p_width") >= 2) & (F.col("q_width") >= 3)
        & (F.col("p_rate_ids") < 2) & (F.col("p_numbers") < 3)
        & (F.col("p_data_like") < F.greatest(F.lit(4), F.expr("(p_width * 2) DIV 3")))
        & (F.col("q_data_like") < F.greatest(F.lit(4), F.col("q_width") - 1))
        & (F.col("n_width").isNull() | (F.col("n_data") >= half))
    )
    marked = (
        (F.col("p_width") >= 3) & (F.col("q_data_like") <= 2) & (F.col("q_width") >= 4) & (F.col("p_rate_ids") <= 1)
        & (F.col("p_numbers") <= 2) & (F.col("p_data_like") <= F.greatest(F.lit(3), F.expr("p_width DIV 2"))) & F.coalesce("_marked", F.lit(False))
    )
    band = g.select("file_id", F.coalesce(worthy | marked, F.lit(False)).alias("band"))
    return headers.join(band, FILE, "left").withColumn("band", F.coalesce("band", F.lit(False)))


def merge_labels(above: Column, label: Column) -> Column:
    """``above · label`` when both say something different; of two numbers or two ids the lower one."""
    p, q = strip(above), strip(label)
    same_kind = (is_number_text(p) & is_number_text(q)) | (is_rate_id(p) & is_rate_id(q))
    return (
        F.when(same_kind | (p == ""), F.when(q != "", q).otherwise(p))
        .when((q != "") & (F.lower(p) != F.lower(q)), F.concat(p, F.lit(" · "), q))
        .otherwise(p)
    )


@dataclass(frozen=True)
class Grid:
    """``columns`` (file_id, col_idx, name) and body ``cells`` (file_id, row_idx, col_idx, cell) of each file."""

    columns: DataFrame
    cells: DataFrame
    headers: DataFrame


def trimmed_width(cells: DataFrame) -> DataFrame:
    """(file_id, width) without trailing empty columns."""
    return cells.where(strip(F.col("cell")) != "").groupBy(*FILE).agg((F.max("col_idx") + 1).alias("width"))


def pad_grid(cells: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """Every row filled up to the width of its file with '' cells, cells beyond it dropped."""
    widths = trimmed_width(cells) if widths is None else widths
    rows = cells.groupBy("file_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("cell")))).alias("m"))
    full = attach(rows, widths, FILE).withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return full.select("file_id", "row_idx", "col_idx", F.coalesce(F.element_at("m", F.col("col_idx")), F.lit("")).alias("cell"))


def read_grid(
    cells: DataFrame, min_cols: int = 3, two_row_headers: bool = True, skip_notes: bool = True, repeated_headers: bool = False,
    scan_rows: int | None = None, fallback_rows: int | None = None,
) -> Grid:
    """Header and body of each grid.

    Rows above the header are left out, as are blank rows, note rows and, if asked for, repeats of the
    header. Blank header cells become ``col_N``; columns that are empty and unnamed are dropped. Cells of a
    dropped column hold no text and belong to no entry of ``columns``. The header rows (one row per file) and
    their labels are found first and stored, so that the cells are not searched again for every use of them.
    """
    heads = cut_lineage(detect_header(cells, min_cols, scan_rows, fallback_rows))
    edge = heads.select("file_id", "header_row")
    heads = header_band(cells, heads, scan_rows) if two_row_headers else heads.withColumn("band", F.lit(False))
    top = near_cells(cells, scan_rows).join(heads.select("file_id", "header_row", "band"), FILE)
    top = top.where(F.col("row_idx").between(F.col("header_row") - 1, F.col("header_row")))
    here = F.col("row_idx") == F.col("header_row")
    labels = cut_lineage(top.groupBy("file_id", "col_idx").agg(
        F.coalesce(F.max(F.when(here, strip(F.col("cell")))), F.lit("")).alias("_label"),
        F.coalesce(F.max(F.when(~here & F.col("band"), strip(F.col("cell")))), F.lit("")).alias("_above"),
    ))
    if repeated_headers:
        shown = labels.where("_label <> ''").groupBy(*FILE).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.lower("_label").alias("t")))), lambda x: F.concat_ws(" ", x["col_idx"].cast("string"), x["t"])).alias("_header")
        )
        edge = edge.join(shown, FILE, "left")

    # One shuffle by row: a grid row is as wide as its file, and even a very long file is spread over its rows.
    rows = cells.groupBy("file_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("cell")))).alias("_cells"))
    rows = attach(rows, edge, FILE).where("row_idx > header_row").where(F.exists("_cells", lambda c: strip(c["cell"]) != ""))
    if skip_notes:
        rows = rows.where(~F.exists("_cells", lambda c: (c["col_idx"] == 0) & F.lower(strip(c["cell"])).startswith("note")))
    if repeated_headers:
        filled = F.filter("_cells", lambda c: strip(c["cell"]) != "")
        said = F.transform(filled, lambda c: F.concat_ws(" ", c["col_idx"].cast("string"), F.lower(strip(c["cell"]))))
        rows = rows.where(~F.coalesce(said == F.col("_header"), F.lit(False)))
    body = rows.select("file_id", "row_idx", F.inline("_cells"))

    used = body.where(strip(F.col("cell")) != "").groupBy("file_id", "col_idx").agg(F.lit(True).alias("_used"))
    cols = labels.join(used, ["file_id", "col_idx"], "full_outer")
    name = merge_labels(F.coalesce("_above", F.lit("")), F.coalesce("_label", F.lit("")))
    name = F.when(name != "", name).otherwise(F.concat(F.lit("col_"), (F.col("col_idx") + 1).cast("string")))
    cols = cols.withColumn("name", name).where(F.coalesce("_used", F.lit(False)) | ~F.col("name").rlike(PLACEHOLDER))
    return Grid(cols.select("file_id", "col_idx", "name"), body, heads)


def wide(grid: Grid, columns: Sequence[str], file_id: str | None = None) -> DataFrame:
    """Body rows with one text column per wanted header name."""
    named = attach(grid.cells, grid.columns.where(F.col("name").isin(*columns)), ["file_id", "col_idx"])
    if file_id is not None:
        named = named.where(F.col("file_id") == file_id)
    return named.groupBy("file_id", "row_idx").pivot("name", list(columns)).agg(F.first("cell")).fillna("", list(columns))


def as_rows(grid: Grid) -> DataFrame:
    """Body rows with their cells as a MAP of header name to text."""
    named = attach(grid.cells, grid.columns, ["file_id", "col_idx"])
    named = named.groupBy("file_id", "row_idx", "name").agg(F.max(F.struct("col_idx", "cell")).alias("_c"))
    return named.groupBy("file_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("name", "_c.cell"))).alias("cells"))


def drop_placeholder_columns(df: DataFrame) -> DataFrame:
    """Wide table without columns that are empty and named ``col_N`` or nothing. One aggregation finds them."""
    import re

    suspects = [c for c in df.columns if not c.strip() or re.match(PLACEHOLDER, c.strip())]
    if not suspects:
        return df
    one = df.agg(*[F.max(strip(F.col(f"`{c}`")) != "").alias(f"_{i}") for i, c in enumerate(suspects)]).first()
    empty = {c for i, c in enumerate(suspects) if not one[f"_{i}"]}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in empty])


def percent_columns(df: DataFrame) -> DataFrame:
    """Fractions shown as percentages in the columns whose header speaks of a rate or an increase."""
    return df.select(*[percent_text(F.col(f"`{c}`")).alias(c) if is_percent_header(c) else F.col(f"`{c}`") for c in df.columns])


def skip_note_rows(df: DataFrame, first_column: str | None = None) -> DataFrame:
    """Wide table without blank rows and rows whose first cell starts with ``note``."""
    first = first_column or df.columns[0]
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (strip(F.col(f"`{c}`")) == "")
    return df.where(~blank & ~F.lower(strip(F.col(f"`{first}`"))).startswith("note"))


def merge_blocks(cells: DataFrame) -> DataFrame:
    """One grid per document from its table blocks (file_id, block_no, row_idx, col_idx, cell).

    Blank rows go, blocks need two rows and three columns. The width of the largest block rules: blocks
    whose width differs by more than one, and very small narrower ones, are dropped; the rest is cut or
    padded to it. Rows are numbered by (block_no, row_idx) without bringing a document into one task.
    """
    key = ["file_id", "block_no"]
    rows = cells.groupBy(*key, "row_idx").agg((F.max("col_idx") + 1).alias("w"), F.max(strip(F.col("cell")) != "").alias("filled")).where("filled")
    b = rows.groupBy(*key).agg(F.max("w").alias("width"), (F.sum("w") * F.max("w")).alias("area"), F.count(F.lit(1)).alias("n"))
    b = b.where("n >= 2 AND width >= 3")
    best = b.groupBy(*FILE).agg(F.max(F.struct("area", "width")).alias("m")).select("file_id", F.col("m.width").alias("main_width"), F.col("m.area").alias("main_area"))
    kept = b.join(best, FILE).where(
        ~((F.col("area") < F.expr("main_area DIV 20")) & (F.col("width") < F.col("main_width") - 1)) & (F.abs(F.col("width") - F.col("main_width")) <= 1)
    ).select(*key, "main_width")
    # Row numbers: offset of the block (few per document) plus the row's place within its block.
    alive = attach(rows.select(*key, "row_idx"), kept, key)
    sizes = alive.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    placed = attach(number_rows(alive, key, "row_idx", "_p"), offsets, key)
    numbered = placed.select(*key, "row_idx", (F.col("_off") + F.col("_p")).cast("int").alias("new_row"), "main_width")
    out = cells.join(numbered, [*key, "row_idx"]).where(F.col("col_idx") < F.col("main_width"))
    return out.select("file_id", F.col("new_row").alias("row_idx"), "col_idx", F.coalesce("cell", F.lit("")).alias("cell"))
