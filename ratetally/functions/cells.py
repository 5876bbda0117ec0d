"""Cell parsing, comparison, display and shape tests as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from ratetally.functions.names import is_money_pair
from ratetally.functions.text import bind, norm_text, strip, text

NUMBER = "decimal(37,10)"


def loose_decimal(c: Column) -> Column:
    """Number left after dropping every character but digits, ``.`` and ``-``; null if none is left."""
    kept = F.regexp_replace(text(c), r"[^\d.\-]", "")
    return F.when(kept != "-.0", kept.try_cast(NUMBER))


def strict_decimal(c: Column) -> Column:
    """Number when the whole cell is one: optional sign or brackets, ``$``, thousands commas."""
    s = F.regexp_replace(norm_text(c), r"[$\s]", "")
    shape = r"^\(?-?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?\)?$"
    negative = s.rlike(r"^\(.*\)$")
    value = F.regexp_replace(s, r"[(),]", "").try_cast(NUMBER)
    return F.when(s.rlike(shape) & s.rlike(r"\d"), F.when(negative, -value).otherwise(value).cast(NUMBER))


def is_exact_number(data_type: T.DataType | None) -> bool:
    """Types whose values are numbers as they stand."""
    return isinstance(data_type, T.IntegralType) or (isinstance(data_type, T.DecimalType) and data_type.scale <= 10)


def compare_cells(
    left: Column, right: Column, money: bool, numeric_mode: str = "loose",
    left_type: T.DataType | None = None, right_type: T.DataType | None = None,
) -> Column:
    """Struct (same, left_value, right_value).

    Equal normalised text is equal. Otherwise both cells must hold numbers: money is rounded half up to
    cents and compared, any other pair may differ by at most 0.005. Cells of a known numeric type need no
    parsing.
    """
    parse = loose_decimal if numeric_mode == "loose" else strict_decimal
    lt, rt = norm_text(left, left_type), norm_text(right, right_type)
    ln = left.try_cast(NUMBER) if is_exact_number(left_type) else parse(lt)
    rn = right.try_cast(NUMBER) if is_exact_number(right_type) else parse(rt)
    both = ln.isNotNull() & rn.isNotNull()
    if money:
        lc, rc = F.round(ln, 2), F.round(rn, 2)
        same = F.when(lt == rt, True).when(both, lc == rc).otherwise(False)
        show_l = F.when((lt != rt) & both, lc.cast("string")).otherwise(lt)
        show_r = F.when((lt != rt) & both, rc.cast("string")).otherwise(rt)
    else:
        same = F.when(lt == rt, True).when(both, F.abs(ln - rn) <= F.lit("0.005").cast("decimal(4,3)")).otherwise(False)
        show_l, show_r = lt, rt
    return F.struct(same.alias("same"), show_l.alias("left_value"), show_r.alias("right_value"))


def comparisons(
    pairs: Sequence[tuple[str, str]], left, right, numeric_mode: str = "loose", profile: str = "compare",
    left_type=lambda c: None, right_type=lambda c: None,
) -> list[Column]:
    """One ``compare_cells`` struct per mapped pair. ``left`` and ``right`` map a column name to its Column."""
    return [
        compare_cells(left(l), right(r), is_money_pair(l, r, profile), numeric_mode, left_type(l), right_type(r)) for l, r in pairs
    ]


def field_diffs(pairs: Sequence[tuple[str, str]], compared: Sequence[Column]) -> Column:
    """Array with one struct per mapped pair: names, shown values, and whether they are the same."""
    items = [
        F.struct(
            F.lit(l).alias("left_column"), F.lit(r).alias("right_column"), c["left_value"].alias("left_value"),
            c["right_value"].alias("right_value"), c["same"].alias("same"),
        )
        for (l, r), c in zip(pairs, compared)
    ]
    return F.array(*items)


def display(c: Column, data_type: T.DataType) -> Column:
    """Text shown for a typed value: null and NaN are empty, trailing decimal zeros go, dates are ISO."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        shown = F.when(~F.isnan(c), c.cast("string"))
    elif isinstance(data_type, T.DecimalType) and data_type.scale > 0:
        shown = F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(data_type, T.StringType):
        shown = strip(c)
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        shown = F.to_json(c)
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))


def display_row(df, columns: Sequence[str] | None = None) -> Column:
    """MAP of column name to displayed text for the given columns of ``df``."""
    names = list(columns or df.columns)
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[display(F.col(f"`{n}`"), df.schema[n].dataType) for n in names]),
    )


def is_percent_header(name: str) -> bool:
    import re

    t = (name or "").lower()
    return "%" in t or bool(re.search(r"\brate\b", t)) or " inc" in t or t.endswith(" inc.") or t.rstrip(".") == "inc"


def percent_text(c: Column) -> Column:
    """Fractions between 0 and 1 as a percentage (0.101 gives ``10.1%``), zero as '', others unchanged."""
    n = strip(c).try_cast("double")
    pct = F.call_function("format_number", F.round(n * 100, 6), F.lit("0.######"))
    return (
        F.when(strip(c).contains(".") & (F.abs(n) < 1e-12), F.lit(""))
        .when(strip(c).contains(".") & n.between(-0.0001, 1.001), F.concat(pct, F.lit("%")))
        .otherwise(text(c))
    )


# Cell shapes used to tell data rows from header rows.
MONEY_SHAPE = r"^\s*\$?\s*[\d,]+\.\d{1,4}\s*$"
FRACTION_SHAPE = r"^-?\d+\.\d{2,}$"
RATE_ID_SHAPE = r"^\d{4,6}[A-Z][A-Za-z0-9-]*$"
CODE_SHAPE = r"^\d{4,8}$"
SHORT_WORD_SHAPE = r"^[A-Za-z]{1,4}$"
SHORT_NUMBER_SHAPE = r"^\d{1,3}$"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def is_number_text(c: Column) -> Column:
    return F.replace(strip(c), F.lit(","), F.lit("")).rlike(NUMBER_SHAPE)


def is_rate_id(c: Column) -> Column:
    return strip(c).rlike(RATE_ID_SHAPE)


def is_data_like(c: Column) -> Column:
    s = strip(c)
    return (
        s.rlike(MONEY_SHAPE)
        | F.replace(s, F.lit(","), F.lit("")).rlike(FRACTION_SHAPE)
        | s.rlike(RATE_ID_SHAPE)
        | s.rlike(CODE_SHAPE)
        | s.rlike(SHORT_WORD_SHAPE)
        | s.rlike(SHORT_NUMBER_SHAPE)
    )


def cell_shape(c: Column) -> Column:
    """Name of the first shape a cell has: blank, money, rate_id, code, short_number, number, short_word, text."""
    s = strip(c)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(MONEY_SHAPE), "money")
        .when(s.rlike(RATE_ID_SHAPE), "rate_id")
        .when(s.rlike(CODE_SHAPE), "code")
        .when(s.rlike(SHORT_NUMBER_SHAPE), "short_number")
        .when(is_number_text(s), "number")
        .when(s.rlike(SHORT_WORD_SHAPE), "short_word")
        .otherwise("text")
    )


# Words of a header row and what each adds to its score.
HEADER_WORD_SCORES = [
    (r"\bprogram\b", 22.0),
    (r"workforce|recruitment|retention", 14.0),
    (r"hcbs|resc|american rescue", 14.0),
    (r"rate.*inc|inc.*rate|effective|eff\. date", 10.0),
    (r"fee.*schedule|schedule.*fee", 6.0),
    (r"\brate\s+code\b|downstate.*count|count.*downstate", 14.0),
    (r"regional rate|provider-specific|community residence", 8.0),
    (r"^(?=.{13,}).*\bcount(y|ies)\b", 6.0),
]


def header_bonus(row_text: Column) -> Column:
    """Score of header words in the lower-cased, blank-joined text of a row."""
    total = F.lit(0.0)
    for pattern, points in HEADER_WORD_SCORES:
        total = total + F.when(row_text.rlike("(?s)" + pattern), points).otherwise(0.0)
    return total


def effective_hint(cells: Column) -> Column:
    """Value of the best named effective-date cell of a MAP row; the longer text wins a tie."""
    # Name pattern and score, best first.
    scores = [
        (r"^(EFFECTIVE_?DATE|EFF_?DATE)$", 120),
        (r"EFFECTIVE.?DATE", 110),
        (r"BEGIN_?DATE|START_?DATE", 85),
        (r"EFFDATE", 75),
        (r"EFFECT", 35),
    ]

    def score(entry, i):
        name = F.regexp_replace(F.upper(strip(entry["key"])), r"\s+", "_")
        points = F.lit(0)
        for pattern, n in reversed(scores):
            points = F.when(name.rlike(pattern), F.lit(n)).otherwise(points)
        value = strip(entry["value"])
        return F.struct(points.alias("points"), F.length(value).alias("len"), (-i).alias("rank"), value.alias("value"))

    hits = F.filter(F.transform(F.map_entries(cells), score), lambda h: (h["points"] > 0) & (h["len"] > 0))
    return F.coalesce(F.array_max(hits)["value"], F.lit(""))
