"""Dates written in free text: portal cells, link texts, hints, headers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratetally.functions.text import strip, text

MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
# Fixed value: month names as they are accepted before a day and a year.
MONTH_NAME = (
    r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
# A column whose name holds one of these may carry the portal date.
DATE_COLUMN_HINT = r"date|effective|posted|updated|revised|modified|published|created|release|revision"
ISO = r"(\d{4}-\d{2}-\d{2})"
CLOCK = r"(?:\s+(?:[01]?\d|2[0-3]):[0-5]?\d(?::(?:[0-5]?\d|6[01]))?)?"


def ymd(year: Column, month: Column, day: Column) -> Column:
    """DATE from integers or digit strings; null when there is no such day."""
    parts = [F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")]
    return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")


def found(s: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null (not '') when there is no match."""
    hit = F.regexp_extract(s, pattern, group)
    return F.when(hit != "", hit)


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.element_at(table, F.lower(F.substring(strip(name), 1, 3)))


def expand_year(two_digits: Column, pivot: int) -> Column:
    """Years below ``pivot`` belong to this century, the others to the last one."""
    n = two_digits.cast("int")
    return F.when(n < pivot, n + 2000).otherwise(n + 1900)


def portal_date(cell: Column) -> Column:
    """``YYYY-MM-DD`` text of a catalog cell, or null.

    Tries Y-m-d, m-d-Y, m/d/Y, m/d/y, Y/m/d and d-m-Y at the start of the cell (a time of day may
    follow), then an ISO day anywhere, then ``January 5, 2026``.
    """
    raw = strip(cell)
    s = raw

    def at_start(pattern, y, m, d):
        p = "^" + pattern
        return ymd(found(s, p, y), found(s, p, m), found(s, p, d)).cast("string")

    two_digit = r"^(\d{2})/(\d{2})/(\d{2})"
    named = rf"(?i)\b({MONTH_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    return F.coalesce(
        at_start(r"(\d{4})-(\d{2})-(\d{2})", 1, 2, 3),
        at_start(r"(\d{2})-(\d{2})-(\d{4})", 3, 1, 2),
        at_start(r"(\d{2})/(\d{2})/(\d{4})", 3, 1, 2),
        ymd(expand_year(found(s, two_digit, 3), 69), found(s, two_digit, 1), found(s, two_digit, 2)).cast("string"),
        at_start(r"(\d{4})/(\d{2})/(\d{2})", 1, 2, 3),
        at_start(r"(\d{2})-(\d{2})-(\d{4})", 3, 2, 1),
        found(raw, ISO),
        ymd(found(raw, named, 3), month_number(found(raw, named, 1)), found(raw, named, 2)).cast("string"),
    )


def row_portal_date(cells: Column, columns: Column) -> Column:
    """First date found in the date-like columns of a MAP row, in column order."""
    hinted = F.filter(columns, lambda c: F.lower(c).rlike(DATE_COLUMN_HINT))
    dates = F.transform(hinted, lambda c: portal_date(F.element_at(cells, c)))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def label_date(link_text: Column) -> Column:
    """``YYYY-MM-DD`` text of an effective date inside a link text, or null."""
    s = strip(link_text)
    named = r"(?i)Effective\s+([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})"
    slashed = r"(?i)Effective\s+(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year_text = found(s, slashed, 3)
    year = F.when(F.length(year_text) == 4, year_text.cast("int")).otherwise(expand_year(year_text, 70))
    first, second = found(s, slashed, 1), found(s, slashed, 2)
    by_name = ymd(found(s, named, 3), month_number(found(s, named, 1)), found(s, named, 2)).cast("string")
    return F.when(s.rlike(named), by_name).otherwise(
        F.coalesce(
            ymd(year, first, second).cast("string"),
            ymd(year, second, first).cast("string"),
            found(s, ISO),
        )
    )


def hint_date(c: Column) -> Column:
    """DATE of an effective-date hint. A cell that starts like an ISO day is read as one or not at all."""
    s = strip(c)
    t = s

    def whole(pattern, y, m, d, clock=CLOCK):
        p = "^" + pattern + clock + "$"
        return ymd(found(t, p, y), found(t, p, m), found(t, p, d))

    iso = found(s, ISO)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")).otherwise(
        F.coalesce(
            whole(r"(\d{1,2})-(\d{1,2})-(\d{4})", 3, 1, 2),
            whole(r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2),
            whole(r"(\d{1,2})-(\d{1,2})-(\d{4})", 3, 2, 1, clock=""),
            whole(r"(\d{4})/(\d{1,2})/(\d{1,2})", 1, 2, 3, clock=""),
            F.try_to_date(iso, "yyyy-MM-dd"),
        )
    )


def cell_date(c: Column) -> Column:
    """DATE of a warehouse cell: ISO prefix, m/d/y (two-digit years are 20xx), or a spelled-out date.

    A day past the end of its month runs into the next month.
    """
    s = strip(c)
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    mdy = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"

    def rolled(y, m, d, lowest, highest):
        ok = y.between(lowest, highest) & m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.date_add(ymd(y, m, F.lit(1)), d - 1))

    y, m, d = (found(s, iso, i).cast("int") for i in (1, 2, 3))
    m2, d2, y2 = (found(s, mdy, i).cast("int") for i in (1, 2, 3))
    y2 = F.when(y2 < 100, y2 + 2000).otherwise(y2)
    free = [F.try_to_date(s, f) for f in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/M/d")]
    return F.coalesce(rolled(y, m, d, 1900, 2100), rolled(y2, m2, d2, 1900, 9999), *free)


def us_date(d: Column) -> Column:
    return F.date_format(d, "MM/dd/yyyy")


def date_heading(iso_text: Column) -> Column:
    """``Jan 5, 2026`` for an ISO day; text that is not one is returned as it is."""
    day = F.substring(strip(iso_text), 1, 10)
    return F.coalesce(F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "MMM d, yyyy"), day)


def http_date(c: Column) -> Column:
    """TIMESTAMP_NTZ in UTC of an HTTP date header; the weekday is not checked."""
    p = r"(?i)^(?:[a-z]+,\s*)?(\d{1,2})[ -]([a-z]{3})[ -](\d{4})\s+(\d{2}:\d{2}:\d{2})\s*(?:GMT|UTC|UT|\+0000)?$"
    s = strip(c)
    day = ymd(found(s, p, 3), month_number(found(s, p, 2)), found(s, p, 1))
    stamp = F.concat_ws(" ", day.cast("string"), found(s, p, 4))
    return F.when(day.isNotNull(), stamp.try_cast("timestamp_ntz"))


def in_year_tail(d: Column, day: Column) -> Column:
    """True from ``day`` to the end of its calendar year."""
    return F.coalesce(d.between(day, F.make_date(F.year(day), F.lit(12), F.lit(31))), F.lit(False))
