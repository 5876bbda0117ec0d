"""Hand-written expectations for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratetally.functions import cells, dates, jsontext, names, text, urls


def test_normalisation(values):
    got = values([None, "  70240 ", "a\t b  c", ""], text.norm_text, text.norm_key)
    assert got == [("", ""), ("70240", "70240"), ("a b c", "A B C"), ("", "")]
    assert values(["ＡＢ  c", "plain"], text.norm_label) == ["ab c", "plain"]
    assert values(["It''s &amp; ‘x’"], text.norm_catalog_value) == ["it's & 'x'"]


def test_loose_and_strict_numbers(values):
    got = values(["$1,234.50", "(5.00)", "J1234", "5.", "-.5", "1-2", "-", "", None, "-.0"], cells.loose_decimal)
    assert [None if v is None else float(v) for v in got] == [1234.5, 5.0, 1234.0, 5.0, -0.5, None, None, None, None, None]
    got = values(["$1,234.50", "(5.00)", "J1234", "1,23", "01/02/2024", " 7 "], cells.strict_decimal)
    assert [None if v is None else float(v) for v in got] == [1234.5, -5.0, None, None, None, 7.0]


@pytest.mark.parametrize(
    "left,right,money,mode,same,shown",
    [
        ("100.126", "100.13", True, "loose", True, ("100.13", "100.13")),
        ("100.125", "100.12", True, "loose", False, ("100.13", "100.12")),
        ("100.126", "100.13", False, "loose", True, ("100.126", "100.13")),
        ("1.006", "1.0", False, "loose", False, ("1.006", "1.0")),
        ("J1234", "K1234", False, "loose", True, ("J1234", "K1234")),
        ("J1234", "K1234", False, "strict", False, ("J1234", "K1234")),
        (None, "", False, "loose", True, ("", "")),
        (None, "x", True, "loose", False, ("", "x")),
        (" a  b", "a b", True, "loose", True, ("a b", "a b")),
        ("-100.125", "-100.13", True, "loose", True, ("-100.13", "-100.13")),
    ],
)
def test_cell_comparison(frame, left, right, money, mode, same, shown):
    r = frame([(left, right)], "l string, r string").select(cells.compare_cells(F.col("l"), F.col("r"), money, mode).alias("c")).first()["c"]
    assert (r["same"], (r["left_value"], r["right_value"])) == (same, shown)


def test_money_names():
    yes = ["facility rate", "facility_rate", "NFC", "Reimbursement", "non-fac", "Allow", "Unit Cost"]
    no = ["unit_fee", "allowed", "Procedure Code", "Effective Date", "Fee Descr", "modifier", "", "Charge"]
    assert [names.is_money_name(n) for n in yes] == [True] * len(yes)
    assert [names.is_money_name(n) for n in no] == [False] * len(no)
    assert names.is_money_name("Charge", "preview") and not names.is_money_name("year cost", "preview")
    assert names.is_money_pair("Code", "rate")


def test_metadata_helpers():
    m = names.parse_mapping('{" Code ": "CODE", "M": "mod 2", "": "x", "Rate": "FAC"}')
    assert m == {"Code": "CODE", "M": "mod 2", "Rate": "FAC"}
    assert names.parse_mapping("[1]") == {} and names.parse_mapping("nope") == {} and names.parse_mapping(None) == {}
    assert names.left_for_right(m, "code") == "Code"
    assert names.pick_modifier(m, ["code", "Mod 2", "fac"]) == ("M", "Mod 2")
    assert names.mapped_pairs(m, ["code", "Mod 2", "fac"]) == [("Code", "code"), ("M", "Mod 2"), ("Rate", "fac")]
    with pytest.raises(ValueError, match="FAC"):
        names.mapped_pairs(m, ["code", "mod 2"])
    assert names.resolve_column(["ﬁle"], "FILE") == "ﬁle"
    with pytest.raises(ValueError):
        names.validate_table_name("x; drop")


def test_display(spark):
    r = spark.sql("SELECT 100 AS i, cast(100 AS decimal(10,0)) AS d0, cast(12.500 AS decimal(10,3)) AS d3, double('NaN') AS f, true AS b, date'2024-01-05' AS d, cast(null AS string) AS n")
    m = r.select(cells.display_row(r).alias("m")).first()["m"]
    assert m == {"i": "100", "d0": "100", "d3": "12.5", "f": "", "b": "true", "d": "2024-01-05", "n": ""}


def test_percent_text(values):
    assert values(["0.101", "1.0", "0.1", "2.5", "x", "1", "0.0"], cells.percent_text) == ["10.1%", "100%", "10%", "2.5", "x", "1", ""]


def test_natural_sort(values):
    items = ["item 10", "Item 2", "item 1", "a", "item 002", "item 123456789012345678901234567890"]
    keys = dict(zip(items, values(items, text.natural_key)))
    assert sorted(items, key=keys.get) == ["a", "item 1", "Item 2", "item 002", "item 10", "item 123456789012345678901234567890"]


def test_titles(values, frame):
    assert values(["mh sa and crna fees", "the in-home care of", "a b"], text.title_case) == ["MH SA and CRNA Fees", "The IN-Home Care OF", "A B"]
    rows = [
        (1, "here", "mh_sa", "x.pdf", True), (5, "Download", "mh_sa", "x.pdf", True), (2, "Dental Rates 2024", "dental", "x.pdf", False), (3, None, " ", "a/b/My_file.v2.pdf", True),
        (4, None, None, "abcdefabcdefabcdefabcdef.pdf", True),
    ]
    df = frame(rows, "i int, l string, k string, f string, c boolean")
    got = [r[0] for r in df.orderBy("i").select(text.artifact_title(*[F.col(c) for c in "ilkfc"])).collect()]
    assert got == ["MH SA", "Dental Rates 2024 · prior", "MY File.v2", "Fee schedule (4)", "Download"]


def test_slug_and_email(values):
    assert values([" Dental / Rates (2024)! ", "", "..."], text.slug) == ["dental_rates_2024", "fee_schedule", "fee_schedule"]
    assert values([" A@B.org ", "none"], text.norm_email) == ["a@b.org", None]


def test_portal_dates(values):
    cases = {
        "2024-01-05": "2024-01-05", "01-05-2024 10:00": "2024-01-05", "01/05/2024": "2024-01-05", "01/05/69": "1969-01-05", "01/05/68": "2068-01-05",
        "2024/01/05": "2024-01-05", "25-12-2023": "2023-12-25", "1/5/2024": None, "see 2024-13-45": "2024-13-45", "January 5, 2026": "2026-01-05",
        "Sept 5 2026": "2026-09-05", "Feb 30, 2024": None, "": None,
    }
    assert values(list(cases), dates.portal_date) == list(cases.values())


def test_label_dates(values):
    cases = {
        "Order Effective January 1, 2026": "2026-01-01", "effective 4/1/2025": "2025-04-01", "Effective 25/12/24": "2024-12-25", "Effective 1/2/70": "1970-01-02",
        "x 2024-02-03": "2024-02-03", "Effective Foo 1, 2024 2024-01-01": None, "none": None,
    }
    assert values(list(cases), dates.label_date) == list(cases.values())


def test_hint_and_cell_dates(values):
    d = dt.date
    assert values(["2024-02-30", "1/5/2024", "1-5-2024 7:00", "25-12-2024", "2024/1/5", "as of 2024-01-05", "x"], dates.hint_date) == [
        None, d(2024, 1, 5), d(2024, 1, 5), d(2024, 12, 25), d(2024, 1, 5), d(2024, 1, 5), None,
    ]
    assert values(["2024-02-30", "1/5/24", "1/5/70", "Jan 5, 2024", "1800-01-01", "13/1/2024"], dates.cell_date) == [
        d(2024, 3, 1), d(2024, 1, 5), d(2070, 1, 5), d(2024, 1, 5), None, None,
    ]
    assert values(["Sun, 06 Nov 1994 08:49:37 GMT", "nope"], dates.http_date) == [dt.datetime(1994, 11, 6, 8, 49, 37), None]
    assert values(["2026-01-05", "bad"], dates.date_heading) == ["Jan 5, 2026", "bad"]


def test_urls(values, frame):
    cases = {
        "HTTPS://Ex.Com/A/?b=2&a=1#f": "https://ex.com/A?a=1&b=2", "http://x.org/p;v=1?q=a%20b": "http://x.org/p?q=a+b", "//x.org/y/": "https://x.org/y", "": "",
        "http://x.org?b&a=": "http://x.org?a=&b=",
    }
    assert values(list(cases), urls.normalize_url) == list(cases.values())
    pairs = [
        ("https://h/a/b.html", "c.pdf", "https://h/a/c.pdf"), ("https://h/a/b.html", "../c.pdf", "https://h/c.pdf"), ("https://h/a/b.html", "/c.pdf?x=1", "https://h/c.pdf?x=1"),
        ("https://h/a/b.html", "//o/c", "https://o/c"), ("https://h/a/b.html", "mailto:x@y", "mailto:x@y"), ("https://h", "c", "https://h/c"), ("https://h/a?x=1", "?y=2", "https://h/a?y=2"),
        ("https://h/a/b/", "./../../../z/./q", "https://h/z/q"),
    ]
    df = frame(pairs, "b string, h string, want string").select("want", urls.join_url(F.col("b"), F.col("h")).alias("got"))
    for r in df.collect():
        assert r["got"] == r["want"]
    assert values(["https://h/a.PDF", "https://h/x/sys_attachment.do?id=1", "https://h/a.html", "ftp://h/a.pdf", "https://h/e?format=pdf"], urls.is_file_url) == [True, True, False, False, True]


def test_file_names(values):
    assert values(["a.xlsx", ".hidden", "a.b.toolongext", "", "x.tar.gz"], urls.stem) == ["a", ".hidden", "a.b.toolongext", "download", "x.tar"]
    assert values(["a/b: c?.pdf", "  x__y .xlsx"], urls.safe_stem) == ["b_ c", "x_y"]
    assert values(["0123456789abcdef0123456789abcdef", "rates"], urls.is_opaque_name) == [True, False]


def test_json_cells(values):
    cases = {
        '{"a": {"FROM": {"FROM": 5}}, "b": [1]}': {"a": "5", "b": "[1]"}, '{""a"": ""x""}': {"a": "x"}, '"{\\"a\\": 1}"': {"a": "1"}, 'junk {x {"a": 2} tail }': {"a": "2"},
        "﻿ {\"a\": null}": {"a": None}, "[1]": None, "plain": None, "": None, '{"a": {"TO": 1}}': {"a": '{"TO":1}'},
    }
    assert values(list(cases), lambda c: jsontext.flatten_json(jsontext.parse_json_cell(c))) == list(cases.values())


def test_record_text(values):
    assert values(['{"display_value": "A", "value": "b"}', '{"value": "b"}', " plain ", None], jsontext.record_text) == ["A", "b", "plain", ""]


def test_effective_hint(frame):
    df = frame([({"EFFECT_X": "long long text", "Eff Date": "2024"},), ({"Start Date": "1", "BEGIN_DATE": "12"},), ({"a": "1"},)], "m map<string,string>")
    assert [r[0] for r in df.select(cells.effective_hint(F.col("m"))).collect()] == ["2024", "12", ""]


def test_a_map_makes_its_entries_once(spark, values):
    from ratetally.functions.jsontext import distinct_map

    entries = lambda v: F.transform(F.split(v, ","), lambda e: F.struct(F.substring(e, 1, 1).alias("key"), F.upper(e).alias("value")))
    got = values(["a1,b1,a2", "", None], lambda v: distinct_map(entries(v)))
    assert got == [{"a": "A2", "b": "B1"}, {"": ""}, None] and list(got[0]) == ["a", "b"]
    plan = spark.createDataFrame([("a",)], "v string").select(distinct_map(entries(F.col("v"))).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(") == 1
