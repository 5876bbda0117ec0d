"""Files on disk: readers, writers, HTML."""

import hashlib

from pyspark.sql import functions as F

from ratetally.operators import compare as c, grids, pages
from ratetally.sources import files, html, sinks, tables, textfiles as tf


def test_delimited_grid_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Title of the file\n\nCode,"Rate, new",Name\n70240,"1,234.50",x y\n70241,2.00,"say ""hi"""\n70242,3.00\n')
    (tmp_path / "b.txt").write_text("Code;Rate\n70240;1,00\n70241;2,00\n")
    cells = tf.read_delimited_grid(spark, str(tmp_path))
    g = grids.read_grid(cells, min_cols=2, two_row_headers=False, skip_notes=False)
    rows = {}
    for r in grids.as_rows(g).collect():
        rows.setdefault(r["file_id"].rsplit("/", 1)[1], []).append(r["cells"])
    assert {"Code": "70240", "Rate, new": "1,234.50", "Name": "x y"} in rows["a.csv"]
    assert {"Code": "70241", "Rate, new": "2.00", "Name": 'say "hi"'} in rows["a.csv"] and len(rows["a.csv"]) == 3
    assert {"Code": "70241", "Rate": "2,00"} in rows["b.txt"]


def test_lines_of_a_file_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8KB")
    try:
        out = tf.read_numbered(spark, str(tmp_path / "big.txt"))
        assert out.rdd.getNumPartitions() >= 1
        got = [r["line"] for r in out.orderBy("line_no").collect()]
        assert [r["line_no"] for r in out.select("line_no").orderBy("line_no").collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines


def test_simple_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t\tc, d\n1\t2\t3\n4\t5\n")
    df = tf.read_delimited(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["a", "col_2", "c, d"] and sorted(map(tuple, df.collect())) == [("1", "2", "3"), ("4", "5", "")]
    (tmp_path / "t.csv").write_text('a,"b, c"\n"x, y",2\n')
    df = tf.read_delimited(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b, c"] and [tuple(r) for r in df.collect()] == [("x, y", "2")]
    (tmp_path / "t.json").write_text('[{"z": 1, "a": "x"}, {"z": 2, "q": 9}]')
    df = tf.read_json_rows(spark, str(tmp_path / "t.json"))
    assert df.columns == ["z", "a", "q"] and sorted(map(tuple, df.collect())) == [(1, "x", None), (2, None, 9)]


def test_scan_and_classify_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.xls").write_bytes(b"  <!DOCTYPE html><html></html>")
    (tmp_path / "c.csv").write_bytes(b"a,b")
    df = files.scan_files(spark, str(tmp_path)).withColumn("mime_type", F.lit(""))
    got = {r["original_filename"]: r for r in files.classify_file(df).collect()}
    assert got["a.pdf"]["content_sha256"] == hashlib.sha256(b"%PDF-1.4 x").hexdigest()
    assert [got[n]["kind"] for n in ("a.pdf", "b.xls", "c.csv")] == ["pdf", "html_masquerade", "delimited"]
    assert got["c.csv"]["error"] is None and got["a.pdf"]["bytes_size"] == 10


def test_sinks(spark, frame, tmp_path):
    df = frame([("a,b", 'say "x"', ["p", "q"])], "m string, n string, l array<string>")
    sinks.write_table(df, str(tmp_path / "out"), ["n", "m", "l"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert [x for x in text.splitlines() if x != "n,m,l"] == ['"say ""x""","a,b","[""p"",""q""]"']
    left = frame([("1", "5"), ("2", "6")], "Code string, Rate string")
    right = frame([("1", "7", 1), ("3", "8", 2)], "CODE string, FAC string, n int")
    sinks.export_compare(c.reconcile(left, right, {"Code": "CODE", "Rate": "FAC"}, right_order=["n"]), str(tmp_path / "cmp"))
    got = {b: [tuple(r) for r in spark.read.csv(str(tmp_path / "cmp" / b), header=True).collect()] for b in ("modified", "added", "right_only")}
    assert got == {"modified": [("1", "5.00")], "added": [("2", "6")], "right_only": [("3", "8")]}


def test_table_scans(spark, frame):
    frame([(1, "NY", 5), (2, "GA", 6)], "row_id int, State_Code string, x int").createOrReplaceTempView("fees_ny")
    assert tables.scan_table(spark, "fees_ny", " ny ").collect() == [(5,)]
    assert [r[0] for r in tables.list_tables(spark, "state_code", "GA").collect()] == ["fees_ny"]
    spark.catalog.dropTempView("fees_ny")


def test_html_with_a_head_section(spark, frame):
    doc = "<h2>Rates</h2><table><thead><tr><th>Code</th><th>Rate</th></tr></thead><tr><td>1</td><td>2<p>x</td></tr></table>"
    e = html.page_elements(frame([(1, "https://h/p", doc), (2, "https://h/q", None)], "page_id long, url string, html string"))
    rows = pages.html_tables(e).collect()
    assert [(r["columns"], r["cells"]) for r in rows] == [(["Code", "Rate"], {"Code": "1", "Rate": "2 x"})]


def test_quoted_cells_over_several_lines_in_slices(spark):
    import csv
    import io
    import random

    rnd = random.Random(3)
    files = {}
    for f in range(6):
        rows = [[rnd.choice(["a", "", 'say "x"', "two\nlines", "b\n\n,c\n", '"', "plain"]) for _ in range(3)] for _ in range(25)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        files[f"f{f}"] = out.getvalue().rstrip("\n") + '\n5" pipe,6" pipe,x'
    lines = spark.createDataFrame([(f, i, t) for f, text in files.items() for i, t in enumerate(text.split("\n"))], "file_id string, line_no long, line string")
    seps = spark.createDataFrame([(f, ",") for f in files], "file_id string, sep string")
    for size in (1, 3, 1000):
        got = {}
        for r in tf.joined_lines(lines, seps, size).orderBy("line_no").collect():
            got.setdefault(r["file_id"], []).append(r["line"])
        want = {f: list(csv.reader(io.StringIO(text))) for f, text in files.items()}
        assert {f: [next(csv.reader(io.StringIO(x))) if x else [] for x in g] for f, g in got.items()} == want


def test_header_with_line_breaks_in_one_piece_and_in_splits(spark, tmp_path):
    """Quoted line breaks in the header and in cells, blanks before quotes, blank lines, missing and surplus cells."""
    rows = ['\ufeff"Procedure\nCode", "Rate, in\nUSD",,Note', "", '"A\n1", "1,5" ,x,"say ""so"""', "B2,2", 'C3,3,y,n,surplus', ' "D\n\n4",,,"5"" pipe"'] + [f'E{i},"{i}\n{i}",,' for i in range(60)]
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "a.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "big" / "b.csv").write_text(rows[0] + "\nZ,9,,\n")
    want = sorted([("A\n1", "1,5", "x", 'say "so"'), ("B2", "2", "", ""), ("C3", "3", "y", "n"), ("D\n\n4", "", "", '5" pipe'), ("Z", "9", "", "")] + [(f"E{i}", f"{i}\n{i}", "", "") for i in range(60)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for whole in (None, 200):
            if whole:
                spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
            df = tf.read_delimited(spark, str(tmp_path / "big"), whole_bytes=whole)
            assert df.columns == ["Procedure\nCode", "Rate, in\nUSD", "col_3", "Note"]
            assert sorted(map(tuple, df.collect())) == want
        assert spark.read.text(str(tmp_path / "big" / "a.csv")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_that_is_never_closed_tears_no_more_than_its_lines(spark):
    texts = {"f": ["a,b", '"x\ny",1', 'c,"open', "d,2", "e,3"], "g": ["a,b", "c,1"], "h": ["a;b", "c;2"]}
    lines = spark.createDataFrame([(f, i, t) for f, rows in texts.items() for i, t in enumerate("\n".join(rows).split("\n"))], "file_id string, line_no long, line string")
    assert [tuple(r)[:3] for r in tf.torn_files(lines).collect()] == [("f", 3, 3)]
    for size in (1, 2, 1000):
        seps = tf.sniff_delimiter(lines)
        got = sorted((r["file_id"], r["line_no"], r["line"], r["torn"]) for r in tf.joined_lines(lines, seps, size).collect())
        assert got[:5] == [("f", 0, "a,b", False), ("f", 1, '"x\ny",1', False), ("f", 3, 'c,"open', True), ("f", 4, "d,2", True), ("f", 5, "e,3", True)]
    cells = {(r["file_id"], r["row_idx"], r["col_idx"]): r["cell"] for r in tf.delimited_cells(lines).collect()}
    assert cells["f", 3, 0] == "d" and cells["f", 4, 1] == "3" and cells["h", 1, 1] == "2"


def test_scan_rows_bounds_the_header_search(spark):
    head = ["Procedure Code", "Service Name", "Facility Rate"]
    rows = [["note", "", ""]] * 5 + [head] + [[f"A{i:04d}", f"service {i}", f"{i}.50"] for i in range(30)]
    cells = spark.createDataFrame([("f", r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], "file_id string, row_idx int, col_idx int, cell string")
    found = lambda **more: grids.detect_header(cells, **more).first()["header_row"]
    assert found() == found(scan_rows=20) == found(scan_rows=6) == 5
    assert found(scan_rows=3, fallback_rows=3) != 5
    rows_of = lambda **more: grids.read_grid(cells, **more).cells.count()
    assert rows_of(scan_rows=20) == rows_of() > 0


def test_pages_made_of_few_ids_are_parsed_by_several_tasks(spark):
    """A thousand supplier ids are one small piece of a file, their pages are not."""
    from checks.pages import built_pages

    built = built_pages(spark, "/root/testdata/sf0.1").select("page_id")
    places = {r[0] for r in built.select(F.spark_partition_id()).distinct().collect()}
    assert len(places) >= 4 and built.count() == 1000


def test_stored_columns_are_read_one_by_one(spark, frame):
    from ratetally.operators.spread import stored_columns

    rows = [(1, "a", None), (2, None, [1, 2])]
    stored = stored_columns(frame(rows, "k int, t string, a array<int>"))
    assert sorted(map(tuple, stored.collect())) == rows
    plan = stored.select("k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int>" in plan


def test_a_file_per_supplier_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from checks import files as queries

    monkeypatch.setattr(queries, "folder", lambda _: str(tmp_path / "out"))
    found = queries.scanned_files(spark, "/root/testdata/sf0.1")
    assert found.count() == 1000
    assert len({p.name.split("-")[1] for p in (tmp_path / "out").rglob("part-*.txt")}) >= 4


def test_plain_tags_parse_like_all_others(monkeypatch):
    pages = [
        "<table><tr><td>a<td>b</tr><TR><TD CLASS=x>c</TD ></tr></table><h2>H</h2><a href='f.pdf'>f</a><p>x</b></p>",
        "<script>var t = '<td>';</script><textarea><td>no</textarea><h1>1 < 2 <b>&lt;td></b></h1><td></td x='>'><table><tr><th>u</table><tr",
        "</td><table><thead><tr><th><table><tr><td>in</td></tr></table></th></tr></thead><!-- <td> --><tbody><tr><td><br/><td/></table></p>",
    ]
    short = [list(html._elements(1, "u", p)) for p in pages]
    called = []
    monkeypatch.setattr(html.HTMLParser, "check_for_whole_start_tag", lambda self, i: called.append(i))
    assert sum(e[3] == "cell" for e in html._elements(1, "u", "<table><tr><td>a</td><td>b</td></tr></table>")) == 2 and not called
    monkeypatch.undo()
    monkeypatch.setattr(html, "PLAIN_TAG", html.re.compile("(?!)"))
    assert short == [list(html._elements(1, "u", p)) for p in pages]


def test_lines_are_numbered_and_joined_with_one_shuffle_of_them(spark, tmp_path):
    """Numbers of lines and states of files are sent to the lines; only the slices and the records gather them."""
    for name, n in (("a", 3000), ("b", 40)):
        (tmp_path / f"{name}.csv").write_text("".join(f'{i},"two\nlines {i}"\n' if i % 3 else f"{i},one\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        lines = tf.read_numbered(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5 and shuffles(lines) == 0
        got = {(r["file_id"][-5:], r["line_no"]): r["line"] for r in lines.collect()}
        for name in ("a.csv", "b.csv"):
            want = (tmp_path / name).read_text().split("\n")[:-1]
            assert [got[name, i] for i in range(len(want))] == want
        assert len(got) == sum(len(p.read_text().split("\n")) - 1 for p in tmp_path.iterdir())
        joined = tf.joined_lines(lines, tf.sniff_delimiter(lines), rows_per_slice=500)
        assert shuffles(joined) == 1 and joined.count() == 3040 and joined.where("torn").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wanted_kinds_are_those_of_all_elements(spark):
    """A query that reads links only makes no rows of texts and cells; numbers, places and notes stay the same."""
    page = '<h2>A</h2><p>file updated 01/02/23 <a href="x.pdf">x</a></p><table><tr><th>r</th><td><b>c</b> <a href="y">y</a></td></tr></table><footer><a href="z">z</a></footer>'
    pages_df = spark.createDataFrame([(1, "http://h/", page), (2, "http://h/2", None)], "page_id long, url string, html string")
    every = html.page_elements(pages_df).collect()
    for kinds in (["anchor"], ["heading", "anchor"], ["anchor", "cell"], ["text"]):
        got = html.page_elements(pages_df, kinds).collect()
        assert got == [e for e in every if e["kind"] in kinds] and got
