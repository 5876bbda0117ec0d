"""HTML documents as rows of elements.

The only place where Python sees a document: each page becomes rows in document order, one task per
input partition. Everything built on the elements is DataFrame code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection, Iterator
from itertools import islice
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ELEMENTS_SCHEMA = (
    "page_id long, url string, pos int, kind string, tag string, href string, text string, tight string, n_texts int, "
    "table_no int, row_no int, col_no int, in_thead boolean, in_footer boolean, updated string"
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5"}
CONTROLS = {"button", "select", "input", "form", "main", "article", "ul", "ol"}
HINTS = {"strong", "legend", "caption"}
# Tags without attributes and with nothing but markup inside, as most tags of a table are.
PLAIN_TAG = re.compile(r"<(/?)(td|tr|th|b|p|table|thead|tbody|li|ul|ol|div|span|strong|h[1-6])>")
UPDATED = re.compile(r"file\s+(?:updated|update)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", re.I)


ROOT = {"tag": "", "attrs": {}, "table": None, "row": None, "cell": None, "thead": False, "footer": False, "silent": False}


class _Outline(HTMLParser):
    """Start and end positions of the tags and the positions of the text pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pos = 0
        self.open: list[dict] = []
        self.nodes: list[dict] = []
        self.text_at: list[int] = []
        self.texts: list[str] = []

    def updatepos(self, i, j):
        # Nobody asks for line numbers, which the parser would count for every piece.
        return j

    def parse_starttag(self, i):
        plain = PLAIN_TAG.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        self.lasttag = plain[2]
        self.handle_starttag(plain[2], ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_TAG.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[2])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        up = self.open[-1] if self.open else ROOT
        # What a node inherits from the tags around it, so that nothing walks up the tree later.
        node = {
            "tag": tag, "attrs": dict(attrs), "start": self.pos, "end": None, "up": up,
            "table": up if up["tag"] == "table" else up["table"],
            "row": up if up["tag"] in ("tr", "table") else up["row"],
            "cell": up if up["tag"] in ("td", "th") else up["cell"],
            "thead": up["thead"] or up["tag"] == "thead",
            "footer": up["footer"] or up["tag"] == "footer" or up["attrs"].get("role") == "contentinfo",
            "silent": up["silent"] or tag in SILENT,
        }
        self.pos += 1
        self.nodes.append(node)
        if tag in VOID:
            node["end"] = self.pos
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open and self.open[-1]["tag"] == tag:
            self.open.pop()["end"] = self.pos
        elif any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                node["end"] = self.pos
                if node["tag"] == tag:
                    break

    def handle_data(self, data):
        piece = data.strip()
        if piece and not (self.open and self.open[-1]["silent"]):
            self.text_at.append(self.pos)
            self.texts.append(piece)
            self.pos += 1

    def pieces(self, node):
        end = self.pos if node["end"] is None else node["end"]
        return self.texts[bisect_left(self.text_at, node["start"]) : bisect_left(self.text_at, end)]


def _updated_note(doc, anchor) -> str:
    """Date of the nearest "file updated" note in the five tags around a link; every tag is searched once."""
    node = anchor["up"]
    for _ in range(5):
        if node is ROOT:
            break
        if "note" not in node:
            hit = UPDATED.search(" ".join(doc.pieces(node)))
            node["note"] = hit.group(1) if hit else ""
        if node["note"]:
            return node["note"]
        node = node["up"]
    return ""


def _elements(page_id, url, html, wanted=None) -> Iterator[tuple]:
    doc = _Outline()
    doc.feed(html or "")
    doc.close()
    has_updates = UPDATED.search(" ".join(doc.texts)) is not None
    n_tables = 0
    for node in doc.nodes:
        tag, table, row = node["tag"], node["table"], node["row"]
        in_row = row is not None and "row_no" in row
        if tag == "table":
            node["table_no"], node["rows"], kind = n_tables, 0, "table"
            n_tables += 1
        elif tag == "tr" and table is not None:
            node["row_no"], node["cells"], kind = table["rows"], 0, "row"
            table["rows"] += 1
        elif tag in ("td", "th") and in_row:
            node["col_no"], kind = row["cells"], "cell"
            row["cells"] += 1
        elif tag in HEADINGS:
            kind = "heading"
        elif tag == "a":
            kind = "anchor"
        elif tag in CONTROLS:
            kind = "control"
        elif tag in HINTS:
            kind = "hint"
        else:
            continue
        if wanted is not None and kind not in wanted:
            continue
        place = node if "row_no" in node else row if in_row else None
        cell = node if "col_no" in node else node["cell"]
        pieces = doc.pieces(node) if kind not in ("table", "row", "control") else []
        yield (
            page_id, url, node["start"], kind, tag, node["attrs"].get("href"), " ".join(pieces), "".join(pieces), len(pieces),
            node["table_no"] if kind == "table" else table["table_no"] if table is not None else None,
            place["row_no"] if place is not None else None,
            cell.get("col_no") if cell is not None else None,
            node["thead"], node["footer"],
            _updated_note(doc, node) if kind == "anchor" and has_updates else "",
        )
    for at, piece in zip(doc.text_at, doc.texts) if wanted is None or "text" in wanted else ():
        yield (page_id, url, at, "text", "", None, piece, piece, 1, None, None, None, False, False, "")


# Elements that leave the parser at a time.
BATCH_ELEMENTS = 20_000


def page_elements(pages: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Elements of ``pages`` (page_id, url, html) in document order, of all kinds or of ``kinds`` only.

    Kinds: heading, anchor, table, row, cell, control, hint (strong, legend, caption) and text. ``text``
    joins the inner text pieces with a blank, ``tight`` without one. The operators on pages read the
    elements more than once, so store them (as a table or with ``cut_lineage``) before using them.
    """
    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS_SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (e for p in zip(*[c.to_pylist() for c in batch.columns]) for e in _elements(*p, kinds))
            while rows := list(islice(found, BATCH_ELEMENTS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(parse, ELEMENTS_SCHEMA)
