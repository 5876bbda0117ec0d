"""Token counts of document sections: whole texts are encoded once, and token spans are joined to sections."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULES = ("start", "end", "most")
# Sections per batch of results.
BATCH_ROWS = 50_000

_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The encoding and the byte length of every id; one per worker process."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        widths = np.zeros(max(ranks.values()) + 1, "int64")
        for word, rank in ranks.items():
            widths[rank] = len(word)
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths
    return _ENCODINGS[path, pattern]


def sections_of(raw: np.ndarray) -> np.ndarray:
    """Byte positions where the lines of a text start, and its end. A line keeps its line break."""
    starts = np.flatnonzero(raw == 10) + 1
    inner = starts[starts < len(raw)]
    return np.concatenate([[0], inner, [len(raw)]])


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])[: len(ends)].astype("int64")


def allot(bounds: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Section of every token, given section bounds and token ends, both in bytes and ascending.

    Interval join of two sorted lists. A token that crosses a bound goes to the section of its first byte
    ("start"), of its last ("end"), or to the one that holds most of it, the earlier on a tie ("most").
    """
    begins = starts_of(ends)
    first = np.searchsorted(bounds, begins, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    best, most = first.copy(), np.minimum(bounds[first + 1], ends) - begins
    step = 1
    while (more := first + step <= last).any():
        at = np.flatnonzero(more)
        sec = first[at] + step
        held = np.minimum(bounds[sec + 1], ends[at]) - bounds[sec]
        better = held > most[at]
        best[at[better]], most[at[better]] = sec[better], held[better]
        step += 1
    return best


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every document: id, section, start and length in characters, n_tokens, n_crossing.

    Every whole text is encoded once. The tokens' bytes put together are the text, so their ends are running
    sums of byte lengths; these spans are joined to the lines' spans and counted. ``rule`` allots a token that
    crosses the bound of a section, see ``allot``; n_crossing counts the allotted tokens that do. The sections'
    tokens add up to the text's tokens. A null or empty text has one empty section without tokens; strings of
    special tokens are ordinary text; repeated rows are counted each; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, widths = encoding(ranks, pattern)
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                raw = np.frombuffer(text.encode(), "uint8")
                bounds = sections_of(raw)
                ends = np.cumsum(widths[encode.encode_ordinary(text)]) if text else np.zeros(0, "int64")
                home = allot(bounds, ends, rule)
                n = len(bounds) - 1
                crossing = np.searchsorted(bounds, ends, "left") > np.searchsorted(bounds, starts_of(ends), "right")
                chars = bounds if len(raw) == len(text) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                held.append((np.full(n, i), np.arange(n), chars[:-1], np.diff(chars), np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)))
                rows += n
                if rows >= BATCH_ROWS:
                    yield gathered(batch, held)
                    held, rows = [], 0
            if held:
                yield gathered(batch, held)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["id"]
    out = narrow.mapInArrow(count, f"id {kind}, section long, start long, length long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("id", id_col)


def gathered(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]],
        names=["id", "section", "start", "length", "n_tokens", "n_crossing"],
    )
