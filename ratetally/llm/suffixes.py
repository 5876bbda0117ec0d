"""Suffix-array deduplication: the transform of a collection grows by one symbol of every string a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import stored, text_or_empty
from ratetally.llm.words import mixed

# Bytes of text whose places are sought at a time, and that the places of one task stand for.
CHUNK_BYTES = 2 << 20
PLACES_BYTES = 32 << 20
# Bytes of text that the strings of one task stand for, and strings in one collection.
STRINGS_BYTES = 16 << 20
COLLECTION = 8_192
# Different strings around one anchor beyond which they are cut, and into how many.
CROWD = 4_096
CUTS = 8
LAST_ID = np.iinfo("int64").max
LOW = np.uint64((1 << 24) - 1)


def fixed(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = fixed(256, 1)
FACTORS = fixed(40, 2) | np.uint64(1)


def gram_of(window: int) -> int:
    """Bytes of an anchor: a power of two, at most a third of a window."""
    return 1 << max(0, (window // 3).bit_length() - 1)


def hashed(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes, a power of two, from every position."""
    out, n, level = BYTE[data], 1, 0
    while n < size:
        out = out[:-n] * FACTORS[level] + out[n:] if len(out) > n else out[:0]
        n, level = 2 * n, level + 1
    return out


def record(window: int) -> np.dtype:
    """A run of windows: its start, number of windows, place of the anchor in the first of them, and a flag."""
    small = "u1" if 2 * window <= 255 else "<u2"
    return np.dtype([("start", "<u4"), ("n", small), ("at", small), ("flag", "u1")])


def runs(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor's place, anchor hash, string hash) of the runs of windows with one anchor.

    The anchor of a window is its gram of the smallest hash, the first of equals: equal windows have equal anchors at
    equal places. The string of a run is what its windows cover. No window crosses one of the ``ends`` of segments.
    """
    gram, n = gram_of(window), len(data) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in ("int64", "int64", "int64", "uint64", "uint64"))
    grams = mixed(hashed(data, gram))
    least = (grams & ~LOW) | np.arange(len(grams), dtype="uint64")
    width, reach = window - gram + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    start = np.flatnonzero(segment[:n] == segment[window - 1 :])
    at = (least[start] & LOW).astype("int64")
    head = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(start) != 1))) if len(start) else start
    windows = np.diff(np.append(head, len(start)))
    start, at = start[head], at[head]
    block = 2 * gram
    wide, last = hashed(data, block), start + windows + window - 1 - block
    string = windows.astype("uint64")
    for k in range(-(-(2 * window - gram) // block)):
        string = mixed(string * FACTORS[-1] + wide[np.minimum(start + k * block, last)])
    return start, windows, at - start, grams[at], string


def binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive parts of ``data``, of so many elements each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int64") * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def elements(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all binary values, and how many each value holds."""
    values = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(v or b"" for v in values), dtype), np.array([len(v or b"") // size for v in values], "int64")


def chunked(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of segments, row and offset of every segment); long texts are cut, with overlaps, at fixed places."""
    held, rows, offsets, total = [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        raw = np.frombuffer(text.as_buffer(), "uint8") if len(text.as_buffer()) else np.zeros(0, "uint8")
        for at in range(0, max(0, len(raw) - window + 1), CHUNK_BYTES):
            held.append(raw[at : at + CHUNK_BYTES + window - 1])
            rows.append(row)
            offsets.append(at)
            total += len(held[-1])
            if total >= CHUNK_BYTES:
                yield np.concatenate(held), np.cumsum([len(h) for h in held]), np.array(rows), np.array(offsets)
                held, rows, offsets, total = [], [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([len(h) for h in held]), np.array(rows), np.array(offsets)


def ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Place of every (id, tie) among the different ones."""
    order = np.lexsort((ties, ids))
    new = (np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)
    out = np.zeros(len(ids), "int64")
    out[order] = np.concatenate([[0], np.cumsum(new)])[: len(ids)]
    return out


def by_document(ids: np.ndarray, ties: np.ndarray, entries: np.ndarray, name: str) -> pa.Table:
    """One row per document with its entries."""
    order = np.lexsort((ties, ids))
    ids, ties = ids[order], ties[order]
    head = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(ties) != 0))) if len(ids) else order
    return pa.table({"id": pa.array(ids[head]), "tie": pa.array(ties[head]), name: binary(entries[order], np.diff(np.append(head, len(ids))))})


PLACES = "bucket long, settled boolean, docs binary, anchor binary, string binary, doc binary, entry binary"


def places(batch: pa.RecordBatch, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What the texts of a batch send: of every string around an anchor the first place, filed by the anchor.

    Strings that occur again in the chunk are settled: their later places cannot be first.
    """
    ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
    for data, ends, rows, offsets in chunked(batch, window):
        start, n, at, anchor, string = runs(data, ends, window)
        if not len(start):
            continue
        segment = np.searchsorted(ends, start, "right")
        row = rows[segment]
        entry = np.zeros(len(start), record(window))
        entry["start"] = start - np.append(0, ends)[segment] + offsets[segment]
        entry["n"], entry["at"] = n, at
        place = (ranks(ids[rows], ties[rows])[segment] << 32) | entry["start"].astype("int64")
        order = np.lexsort((place, string, anchor))
        new = np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(string[order]) != 0))
        many = np.diff(np.append(np.flatnonzero(new), len(order)))
        first, later = order[new], order[place[order] > np.repeat(place[order[new]], many)]
        entry["flag"][first] = many > 1
        bucket = (anchor[first] % np.uint64(buckets)).astype("int64")
        first, bucket = (x[np.argsort(bucket, kind="stable")] for x in (first, bucket))
        head = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        counts = np.diff(np.append(head, len(bucket)))
        used, local = np.unique(bucket * len(ids) + row[first], return_inverse=True)
        begin = np.searchsorted(used, bucket[head] * len(ids))
        local = local - np.repeat(begin, counts)
        docs = np.stack([ids[used % len(ids)], ties[used % len(ids)]], 1).ravel()
        columns = [
            pa.array(bucket[head]), pa.array(np.zeros(len(head), bool)), binary(docs, 2 * np.diff(np.append(begin, len(used)))), binary(anchor[first], counts),
            binary(string[first], counts), binary(local.astype("<u4"), counts), binary(entry[first], counts),
        ]
        if len(later):
            entry["flag"][later] = 0
            done = by_document(ids[row[later]], ties[row[later]], entry[later], "entry")
            rest = done.num_rows
            none = pa.array([b""] * rest, pa.binary())
            pairs = np.stack([done["id"].to_numpy(), done["tie"].to_numpy()], 1).ravel()
            more = [pa.array((done["id"].to_numpy() ^ done["tie"].to_numpy()) % buckets), pa.array(np.ones(rest, bool)), binary(pairs, np.full(rest, 2)), none, none, none, done["entry"].combine_chunks()]
            columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, more)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PLACES.split(", ")])


def settle(table: pa.Table, window: int) -> pa.Table:
    """What this bucket decides: flag 0 for the later places of a string, 1 for a first place among other strings, 2 in a crowd.

    A string that alone has its anchor is compared with nothing; its first place is not sent back and stays.
    """
    kind = record(window)
    done = table["settled"].to_numpy()
    old, new = table.filter(pa.array(done)), table.filter(pa.array(~done))
    pairs, _ = elements(old["docs"], "<i8")
    pairs = pairs.reshape(-1, 2)
    parts = [pa.table({"id": pa.array(pairs[:, 0]), "tie": pa.array(pairs[:, 1]), "entry": old["entry"].combine_chunks()})]
    if new.num_rows:
        docs, many = elements(new["docs"], "<i8")
        docs = docs.reshape(-1, 2)
        (anchor, counts), (string, _), (local, _), (entry, _) = (elements(new[c], t) for c, t in (("anchor", "<u8"), ("string", "<u8"), ("doc", "<u4"), ("entry", kind)))
        begin = np.cumsum(many // 2) - many // 2
        doc = local + np.repeat(begin, counts)
        place = (ranks(docs[:, 0], docs[:, 1])[doc] << 32) | entry["start"].astype("int64")
        order = np.lexsort((place, string, anchor))
        anchor, string, doc, entry = anchor[order], string[order], doc[order], entry[order].copy()
        fresh = np.append(True, np.diff(anchor) != 0)
        first = fresh | np.append(True, np.diff(string) != 0)
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(anchor)))
        kinds = np.add.reduceat(first.astype("int64"), head)
        again = np.repeat((size > 1) | (np.maximum.reduceat(entry["flag"], head) > 0), size)
        kinds = np.repeat(kinds, size)
        entry["flag"] = np.where(first, np.where(kinds > CROWD, 2, 1), 0)
        # Equal rows are one document: a place that equals the first one is not a later place.
        place = place[order]
        lone = place == np.repeat(place[first], np.diff(np.append(np.flatnonzero(first), len(place))))
        sent = again & ~(lone & ((kinds == 1) | ~first))
        doc = docs[doc[sent]]
        parts.append(pa.table({"id": pa.array(doc[:, 0]), "tie": pa.array(doc[:, 1]), "entry": binary(entry[sent], np.ones(len(doc), "int64"))}))
    return pa.concat_tables(parts)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the rows of two matrices share from the front."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class Collection:
    """The Burrows-Wheeler transform of a collection and the common prefixes of its sorted suffixes, for windows of one size.

    Column by column: a round inserts of every string the suffix that is one symbol longer, by the symbol in front of the
    one before. A suffix c·X goes as many places into the c-th part as there are symbols c in front of X in the transform
    so far; its common prefix with the one before it is one more than the least one from that one's rest up to X. Every
    round reads and writes its arrays from end to end, as the external files of the method would be.

    No window ends in the columns before the window's last one. These are the tails, one per string, sorted at once;
    they stand in the list at their places, and what meets a tail is compared with it.
    """

    def __init__(self, texts: list[bytes], window: int):
        self.many, self.tail = len(texts), window - 1
        self.sizes = np.array([len(t) for t in texts], "int64")
        # Symbols are one more than the byte, at the right end of their row; 0 ends a string. UTF-8 holds no byte 255.
        self.width = width = int(self.sizes.max(initial=self.tail))
        self.rows = np.zeros((self.many, width), "uint8")
        joined = np.frombuffer(b"".join(texts), "uint8")
        column = np.arange(len(joined)) - np.repeat(np.cumsum(self.sizes), self.sizes) + width
        self.rows[np.repeat(np.arange(self.many), self.sizes), column] = joined + 1
        first = self._grams(np.arange(self.many), self.tail)
        self.strings = np.argsort(first, kind="stable")
        self.tails = first[self.strings]
        self.tail_rows = self.tails.view("uint8").reshape(self.many, self.tail)
        self.common = np.zeros(self.many, "uint8" if width < 256 else "uint16")
        self.common[1:] = shared(self.tail_rows[1:], self.tail_rows[:-1])
        self.symbols = self._symbols(self.strings, self.tail)
        self.is_tail = np.ones(self.many, bool)
        string, place = self.strings, np.arange(self.many)
        for size in range(window, width + 1):
            live = self.symbols[place] > 0
            string, place = string[live], place[live]
            if not len(string):
                break
            string, place = self._insert(string, place, size)

    def _grams(self, string: np.ndarray, size: int) -> np.ndarray:
        """The first symbols, as many as a tail has, of the suffixes of a size."""
        at = self.width - size
        return np.ascontiguousarray(self.rows[string, at : at + self.tail]).view(f"S{self.tail}").ravel()

    def _symbols(self, string: np.ndarray, size: int) -> np.ndarray:
        """The symbols in front of the suffixes of a size."""
        return self.rows[string, self.width - size - 1] if size < self.width else np.zeros(len(string), "uint8")

    def _order(self) -> np.ndarray:
        """The places of all symbols, sorted by symbol: the rests of the longer suffixes in their order."""
        order = np.argsort(self.symbols, kind="stable")
        return order[np.count_nonzero(self.symbols == 0) :]

    def _insert(self, string: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert c·X for the last suffixes X of ``string``, at ``place`` in ascending order."""
        old = self.symbols
        order = self._order()
        mark = np.zeros(len(old), bool)
        mark[place] = True
        new = mark[order]
        at = np.flatnonzero(new)
        rest = order[at]
        letter = old[rest]
        string = string[np.argsort(old[place], kind="stable")]
        grams = self._grams(string, size)
        tails = np.searchsorted(self.tails, grams, "right")
        spot = at + tails
        fresh = np.zeros(len(old) + len(at), bool)
        fresh[spot] = True
        stay = np.flatnonzero(~fresh)
        is_tail, grown, common = np.zeros(len(fresh), bool), np.empty(len(fresh), old.dtype), np.empty(len(fresh), self.common.dtype)
        is_tail[stay], grown[stay], common[stay] = self.is_tail, old, self.common
        grown[spot] = self._symbols(string, size)
        # The least common prefix from the rest of the neighbour before, and up to the rest of the neighbour behind.
        padded = np.append(self.common, self.common.dtype.type(0))
        rows = grams.view("uint8").reshape(len(grams), self.tail)
        before, behind = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        by_tail = (spot > 0) & is_tail[np.maximum(spot - 1, 0)]
        follows = (at > 0) & (old[before] == letter) & ~by_tail
        here = np.zeros(len(at), common.dtype)
        here[follows] = least(padded, before[follows] + 1, rest[follows]) + 1
        here[by_tail] = shared(rows[by_tail], self.tail_rows[tails[by_tail] - 1])
        common[spot] = here
        after = np.minimum(spot + 1, len(fresh) - 1)
        open_end = (spot + 1 < len(fresh)) & ~fresh[after]
        to_tail = open_end & is_tail[after]
        precedes = open_end & ~is_tail[after] & (old[behind] == letter)
        there = np.zeros(len(at), common.dtype)
        there[precedes] = least(padded, rest[precedes] + 1, behind[precedes]) + 1
        there[to_tail] = shared(rows[to_tail], self.tail_rows[tails[to_tail]])
        common[after[open_end]] = there[open_end]
        self.symbols, self.common, self.is_tail = grown, common, is_tail
        return string, spot

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, size of the suffix, begins with the window of the one before) of the sorted suffixes that hold a window."""
        long = np.flatnonzero(~self.is_tail)
        front = np.zeros(len(self.symbols), "int64")
        front[self._order()] = long
        owner, size = np.zeros(len(front), "int64"), np.zeros(len(front), "int64")
        string, place = self.strings, np.flatnonzero(self.is_tail)
        for j in range(self.tail + 1, self.width + 1):
            live = self.sizes[string] >= j
            string, place = string[live], front[place[live]]
            owner[place], size[place] = string, j
        return owner[long], size[long], self.common[long] > self.tail


def least(values: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values`` from every start to its last."""
    if not len(start):
        return values[:0]
    # From the back, so that what lies between two ranges is never gone through.
    order = np.argsort(-start)
    ends = np.stack([start[order], last[order] + 1], 1).ravel()
    out = np.empty(len(start), values.dtype)
    out[order] = np.minimum.reduceat(values, ends)[::2]
    return out


def first_windows(texts: list[bytes], place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of a collection that no other place before has; ``place`` of every string's start."""
    owner, size, same = Collection(texts, window).windows()
    offset = np.array([len(t) for t in texts], "int64")[owner] - size
    where = place[owner] + offset
    if not len(owner):
        return owner, offset
    same[0] = False
    head = np.flatnonzero(~same)
    earliest = np.repeat(np.minimum.reduceat(where, head), np.diff(np.append(head, len(owner))))
    kept = where == earliest
    return owner[kept], offset[kept]


STRINGS = "bucket long, docs binary, starts binary, sizes binary, keys binary, texts binary"


def pack_strings(rows: list[tuple[int, int, int, int, bytes]], buckets: int) -> pa.RecordBatch:
    """Strings (key, id, tie, start, text), one row per bucket, the texts compressed together."""
    codec = pa.Codec("zstd", 1)
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(row[0] % buckets, []).append(row)
    out: list[list] = [[] for _ in range(6)]
    for bucket, some in by.items():
        key, ids, ties, start, text = zip(*some)
        joined = b"".join(text)
        packed = [
            bucket, np.array([ids, ties], "<i8").T.tobytes(), np.array(start, "<u4").tobytes(), np.array([len(t) for t in text], "<u4").tobytes(),
            np.array(key, "<u8").tobytes(), len(joined).to_bytes(8, "little") + codec.compress(joined, asbytes=True),
        ]
        for column, value in zip(out, packed):
            column.append(value)
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split()[0] for c in STRINGS.split(", ")])


def firsts_of_bucket(table: pa.Table, window: int) -> pa.Table:
    """The first windows among the strings of a bucket, by document, in collections of whole keys."""
    codec = pa.Codec("zstd")
    docs, _ = elements(table["docs"], "<i8")
    docs = docs.reshape(-1, 2)
    (start, _), (size, _), (key, _) = (elements(table[c], t) for c, t in (("starts", "<u4"), ("sizes", "<u4"), ("keys", "<u8")))
    texts = b"".join(codec.decompress(v[8:], decompressed_size=int.from_bytes(v[:8], "little"), asbytes=True) for v in table["texts"].to_pylist())
    begin = np.cumsum(size.astype("int64")) - size
    place = (ranks(docs[:, 0], docs[:, 1]) << 32) | start.astype("int64")
    order = np.lexsort((place, key))
    fresh = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(order) else order
    # A key is never divided: its strings belong to the collection in which its first one lies.
    part = np.repeat(fresh // COLLECTION, np.diff(np.append(fresh, len(order))))
    found = []
    for p in np.unique(part):
        some = order[part == p]
        owner, offset = first_windows([texts[begin[i] : begin[i] + size[i]] for i in some], place[some], window)
        found.append((some[owner], offset))
    owner, offset = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, "int64") for k in range(2))
    at = start[owner].astype("int64") + offset
    order = np.lexsort((at, docs[owner, 1], docs[owner, 0]))
    owner, at = owner[order], at[order]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(docs[owner, 0]) != 0) | (np.diff(docs[owner, 1]) != 0)) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    spans = np.stack([at[head], np.diff(np.append(head, len(at)))], 1).astype("<u4")
    spans = np.ascontiguousarray(spans).view([("start", "<u4"), ("n", "<u4")]).ravel()
    return by_document(docs[owner[head], 0], docs[owner[head], 1], spans, "kept")


def gone_bytes(size: int, entries: np.ndarray, kept: np.ndarray, window: int) -> np.ndarray:
    """Which bytes lie in a window of a run of ``entries`` that is not ``kept``."""
    marks = np.zeros((2, size + 1), "int64")
    for row, spans in enumerate((entries, kept)):
        np.add.at(marks[row], spans["start"].astype("int64"), 1)
        np.add.at(marks[row], spans["start"].astype("int64") + spans["n"], -1)
    starts = (np.cumsum(marks[0]) > 0) & (np.cumsum(marks[1]) <= 0)
    cover = np.cumsum(starts)
    cover[window:] -= cover[:-window].copy()
    return cover[:size] > 0


def text_dedup(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (bytes).

    A byte is removed where it lies in ``window`` bytes that also start earlier: in a document of a smaller id, or in the
    same one further in front. Texts are UTF-8 bytes, overlaps count, and matches are judged on the input.

    Whole texts fall into runs of windows with one anchor, the gram of smallest hash; equal windows have equal anchors.
    A run whose anchor occurs nowhere else is unique. Of other runs, the string that it covers is met once, at its first
    place; all windows of its later places are removed. Different strings of one anchor enter a collection. The collection's Burrows-Wheeler transform and common
    prefixes grow by one symbol of every string a round (``Collection``); suffixes whose common prefix reaches the
    window are equal windows, and the earliest place of them is kept. A collection has a bounded number of strings of a bounded length, since executors share no folder for long files.
    Strings of an anchor with more than ``CROWD`` of them are cut, first into parts, then into windows, each
    under the bytes that all its windows share, and equal ones are combined before they are sent.

    Null text is empty. Ids are integers; null ids rank last. Documents that share an id, or lack one, are told apart and
    ordered by a hash of their text; rows equal in both are one document and share its result. Strings are equal when
    both of their 64-bit hashes, the anchor's and the string's, are. Texts shorter than a window stay; texts up to 4 GiB
    are cut, with overlaps, while they are read. An empty table gives an empty result; other columns are ignored.
    """
    if not 8 <= window <= 20_000:
        raise ValueError("A window has 8 to 20,000 bytes.")
    kind = record(window)
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST_ID))).alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    # Ids that are all different need no tie, which then weighs next to nothing on its way.
    known = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total, repeated = known.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n") > 1, F.lit(False))).first()
    if not repeated:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    buckets, groups = max(1, -(-total // PLACES_BYTES)), max(1, -(-total // STRINGS_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from places(batch, window, buckets)

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            raw = [t.as_buffer() for t in batch.column("text")]
            packed = pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())
            sizes = pa.array([len(t) for t in raw], pa.int64())
            yield batch.drop_columns(["text"]).append_column("size", sizes).append_column("packed", packed)

    own_type = dict(rows.dtypes)["own"]
    small = rows.mapInArrow(pressed, f"own {own_type}, id long, tie long, size long, packed binary").withColumn("_key", F.struct("id", "tie"))
    found = rows.select("id", "tie", "text").mapInArrow(send, PLACES).groupBy("bucket").applyInArrow(lambda t: settle(t, window), "id long, tie long, entry binary")
    marks = stored(found.groupBy("id", "tie").agg(F.collect_list("entry").alias("entries")))
    named = marks.select(F.struct("id", "tie").alias("_doc"), "entries")

    def strings(batches: Iterator[pa.RecordBatch], crowd: bool) -> Iterator[tuple[int, int, int, int, bytes, int]]:
        """(key, id, tie, start, text, cut) of the strings to compare: those of no crowd, or parts of the others."""
        gram = gram_of(window)
        codec = pa.Codec("zstd")
        for batch in batches:
            for row in batch.to_pylist():
                entries = np.frombuffer(b"".join(row["entries"]), kind)
                entries = entries[entries["flag"] == (2 if crowd else 1)]
                if not len(entries):
                    continue
                raw = codec.decompress(row["packed"], decompressed_size=row["size"], asbytes=True)
                start, at = entries["start"].astype("int64"), entries["at"].astype("int64")
                if crowd:
                    for s, n, a in zip(start.tolist(), entries["n"].tolist(), at.tolist()):
                        yield from ((key, row["id"], row["tie"], p, part, c) for p, part, key, c in cut(raw, s, n, a, window, CUTS))
                    continue
                anchors = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, "uint8"), gram)[start + at]
                keys = hashed(anchors.ravel(), gram)[:: gram] if gram > 1 else BYTE[anchors.ravel()]
                for key, s, n in zip(mixed(keys).tolist(), start.tolist(), entries["n"].tolist()):
                    yield key, row["id"], row["tie"], s, raw[s : s + n + window - 1], 0

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for item in strings(batches, False):
            held.append(item[:5])
            size += len(item[4])
            if size >= 4 * CHUNK_BYTES:
                yield pack_strings(held, groups)
                held, size = [], 0
        if held:
            yield pack_strings(held, groups)

    met = small.join(named, F.col("_key") == F.col("_doc")).select("id", "tie", "size", "packed", "entries")
    if repeated:
        # Equal rows would send their strings once each.
        met = met.groupBy("id", "tie").agg(F.first("size").alias("size"), F.first("packed").alias("packed"), F.first("entries").alias("entries"))
    work = met.mapInArrow(packs, STRINGS)
    has_crowd = F.exists("entries", lambda e: F.hex(e).rlike(crowd_pattern(kind)))
    if not marks.where(has_crowd).isEmpty():
        work = work.unionByName(crowds(met.where(has_crowd), strings, window, groups))
    kept = work.groupBy("bucket").applyInArrow(lambda t: firsts_of_bucket(t, window), "id long, tie long, kept binary")
    none = F.array().cast("array<binary>")
    both = marks.select("id", "tie", "entries", none.alias("kept")).unionByName(kept.select("id", "tie", none.alias("entries"), F.array("kept").alias("kept")))
    verdict = both.groupBy(F.struct("id", "tie").alias("_doc")).agg(F.flatten(F.collect_list("entries")).alias("entries"), F.flatten(F.collect_list("kept")).alias("kept"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        spans = np.dtype([("start", "<u4"), ("n", "<u4")])
        for batch in batches:
            removed, parts, left = [], [], []
            for row in batch.select(["size", "packed", "entries", "kept"]).to_pylist():
                raw = codec.decompress(row["packed"], decompressed_size=row["size"], asbytes=True)
                gone = np.zeros(0, bool)
                if row["entries"]:
                    gone = gone_bytes(len(raw), np.frombuffer(b"".join(row["entries"]), kind), np.frombuffer(b"".join(row["kept"]), spans), window)
                n = int(gone.sum())
                removed.append(n)
                parts.append(int(np.count_nonzero(np.diff(gone.astype("int8"), prepend=0) == 1)) if n else 0)
                left.append(np.frombuffer(raw, "uint8")[~gone].tobytes() if n else raw)
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("size"), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(left, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    last = small.join(verdict, F.col("_key") == F.col("_doc"), "left").select("own", "size", "packed", "entries", "kept")
    out = last.mapInArrow(keep, f"own {own_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("own", id_col)


def crowd_pattern(kind: np.dtype) -> str:
    """Of entries as hexadecimal text: one whose flag, its last byte, is 2."""
    return f"^(?:[0-9A-F]{{{2 * kind.itemsize}}})*?[0-9A-F]{{{2 * kind.itemsize - 2}}}02"


def cut(raw: bytes, start: int, n: int, at: int, window: int, parts: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(start, text, key, part) of a run's windows, cut by the place of the anchor in the window.

    The windows of a part all hold the bytes from its largest place to its smallest, so these make its key.
    """
    import xxhash

    places = window - gram_of(window) + 1
    width = -(-places // parts)
    anchor = start + at
    for part in range(at // width, (at - n) // width, -1) if n else ():
        high, low = min((part + 1) * width, places) - 1, part * width
        first, last = max(start, anchor - high), min(start + n - 1, anchor - low)
        if first > last:
            continue
        core = raw[anchor - low : anchor - high + window]
        yield first, raw[first : last + window], xxhash.xxh3_64_intdigest(core, part + 1000 * parts), part


def crowds(met: DataFrame, strings, window: int, groups: int) -> DataFrame:
    """Strings of crowded anchors in parts, combined by text to their first place; still crowded parts as single windows."""
    places = window - gram_of(window) + 1

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for item in strings(batches, True):
            held.append(item)
            if len(held) >= 20_000:
                yield flat_rows(held)
                held = []
        if held:
            yield flat_rows(held)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            held = []
            for r in batch.to_pylist():
                for i in range(len(r["text"]) - window + 1):
                    part = r["text"][i : i + window]
                    held.append((xxhash.xxh3_64_intdigest(part, 7), r["id"], r["tie"], r["start"] + i, part, 0))
            if held:
                yield flat_rows(held)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pack_strings([(r["key"] % 2**64, r["id"], r["tie"], r["start"], r["text"]) for r in batch.to_pylist()], groups)

    schema = "key long, id long, tie long, start long, text binary"

    def combined(some: DataFrame) -> DataFrame:
        low = F.min(F.struct("id", "tie", "start")).alias("place")
        return some.groupBy("key", "text").agg(low).select("key", "place.*", "text")

    parts = stored(combined(met.mapInArrow(flat, schema)))
    crowded = stored(parts.groupBy("key").count().where(F.col("count") > CROWD).select(F.struct("key").alias("_crowd")))
    key = F.struct("key")
    calm = parts.join(crowded, key == F.col("_crowd"), "left_anti")
    rest = combined(parts.join(crowded, key == F.col("_crowd"), "left_semi").mapInArrow(single, schema))
    return calm.select("key", "id", "tie", "start", "text").unionByName(rest.select("key", "id", "tie", "start", "text")).mapInArrow(packs, STRINGS)


def flat_rows(held: list[tuple]) -> pa.RecordBatch:
    key, ids, ties, start, text, _ = zip(*held)
    columns = [pa.array(np.array(key, "uint64").view("int64")), *[pa.array(x, pa.int64()) for x in (ids, ties, start)], pa.array(text, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "tie", "start", "text"])
