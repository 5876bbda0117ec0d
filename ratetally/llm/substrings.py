"""Removing passages that repeat across documents: winnowed anchors, extension both ways, maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from ratetally.llm.words import chunks, grams

SEED_WORDS = 4
# Documents looked at to find anchors that many documents share; it decides where rows go, never what is found.
SAMPLE_DOCS = 20_000
OFTEN = 4
BUCKET_BYTES = 6_000_000
NO_ID = np.iinfo("int64").max
# Rows without an id that are told apart by their text have numbers from here on.
LACKING = 1 << 62
_FIVE = np.uint64((1 << 40) - 1)


def anchored(hashes: np.ndarray, counts: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor position, anchor hash) of every window that lies in one document.

    The anchor of a window is its seed of the smallest hash, the first of equals. It depends on the window's words
    only, so equal windows have equal anchors at equal distances.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, "int64")
        return none, none, np.zeros(0, "uint64")
    doc = np.repeat(np.arange(len(counts)), counts)
    seeds = grams(hashes, SEED_WORDS)
    at = sliding_window_view(seeds, window - SEED_WORDS + 1).argmin(1) + np.arange(n)
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return start, at[start], seeds[at[start]]


def frequent_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """Anchors that at least ``OFTEN`` of about ``SAMPLE_DOCS`` documents have, sorted."""
    parts = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("_id", "_check"), F.lit(parts)) == 0).select("_text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, counts, hashes in chunks(batch.column(0)):
                start, _, anchor = anchored(hashes, counts, window)
                doc = np.repeat(np.arange(len(counts)), counts)[start]
                order = np.lexsort((doc, anchor))
                new = np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(doc[order]) != 0)) if len(order) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[order][new].view("int64"))], names=["anchor"])

    counted = some.mapInArrow(seeds, "anchor long").groupBy("anchor").count().where(F.col("count") >= OFTEN)
    return np.sort(np.array([r[0] for r in counted.select("anchor").collect()], "int64").view("uint64"))


def sent(ids: np.ndarray, checks: np.ndarray, counts: list[int], hashes: np.ndarray, window: int, often: np.ndarray, buckets: int):
    """What one chunk sends: (bucket, documents, entries) for other chunks to meet, and runs already decided.

    An entry is an anchor with the windows it stands for: its context of up to ``window`` words both ways, one
    hash each. Windows of frequent anchors go by their own hash, each distinct one once per chunk and for its
    smallest document; the other occurrences in the chunk are decided here.
    """
    start, at, anchor = anchored(hashes, counts, window)
    if not len(start):
        return [], (start, start, start)
    first = np.concatenate([[0], np.cumsum(counts)])
    whole = grams(hashes, window)[start]
    doc = np.repeat(np.arange(len(counts)), counts)[start]
    place = start - first[doc]
    place_in = np.searchsorted(often, anchor)
    hot = (often[np.minimum(place_in, len(often) - 1)] == anchor) if len(often) else np.zeros(len(anchor), bool)
    # Frequent: the smallest document of every window stays to be sent, larger ones are decided.
    h = np.flatnonzero(hot)
    order = h[np.lexsort((ids[doc[h]], whole[h]))]
    new = np.append(True, np.diff(whole[order]) != 0) if len(order) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least = ids[doc[order[new]]][group] if len(order) else np.zeros(0, "int64")
    later = order[ids[doc[order]] > least]
    equal = order[ids[doc[order]] == least]
    # Others: one entry per run of windows with one anchor.
    c = np.flatnonzero(~hot)
    run = np.append(True, (np.diff(at[c]) != 0) | (np.diff(start[c]) != 1)) if len(c) else np.zeros(0, bool)
    heads = np.flatnonzero(run)
    sizes = np.diff(np.append(heads, len(c)))
    key = np.concatenate([anchor[c[heads]], whole[equal]])
    entry_doc = np.concatenate([doc[c[heads]], doc[equal]])
    entry_place = np.concatenate([place[c[heads]], place[equal]])
    size = np.concatenate([sizes, np.ones(len(equal), "int64")])
    windows = np.concatenate([whole[c], whole[equal]])
    bucket = (key % np.uint64(buckets)).astype("int64")
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(size)
    out = []
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        e = order[a:b]
        used, local = np.unique(entry_doc[e], return_inverse=True)
        n = size[e]
        places = np.repeat(ends[e] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        docs = np.stack([ids[used], checks[used]], 1)
        rest = key[e] // np.uint64(buckets)
        out.append((
            int(bucket[e[0]]), docs.tobytes(), rest.astype("<u8").view("uint8").reshape(-1, 8)[:, :7].tobytes(), local.astype("<u4").tobytes(),
            entry_place[e].astype("<u4").tobytes(), n.astype("uint8").tobytes(), windows[places].astype("<u8").view("uint8").reshape(-1, 8)[:, :5].tobytes(),
        ))
    return out, (ids[doc[later]], checks[doc[later]], place[later])


def runs_of(ids: np.ndarray, checks: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs (id, check, first, last): neighbouring starts join to one repeat."""
    order = np.lexsort((places, checks, ids))
    ids, checks, places = ids[order], checks[order], places[order]
    new = (np.diff(ids) != 0) | (np.diff(checks) != 0) | (np.diff(places) > 1)
    head = np.flatnonzero(np.append(True, new)[: len(ids)])
    tail = np.flatnonzero(np.append(new, True)[: len(ids)])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[head], checks[head], places[head], places[tail])], names=["id", "check", "first", "last"])


def decide(table: pa.Table) -> pa.RecordBatch:
    """Runs of one bucket: the windows that a smaller document of the bucket has as well, and those decided before."""
    ids, checks, places, keys, windows = [], [], [], [], []
    done = []
    for row in table.to_pylist():
        docs = np.frombuffer(row["docs"], "<i8").reshape(-1, 2)
        if row["done"]:
            done.append((docs[:, 0], docs[:, 1], np.frombuffer(row["place"], "<u4").astype("int64")))
            continue
        n = np.frombuffer(row["size"], "uint8").astype("int64")
        key = np.zeros((len(n), 8), "uint8")
        key[:, :7] = np.frombuffer(row["key"], "uint8").reshape(-1, 7)
        win = np.zeros((n.sum(), 8), "uint8")
        win[:, :5] = np.frombuffer(row["windows"], "uint8").reshape(-1, 5)
        local = docs[np.frombuffer(row["doc"], "<u4")]
        begin = np.repeat(np.cumsum(n) - n, n)
        ids.append(np.repeat(local[:, 0], n))
        checks.append(np.repeat(local[:, 1], n))
        places.append(np.repeat(np.frombuffer(row["place"], "<u4").astype("int64"), n) + np.arange(n.sum()) - begin)
        keys.append(np.repeat(key.view("<u8").ravel(), n))
        windows.append(win.view("<u8").ravel())
    found = [np.zeros(0, "int64")] * 3
    if ids:
        ids, checks, places, keys, windows = (np.concatenate(x) for x in (ids, checks, places, keys, windows))
        order = np.lexsort((ids, windows, keys))
        k, w, d = keys[order], windows[order], ids[order]
        new = np.append(True, (np.diff(k) != 0) | (np.diff(w) != 0))
        later = order[d > d[new][np.cumsum(new) - 1]]
        found = [ids[later], checks[later], places[later]]
    parts = [found, *done]
    return runs_of(*[np.concatenate([p[i] for p in parts]) for i in range(3)])


def covered(n: int, runs: pa.StructArray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts in one of the runs (first, last)."""
    marks = np.zeros(n + 1, "int64")
    np.add.at(marks, runs.field("first").to_numpy(), 1)
    np.add.at(marks, np.minimum(runs.field("last").to_numpy() + window, n), -1)
    return np.cumsum(marks[:n]) > 0


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """(id, check, runs) of the documents with windows that a document of smaller id has as well; ``docs`` as made by ``keyed``."""
    often = frequent_anchors(docs, window)
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, checks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, counts, hashes in chunks(batch.column(2)):
                own, check = ids[first : first + len(counts)], checks[first : first + len(counts)]
                rows, decided = sent(own, check, counts, hashes, window, shared.value, buckets)
                cols = [list(x) for x in zip(*rows)] or [[] for _ in range(7)]
                cols.insert(1, [False] * len(rows))
                if len(decided[0]):
                    extra = [int(decided[0][0] % buckets), True, np.stack(decided[:2], 1).tobytes(), b"", b"", decided[2].astype("<u4").tobytes(), b"", b""]
                    for c, x in zip(cols, extra):
                        c.append(x)
                kinds = [pa.int64(), pa.bool_()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "done", "docs", "key", "doc", "place", "size", "windows"])

    def meet(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([decide(table)])

    rows = docs.select("_id", "_check", "_text").mapInArrow(send, "bucket long, done boolean, docs binary, key binary, doc binary, place binary, size binary, windows binary")
    found = rows.groupBy("bucket").applyInArrow(meet, "id long, check long, first long, last long")
    return found.groupBy("id", "check").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column, apart: bool = False) -> DataFrame:
    """_id (null as the largest number), _check (a hash of the text) and _text (null as empty) of every row.

    With ``apart`` every text without an id has a number of its own, from ``LACKING`` on, by a hash of it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.xxhash64(text).bitwiseAND(LACKING - 1) + F.lit(LACKING) if apart else F.lit(int(NO_ID))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("_id"), F.xxhash64(text).alias("_check"), text.alias("_text"), *more)


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text.

    A word is removed where it lies in ``window`` consecutive words that also start somewhere in a document of a
    smaller id, judged on the input. Documents meet on anchors: of every window the seed of ``SEED_WORDS`` words
    with the smallest hash, so equal windows meet whatever stands around them. An anchor brings the windows it
    stands for, its extension both ways; those that a smaller document brings too are repeats, and neighbouring
    ones join to maximal repeats. Windows of anchors that many documents have go by their own hash and only once
    per chunk of input, so no passage gathers its documents in one task.

    Null text has no words. Null ids rank last and are one id; rows that share an id never remove from each other. Words
    are kept as they are and joined by one space. Equal windows are told by their hashes (the anchor's or
    window's 64 bits and 40 of the window). A text of fewer words than a window keeps them all; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_runs(rows, window)
    met = rows.join(found, (rows["_id"] == found["id"]) & (rows["_check"] == found["check"]), "left").select("_id", "_text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                n = len(words)
                if runs.is_valid:
                    gone = covered(n, runs.values, window)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    out = met.mapInArrow(keep, "id long, n_words long, n_removed long, kept_text string")
    return out.select(F.nullif("id", F.lit(int(NO_ID))).alias(id_col), "n_words", "n_removed", "kept_text")
