"""Suffix-array deduplication against a dictionary of all windows, and the transform against sorted suffixes."""

import random

import numpy as np
import pytest

from ratetally.llm import suffixes as s
from ratetally.llm.suffixes import Collection, first_windows, text_dedup

SCHEMA = "doc_id long, text string, id long, tie long, own string, size long, kept binary, bucket long, entry string"
LAST = 2**63


def brute(rows, window, ties):
    """(id, n_bytes, n_removed, n_spans, kept) per row; ``ties`` gives a document's place among those of its id."""
    seen = {}
    docs = sorted({(LAST if i is None else i, ties[t], t) for i, t in rows})
    raw = {d: (d[2] or "").encode() for d in docs}
    for d in docs:
        for at in range(len(raw[d]) - window + 1):
            seen.setdefault(raw[d][at : at + window], (d, at))
    out = []
    for i, t in rows:
        d = (LAST if i is None else i, ties[t], t)
        gone = np.zeros(len(raw[d]), bool)
        for at in range(len(raw[d]) - window + 1):
            if seen[raw[d][at : at + window]] != (d, at):
                gone[at : at + window] = True
        spans = int(np.count_nonzero(np.diff(gone.astype("int8"), prepend=0) == 1))
        out.append((-1 if i is None else i, len(gone), int(gone.sum()), spans, bytes(b for b, g in zip(raw[d], gone) if not g)))
    return sorted(out)


def deduped(spark, rows, window):
    df = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in text_dedup(df, window).collect())


def hashes(spark, rows):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string")
    return {r["t"]: r["h"] for r in texts.select("t", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h")).collect()}


def corpus(seed, docs=60, alphabet="abé "):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randrange(20, 90)) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 7))]
        rows.append((rng.randrange(-5, 100), "".join(parts)))
    return rows


def test_transform_sorts_all_windows():
    rng = random.Random(1)
    for _ in range(120):
        texts = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randrange(2, 14))) for _ in range(rng.randrange(1, 14))]
        owner, size, same = Collection(texts, 3).windows()
        want = sorted((t[at:], k) for k, t in enumerate(texts) for at in range(len(t) - 2))
        assert [texts[o][len(texts[o]) - n :] for o, n in zip(owner, size)] == [w for w, _ in want]
        assert [bool(x) for x in same[1:]] == [a[:3] == b[:3] for (a, _), (b, _) in zip(want, want[1:])]


@pytest.mark.parametrize("window", [2, 3, 9])
def test_transform_and_prefixes_equal_the_naive_ones(window):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(window - 1, 40))) for _ in range(40)]
    got = Collection(texts, window)
    rows = sorted(((t[at:], t[at - 1] + 1 if at else 0) for t in texts for at in range(len(t) - window + 2)), key=lambda r: r[0])
    common = lambda a, b: next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
    assert got.common.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    assert sorted(zip([r[0] for r in rows], got.symbols.tolist())) == sorted(rows)


def test_first_windows_of_a_collection():
    texts = [b"xxabcdefyy", b"abcdef", b"zabcdefz"]
    owner, offset = first_windows(texts, np.array([500, 100, 300]), 5)
    assert {(o, a) for o, a in zip(owner.tolist(), offset.tolist())} == {(1, 0), (1, 1), (0, 0), (0, 1), (0, 4), (0, 5), (2, 0), (2, 3)}


@pytest.mark.parametrize("seed, window, chunk, crowd", [(1, 16, 1 << 21, 4096), (2, 16, 97, 4096), (3, 16, 1 << 21, 1), (4, 33, 300, 2), (5, 8, 64, 3)])
def test_documents_equal_brute_force(spark, monkeypatch, seed, window, chunk, crowd):
    """In one chunk and in cut texts, in whole strings and in parts of crowds."""
    monkeypatch.setattr(s, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(s, "CROWD", crowd)
    monkeypatch.setattr(s, "PLACES_BYTES", 4000)
    monkeypatch.setattr(s, "STRINGS_BYTES", 2000)
    monkeypatch.setattr(s, "COLLECTION", 7)
    rows = corpus(seed) + [(7, "abab" * 60), (8, "a" * 150), (9, "a" * (window - 1)), (10, "a" * window), (900, None), (901, ""), (None, "b" * 50), (None, "c" * 50), (None, "b" * 50)]
    rows += rows[:8] + [(50, rows[3][1]), (50, rows[4][1] + "x"), (2**63 - 1, "é" * 70)]
    assert deduped(spark, rows, window) == brute(rows, window, hashes(spark, rows))


def test_a_third_of_the_rows_share_one_passage(spark, monkeypatch):
    monkeypatch.setattr(s, "CROWD", 16)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(140)
    rows = [(i, text(150) + (passage if i % 3 == 0 else "") + text(150)) for i in range(300)] + [(1000 + i, "the same text of more than a hundred bytes " * 4) for i in range(100)]
    assert deduped(spark, rows, 100) == brute(rows, 100, hashes(spark, rows))


def test_a_very_long_text_and_an_empty_table(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, "x" * 40 + long[200_000:200_150]), (3, long[:500])]
    got = {r[0]: r for r in deduped(spark, rows, 100)}
    assert got[1][2:4] == (0, 0) and got[2][2:4] == (150, 1) and got[2][4] == b"x" * 40 and got[3][2] == 500
    assert deduped(spark, [], 100) == []
