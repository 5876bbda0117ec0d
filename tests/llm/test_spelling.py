"""Spelling variants against a comparison of all words, and the filters on their own."""

import random
import zlib

import numpy as np
import pytest

from ratetally.llm.spelling import Filters, filled, part_of, spelling_groups, vocabulary, word_hashes

SCHEMA = "word string, n long, form string, root string, maybe string, word_n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        form = min(others)[1] if others and -min(others)[0] >= ratio * n else None
        out[w] = [n, len(others), form, counts.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def rows_of(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("bits_sent", [1, 1 << 20])
def test_groups_equal_all_pairs(spark, bits_sent):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(150)} | {"zzzzzzz", "zzzzzz", "zzzz", "😀a", "😀b", "x" * 3000, "x" * 2999 + "y"}
    counts = {w: rng.choice([1, 3, 40, 700, 20_000]) for w in words}
    rows = [(w, n, None, None, None, None) for w, n in counts.items()]
    got = rows_of(spelling_groups(spark.createDataFrame([*rows, (None, 9, *[None] * 4)], SCHEMA), 10, bits_sent))
    assert got == brute(counts, 10)


def test_a_hub_with_thousands_of_near_words_is_one_row(spark):
    hub = "abcdefgh"
    some = {hub[:i] + c + hub[i + 1 :] for i in range(8) for c in map(chr, range(0x61, 0x61 + 26))} | {hub[:i] + c + hub[i:] for i in range(9) for c in map(chr, range(0xC0, 0x100))}
    counts = dict.fromkeys(some, 2) | {hub: 5000}
    got = rows_of(spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got[hub] == (5000, len(some) - 1, None, None, hub)
    assert got == brute(counts, 10)


def test_repeated_words_add_up_and_an_empty_table_is_empty(spark):
    got = rows_of(spelling_groups(spark.createDataFrame([("aaaaaaa", 20), ("aaaaaaa", 30), ("aaaaaab", 5)], "word string, n long")))
    assert got == {"aaaaaaa": (50, 1, None, None, "aaaaaaa"), "aaaaaab": (5, 1, "aaaaaaa", 50, "aaaaaaa")}
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).collect() == []


def test_vocabulary_plants_errors(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Größenordnung", "ÀÉletters", "sixsix", "sevenxx", "plainĀword"]) for _ in range(60)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "sevenxx sevenxx"), (99, None), (98, ""), (97, "longer" * 5000 + " longer" * 3)]
    want = {}
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\xc0" <= c <= "\xff":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(word) >= 7:
                    want[word] = want.get(word, 0) + 1
            run = ""
    got = {r["word"]: r["n"] for r in vocabulary(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _run string"), every=31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


def test_filters_find_all_their_words_and_few_others():
    rng = np.random.default_rng(1)
    points = rng.integers(97, 123, (20_000, 9)).astype("uint32")
    hashes = word_hashes(points)
    part = part_of(hashes, 3)
    filters = Filters([(9, p, filled(hashes[part == p]).tobytes()) for p in range(3)], {9: 3})
    assert len(filters.hits(9, hashes)) == len(hashes)
    assert len(filters.hits(9, word_hashes(rng.integers(97, 123, (50_000, 9)).astype("uint32")))) < 1000
