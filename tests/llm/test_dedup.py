"""Deduplication operators against brute force on small tables with every odd case."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratetally.llm import exact, vectors
from ratetally.llm.common import components
from ratetally.llm.edits import probes, segments, within
from ratetally.llm.exact import exact_dedup
from ratetally.llm.jaccard import jaccard_join
from ratetally.llm.lines import line_dedup
from ratetally.llm.substrings import substring_dedup
from ratetally.llm.vectors import near_vectors

# Names that the operators use inside; a table may have them too.
CLASHING = "_text string, _id long, id long, n long, line string, lines string, kept boolean, grams string, check long, component string"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], f"doc_id long, text string, {CLASHING}")

    return make


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def folded(text):
    return (text or "").encode().lower().decode()


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "É x"), (906, "é x"), (907, "\x85a b"), (908, None)]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40, 90)] + [(200, i) for i in range(201, 230)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 3)]
    edges += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    want = Groups()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: want.find(n) for n in want}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, keep):
    rows = [(i, f"Text {i % 4}") for i in range(20)] + [(20, "tEXT 1")] + ODD
    got = {r["doc_id"]: r for r in exact_dedup(docs(rows), keep=keep).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(folded(t), []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            stays = (min if keep == "min" else max)(ids)
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (stays, len(ids), i == stays)


def test_exact_dedup_tells_texts_of_one_hash_apart(docs, monkeypatch):
    monkeypatch.setattr(exact.F, "md5", lambda c: F.lit("00" * 16))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs([(1, "a"), (2, "b"), (3, "A"), (4, "c")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_exact_dedup_of_rows_without_and_with_repeated_ids(docs):
    got = sorted(map(tuple, exact_dedup(docs([(None, "a"), (None, "a"), (1, "b"), (None, "B"), (1, "b")])).drop("text_sha256").collect()), key=str)
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 2, True), (None, None, 2, True)]
    assert exact_dedup(docs([])).count() == 0


def near_copies(seed, n=60, words=40, vocabulary=400):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 12, words]))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = f"W{rng.randrange(vocabulary)}"
        rows.append((i * 7 % 61, " ".join(text)))
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(docs, k, percent):
    rows = near_copies(k) + ODD
    sets, want = {}, Groups()
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                want.join(a, b)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs(rows), k, percent).collect()}
    assert got == {i: (len(s), want.find(i)) for i, s in sets.items()}


def test_jaccard_join_of_a_star_of_copies_and_repeated_rows(docs):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(1, 40)] + [(50, " ".join(base)), (50, " ".join(base)), (None, "lone text here is short")]
    got = jaccard_join(docs(rows), 4, 85).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"]} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join(docs([])).count() == 0


def test_jaccard_join_of_repeated_rows_and_of_ids_with_several_texts(docs):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # Overlaps of a third to three quarters: they link only where the copies of a set are counted several times.
    rows = [(1, words(0, 60)), (2, words(28, 88)), (3, words(1000, 1060)), (4, words(1009, 1069)), (4, words(1009, 1069)), (5, words(2000, 2060)), (6, words(2001, 2061))]
    alone = {r[0]: tuple(r)[1:] for r in jaccard_join(docs(rows), 4, 85).collect()}
    assert alone == {1: (57, 1), 2: (57, 2), 3: (57, 3), 4: (57, 4), 5: (57, 5), 6: (57, 5)}
    twice = jaccard_join(docs(rows).union(docs(rows)), 4, 85).collect()
    assert len(twice) == 2 * len(rows) and {r[0]: tuple(r)[1:] for r in twice} == alone
    # Two texts of one id, of one length, each with half of another text: their overlaps are not one overlap.
    halves = [(7, words(3000, 3031) + " " + words(4000, 4029)), (7, words(5000, 5029) + " " + words(3029, 3060)), (8, words(3000, 3060))]
    assert {r[0]: r["component_id"] for r in jaccard_join(docs(halves), 4, 85).collect()} == {7: 7, 8: 8}


def brute_substrings(rows, window):
    first = {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        for a in range(len(words) - window + 1):
            first.setdefault(tuple(words[a : a + window]), i)
    out = {}
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for a in range(len(words) - window + 1):
            if first[tuple(words[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(docs, seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.choice([12, 13, 14, 30]))] for _ in range(6)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(9000)}" for _ in range(rng.randrange(20))]
        rows.append((i * 3, " ".join(text)))
    rows += [(700, "same " * 40), (701, "same " * 13), (702, "Same " * 13), *ODD]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(docs(rows)).collect()}
    assert got == brute_substrings(rows, 13)


def test_substring_dedup_of_rows_that_share_or_lack_ids(docs):
    text = " ".join(f"w{i}" for i in range(20))
    got = sorted((r[0] or 0, r[2]) for r in substring_dedup(docs([(5, text), (5, text), (None, text), (None, text)])).collect())
    assert got == [(0, 20), (0, 20), (5, 0), (5, 0)]
    assert substring_dedup(docs([])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, letters):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        if kind == 0:
            text.insert(at, rng.choice(letters))
        elif at < len(text):
            text[at : at + 1] = [rng.choice(letters)] if kind == 1 else []
    return "".join(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance_and_segments(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh", "aé√𝄞 "])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 30, 90])))
        pairs.append((text, edited(rng, text, rng.randrange(edits + 3), letters)))
    want = np.array([edit_distance(a, b) <= edits for a, b in pairs])
    assert (within(pairs, edits) == want).all()
    for (a, b), near in zip(pairs, want):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if near and len(b) > edits:
            filed = {(len(b), i, b[s : s + n]) for i, (s, n) in enumerate(segments(len(b), edits))}
            assert any((n, i, a[s : s + size]) in filed for n, i, s, size in probes(len(a), edits))


def brute_lines(rows, edits, least):
    blank = lambda line: not line.encode().strip(b" \t\n\r\x0b\x0c")
    lines = sorted({line for _, t in rows for line in (t or "").split("\n") if not blank(line)})
    group = {line: line for line in lines}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= least and edit_distance(a, b) <= edits:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    owner = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            if not blank(line):
                owner.setdefault(find(line), (i, n))
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [line for n, line in enumerate(every) if blank(line) or owner[find(line)] == (i, n)]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_line_dedup(docs, block, monkeypatch):
    monkeypatch.setattr("ratetally.llm.lines.BLOCK_LINES", block)
    rng = random.Random(5)
    letters = "abcdé "
    base = ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 24, 25, 40, 40, 60)] + ["x" * 30, "x" * 31, ""]
    rows = []
    for i in range(30):
        rows.append((i, "\n".join(edited(rng, rng.choice(base), rng.randrange(3), letters) for _ in range(rng.randrange(1, 6)))))
    rows += [(i, t) for i, t in ODD]
    got = {r[0]: tuple(r)[1:] for r in line_dedup(docs(rows)).collect()}
    assert got == brute_lines(rows, 2, 24)


def test_line_dedup_carries_columns_and_takes_empty_tables(docs):
    out = line_dedup(docs([(1, "a"), (None, "a"), (None, None)]), carry=("lines", "_id"))
    assert out.columns == ["doc_id", "lines", "_id", "n_lines", "n_removed", "kept_text"]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 0), (0, 1), (1, 0)]
    assert line_dedup(docs([])).count() == 0


def test_rows_without_an_id_lose_their_common_lines(docs):
    """Rows without an id are told apart by their text: of a line that they share one stays; equal rows share its fate."""
    common = "a line that all of these documents have"
    rows = [(None, f"{common}\nown text number {i}") for i in range(200)] + [(None, f"{common}\nown text number 3")]
    got = [(r["n_removed"], r["kept_text"]) for r in line_dedup(docs(rows)).collect()]
    stay = {t for n, t in got if n == 0}
    assert len(stay) == 1 and sum(n for n, _ in got) == len(rows) - sum(n == 0 for n, _ in got)


def test_rows_without_an_id_do_not_tie_groups_together(docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (None, f"{a} more"), (None, f"{b} more"), (2, b)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard_join(docs(rows), 4, 85).collect())
    assert got == [(0, 1), (0, 2), (1, 1), (2, 2)]


@pytest.mark.parametrize("block", [4096, 7])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(int(i * 5 % 83), (centres[i % 5] * (1 + i % 3) + rng.normal(size=8) * 0.25).astype("float32").tolist()) for i in range(80)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [0.0] * 8), (103, None), (104, []), (105, [float("nan")] * 8), (106, [None] + [1.0] * 7), (107, [float("inf")] * 8)]
    rows += [(108, [1.0, 2.0]), (109, [2.0, 4.0]), (110, [1e-30] * 8), (111, [1e30] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, v int, id int, links int")
    sound = {i: np.array(v, "float32").astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    want, n = Groups(), dict.fromkeys([i for i, _ in rows], 0)
    for a, x in sound.items():
        for b, y in sound.items():
            if a < b and len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.9:
                want.join(a, b)
                n[a] += 1
                n[b] += 1
    got = {r[0]: tuple(r)[1:] for r in near_vectors(table, 0.9).collect()}
    assert got == {i: (n[i], want.find(i), want.find(i) == i) for i, _ in rows}
    assert near_vectors(table.limit(0), 0.9).count() == 0


def test_near_vectors_shuffles_no_vector_per_pair_of_blocks(spark, monkeypatch):
    """Four times the vectors, in cells that nothing separates, write about four times the shuffled bytes."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "CELL_ROWS", 64)

    def written(n):
        gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        total = lambda: sum(s.shuffleWriteBytes() for s in map(stages().apply, range(stages().size())))
        x = np.random.default_rng(n).normal(size=(n, 64)).astype("float32").tolist()
        before = total()
        assert near_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>"), 0.9).count() == n
        return total() - before

    few, many = written(400), written(1600)
    assert 0 < many <= 6 * few
