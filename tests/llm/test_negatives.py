"""Hard negatives against a comparison of every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratetally.llm import negatives as neg
from ratetally.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label string, id long, tag long, v double, slice string, score long"
LIMIT = 2**63 - 1


def brute(rows, positives=5, negatives=10, low=30, high=90):
    whole = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) for x in v], label))
    out = set()
    for i, v, label in whole:
        if i % 100:
            continue
        scored = [(-max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(v, w)))), j, other) for j, w, other in whole if len(w) == len(v) and j != i]
        for p, j, other in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out |= {(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, *[None] * 5) for i, v, label in rows], SCHEMA)
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, dim))
    return [(i, (centre[i % 7] + rng.normal(size=dim) * rng.choice([0.05, 1.0])).tolist(), "abcd"[int(rng.integers(4))]) for i in range(n)]


@pytest.mark.parametrize("block, sample", [(64, 500), (32_768, 20_000)])
def test_results_equal_brute_force_in_many_slices_and_blocks(spark, monkeypatch, block, sample):
    monkeypatch.setattr(neg, "BLOCK_ROWS", block)
    monkeypatch.setattr(neg, "STEP_ROWS", 100)
    monkeypatch.setattr(neg, "SAMPLE_ANCHORS", sample)
    # All anchors: ids are hundreds.
    rows = [(100 * i, v, label) for i, v, label in table(300, 1)] + [(100 * i + 1, v, label) for i, v, label in table(500, 2)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = table(320, 3, 3)
    # Ties: the same vector under many ids, and repeated rows.
    rows += [(1000 + i, [0.5, 0.25, -0.1], "ab"[i % 2]) for i in range(60)] + rows[:50]
    rows += [(None, [1.0, 1.0, 1.0], "a"), (2000, None, "a"), (2100, [1.0, None, 0.0], "a"), (2200, [1.0, math.nan, 0.0], "a"), (2300, [1.0, math.inf, 0.0], "b")]
    rows += [(2400, [1.0, 1.0, 1.0], None), (2500, [0.0, 0.0, 0.0], "a"), (2501, [0.0, 0.0, 0.0], "b"), (2502, [0.0, 0.0, 0.0], "a"), (2600, [1e308, 1.0, 0.0], "a")]
    rows += [(2700, [1.0, 2.0], "a"), (2701, [1.0, 1.0], "a"), (2702, [0.5, 0.5], "b"), (2800, [], "a"), (2801, [], "a"), (2802, [], "b")]
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 50, (np.array([1.0, 1.0, 1.0]) * 3e13 + rng.integers(0, 9, 3)).tolist(), "ab"[i % 2]) for i in range(20)]
    rows += [(5000 + i, [1e250 * (1 - i / 10), 1.0, 1.0], "ab"[i % 2]) for i in range(6)]
    assert mined(spark, rows, low=30, high=100) == brute(rows, low=30, high=100)


def test_no_anchors_and_an_empty_table(spark):
    assert mined(spark, [(1, [1.0], "a"), (2, [1.0], "b")]) == set()
    assert mined(spark, []) == set()


def test_walks_end_early_where_vectors_cluster():
    """Certified ends save most products of clustered vectors, and the shared list bounds every product."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 32))
    cands = np.floor(256 * (centre[rng.integers(40, size=20_000)] + 0.02 * rng.normal(size=(20_000, 32))))
    anchors = np.floor(256 * (centre[np.repeat(np.arange(10), 40)] + 0.02 * rng.normal(size=(400, 32))))
    seen = 0
    for members, norm, order, bound in neg.walks(anchors, cands):
        scores = neg.products(anchors[members], cands[order])
        assert (scores <= norm[:, None] * bound[None, :] * (1 + 1e-9) + 1e-9).all()
        best = neg.Best(len(members), 5, np.arange(len(cands)), np.zeros(len(cands), "int64"))
        seen += neg.walk(best, np.arange(len(members)), norm, anchors[members], cands, order, bound, lambda active, step, s: np.ones(s.shape, bool), np.full(len(members), -neg.MOST))
    assert seen < 0.4 * len(anchors) * len(cands)
