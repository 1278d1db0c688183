"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, node long, dim string, block string, score double, positives int"


def brute(rows, is_anchor, n_positives=5, k=10, low=30, high=90, scale=256):
    """All windows by sorting all scores; equal rows once."""
    ok = [(i, c, [math.floor(scale * float(np.float32(x))) for x in v]) for i, c, v in {(i, c, None if v is None else tuple(v)) for i, c, v in rows}
          if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        near = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in ok if b is not a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for s, p, _ in [x for x in near if x[2] == a[1]][:n_positives]:
            window = [x for x in near if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a[0], p, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "d", "b", 0.5, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect())


def table(seed, n, dim, labels, spread=0.4):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(dim)]
    return [(i, rng.choice(labels), [rng.gauss(0, spread) + c for c in centre]) for i in range(n)]


def test_windows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 16)  # several blocks
    monkeypatch.setattr(H, "SCORES", 64)  # and several steps of a cell
    for seed, n, dim, labels in ((1, 120, 4, [0, 1, 2]), (2, 90, 2, [0, 0, 0, 1]), (3, 60, 1, [0, 1])):
        rows = table(seed, n, dim, labels)
        want = brute(rows, lambda i: i % 5 == 0)
        assert want and run(spark, rows) == want
        assert run(spark, rows, n_positives=2, k=3, low=10, high=100) == brute(rows, lambda i: i % 5 == 0, 2, 3, 10, 100)


def test_parts_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 10)
    rows = table(4, 100, 3, [0, 1])
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows_ties_and_copies(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5])] + [(i, 3, [0.5, 0.5]) for i in range(3, 40)]
    rows += [(2, 2, [0.5, 0.5])] * 20  # equal rows
    rows += [(0, 2, [0.7, 0.1]), (5, 1, [0.9, 0.9])]  # other rows of an id
    rows += [(None, 1, [1.0, 1.0]), (41, None, [1.0, 1.0]), (42, 1, None), (43, 1, [None, 1.0]), (44, 1, [float("nan"), 1.0]), (45, 1, [float("inf"), 1.0])]
    rows += [(50, 1, []), (51, 1, []), (52, 2, []), (55, 1, [1.0, 2.0, 3.0]), (60, 9, [-1.0, -1.0]), (65, 9, [1.0, 1.0])]
    want = brute(rows, lambda i: i % 5 == 0)
    assert any(r[0] == 50 for r in want)  # empty vectors score 0
    assert run(spark, rows) == want
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0])]) == [] and run(spark, [(0, 1, [1.0])]) == []


def test_hot_label_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 32)
    rows = table(5, 80, 3, [0, 1, 2]) + [(i, 0, [0.25, 0.5, 0.125]) for i in range(100, 400)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_exact_integers():
    a = np.array([[2**20 + 1, -(2**21)]], np.int64)
    for big in (1, 2**20, 2**38):
        b = np.array([[big + 1, big]], np.int64)
        assert H.scores(a, b)[0, 0] == int(a[0, 0]) * int(b[0, 0]) + int(a[0, 1]) * int(b[0, 1])
    with pytest.raises(ValueError):
        H.scores(a * 2**30, a * 2**30)


def test_slots_and_merges():
    """Overlapping windows from slots equal windows cut out of the sorted scores."""
    rng = np.random.default_rng(6)
    for _ in range(50):
        s = rng.integers(-20, 100, 60)
        windows = H.limits([int(p) for p in rng.integers(-5, 110, 5)], 30, 90)
        found = {u: [(int(s[i]), int(i)) for i in at] for u, at in H.slots(s, windows, 4)}
        got = H.windows_from_slots(windows, found, 4)
        order = sorted(range(60), key=lambda i: (-s[i], i))
        assert got == [[(int(s[i]), i) for i in order if lo <= s[i] <= hi][:4] for lo, hi in windows]
