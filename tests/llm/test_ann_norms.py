"""Recall of nearest neighbours with unequal norms."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ann import brute

from tally.llm import ann


def unequal(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "outlier":
        x[7] *= 100
    elif kind == "log-normal":
        x *= np.exp(rng.normal(0, 0.5, 1200))[:, None]
    return list(enumerate(x.tolist()))


@pytest.mark.parametrize("kind", ["outlier", "log-normal"])
def test_recall_with_unequal_norms(spark, kind):
    rows = unequal(kind)
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_queries_that_find_too_few_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "SCAN_QUERIES", 2)
    rng = np.random.default_rng(6)
    rows = [(i, (s * rng.normal(size=16)).tolist()) for i, s in enumerate(np.exp(rng.normal(0, 2, 60)))] + [(100 + i, [1e-200, 1e200][i % 2:] + [0.5]) for i in range(4)]
    want = brute(rows, 20, lambda i: i % 5 == 0)
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, group_rows=25).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: len(v) for q, v in got.items()} == {q: len(near) for q, near in want.items() if near}
