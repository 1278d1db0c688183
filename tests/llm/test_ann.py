"""Nearest neighbours against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
from helpers import SF
from pyspark.sql import functions as F

from tally.llm import ann, queries


def brute(rows, k, is_query):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            near = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))
            out.setdefault(q, near[:k])
    return out


def test_recall_on_the_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    want = brute(list(zip(t["vec_id"], t["embedding"], strict=True)), 20, lambda i: i % 20 == 0)
    got = {}
    for r in queries.QUERIES["op8_ann"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = dict(zip(t["vec_id"], np.array(t["embedding"], float), strict=True))
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(math.isclose(s, float((x[q] * x[v]).sum()), rel_tol=1e-12, abs_tol=1e-15) for _, v, s in rows)


def test_edges_and_hot_vectors(spark, monkeypatch):
    """Copies, ties, bad vectors, other lengths, few candidates; groups of a few rows."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0]), (204, [float("inf"), 1.0, 0.0]), (205, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0]), (220, [1.0, 2.0]), (240, [2.0, 1.0]), (260, [-0.0, 3.0, 1.0]), (261, [0.0, 3.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<double>, node int, bucket string")
    want = brute(rows, 5, lambda i: i % 20 == 0)
    for size in (1 << 16, 7):
        got = {}
        for r in ann.neighbours(frame, F.col("vec_id") % 20 == 0, k=5, group_rows=size).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        hit = total = 0
        assert set(got) == {q for q, near in want.items() if near}
        for q, near in want.items():
            total += len(near)
            hit += len({v for v, _ in got[q].values()} & {i for _, i in near})
        assert hit >= 0.9 * total
        assert [got[0][r][0] for r in (1, 2, 3)] == [i for _, i in want[0][:3]]
    assert ann.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_probes_are_ordered_by_cost():
    h = ann.Hashes(4, 1.0, tables=1, hashes=3, probes=27)
    places = h.places(np.random.default_rng(2).normal(size=(5, 4)), True)[0]
    visit = h.visited(places, 0)
    for p, row in zip(places, visit, strict=True):
        cell, part = np.floor(p), p - np.floor(p)
        cost = lambda s: sum(0 if d == 0 else ((1 - f) ** 2 if d > 0 else f**2) for d, f in zip(s, part, strict=True))  # noqa: B023, E731
        order = sorted(h.steps.tolist(), key=cost)
        assert row.tolist() == [int(h.buckets(cell + np.array(s), 0)) for s in order]
