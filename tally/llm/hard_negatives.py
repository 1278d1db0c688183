"""Hard-negative mining: windows of scores below each positive, answered from disjoint slots.

Scores are integer inner products of vectors whose components were floored to whole
numbers. An anchor's positives are its nearest other rows of its label; a window for each
positive holds the scores between two shares of the positive's own. The upper limits of an
anchor's windows cut the scores into disjoint slots. A row of another label falls into one
slot, and the ``k`` best rows of a slot are all that any answer can need of it, so blocks
of rows keep ``k`` rows a slot and are combined. Merging the slots from the lowest limit
upwards, ``k`` rows again at each step, gives the best rows below every limit; what lies
below a window's lower limit is cut off there. Windows may overlap in any way.

Anchors and rows meet in a grid: rows are dealt into blocks of at most ``BLOCK``, anchors
into parts of at most ``BLOCK``, and a cell compares one block with one part by a matrix
product. Positives meet within labels only, each label's rows dealt over all blocks, so
that a label that holds most rows is spread. A cell's result is bounded by its anchors.

Rows with a null id, label or vector, or a null or non-finite component, take no part.
Empty vectors score 0 with each other; vectors of different lengths are never compared.
Rows that are equal in id, label and vector count once; other rows of one id are rows of
their own. Ties go to the smaller id. Fewer other rows give fewer positives or negatives; a
negative positive score has an empty window. Components whose inner products might leave
64 bits raise. Other input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import written

BLOCK = 1 << 17  # rows of a block and anchors of a part, at most
SMALL = 1 << 10  # rows below which a block isn't cut further to make more tasks
SCORES = 1 << 21  # scores that a cell holds at once
_NONE = np.iinfo(np.int64).min


def _whole_vectors(df: DataFrame, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """``vec_id, label, dim, vec`` (whole numbers as bytes) of the rows that take part, equal ones once."""
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), df[vec_col].cast("array<double>").alias("v")).dropna()
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, dims = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            flat = np.floor(scale * flat)
            if len(flat) and np.abs(flat).max() >= 2.0**62:
                raise ValueError("a component is too large for 64-bit scores")
            vecs = np.split(flat.astype(np.int64), np.cumsum(dims)[:-1]) if len(dims) else []
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1), "dim": pa.array(dims, pa.int32()), "vec": pa.array([(x.astype(np.int32) if not len(x) or np.abs(x).max() < 2**31 else x).tobytes() for x in vecs], pa.binary())})

    return v.mapInArrow(run, "vec_id long, label long, dim int, vec binary").dropDuplicates()


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), dim).astype(np.float64)
    return np.array([np.frombuffer(r, np.int32 if len(r) == 4 * dim else np.int64) for r in rows], np.int64).reshape(len(rows), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b`` as 64-bit integers."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("components are too large for 64-bit scores")


def best(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` places of ``at`` with the highest scores, highest first, ties in the order of places."""
    v = s[at]
    if len(at) > k:
        least = np.partition(v, len(v) - k)[len(v) - k]
        above = at[v > least]
        at = np.concatenate([above, at[v == least][: k - len(above)]])
    return at[np.lexsort((at, -s[at]))]


def limits(positives: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Lowest and highest score of each positive's window, in hundredths ``low`` and ``high`` of its own."""
    return [(-(-low * p // 100), high * p // 100) for p in positives]


def slots(s: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Upper limit and the ``k`` best places of every slot that the windows' upper limits cut out."""
    open_windows = [(lo, hi) for lo, hi in windows if lo <= hi]
    if not open_windows:
        return
    uppers = sorted({hi for _, hi in open_windows})
    at = np.flatnonzero((s >= min(lo for lo, _ in open_windows)) & (s <= uppers[-1]))
    slot = np.searchsorted(uppers, s[at])
    for j, upper in enumerate(uppers):
        found = best(s, at[slot == j], k)
        if len(found):
            yield upper, found


def windows_from_slots(windows: list[tuple[int, int]], found: dict[int, list[tuple[int, int]]], k: int) -> list[list[tuple[int, int]]]:
    """For each window its ``k`` best (score, id), from the slots' best by upper limit.

    Slots are merged from the lowest limit upwards: what has been merged so far is the
    answer for every window that ends there.
    """
    below: list[tuple[int, int]] = []
    at: dict[int, list[tuple[int, int]]] = {}
    for upper in sorted({hi for lo, hi in windows if lo <= hi}):
        below = sorted(found.get(upper, []) + below, key=lambda x: (-x[0], x[1]))[:k]
        at[upper] = below
    return [[x for x in at.get(hi, []) if x[0] >= lo] if lo <= hi else [] for lo, hi in windows]


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, by_label: bool, tasks: int):
    """Rows and anchors cogrouped in a grid of blocks and parts."""
    nb = max(math.ceil(n_rows / BLOCK), min(tasks, math.ceil(n_rows / SMALL)))
    na = math.ceil(n_anchors / BLOCK)
    key = ["dim", *(["label"] if by_label else [])]
    # both sides' keys have one type: hashes of unequal types send equal numbers to different tasks
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    r = rows.withColumn("block", place(nb)).withColumn("part", upto(na))
    a = anchors.withColumn("part", place(na)).withColumn("block", upto(nb))
    return r.groupBy(*key, "block", "part").cogroup(a.groupBy(*key, "block", "part"))


_FOUND = "node long, slot long, vec_id long, score long"


def _compared(rows: pa.Table, anchors: pa.Table, pick) -> pa.Table:
    """``pick(anchor row, scores, labels)`` of (slot, places) for every anchor of a cell."""
    out: dict[str, list] = {"node": [], "slot": [], "vec_id": [], "score": []}
    if rows.num_rows and anchors.num_rows:
        rows = rows.sort_by("vec_id")
        dim = rows["dim"][0].as_py()
        x, ids, nodes, labels = _matrix(rows["vec"], dim), rows["vec_id"].to_numpy(), rows["node"].to_numpy(), rows["label"].to_numpy()
        step = max(1, SCORES // len(x))
        for i in range(0, anchors.num_rows, step):
            some = anchors.slice(i, step)
            table = scores(_matrix(some["vec"], dim), x)
            for s, anchor in zip(table, some.drop_columns(["vec"]).to_pylist(), strict=True):
                for slot, at in pick(anchor, s, labels, nodes):
                    for c, v in zip(out, ([anchor["node"]] * len(at), [slot] * len(at), ids[at].tolist(), s[at].tolist()), strict=True):
                        out[c] += v
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def hard_negatives(df: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
                   id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that ``is_anchor`` (of ``vec_id``) marks. A negative of a positive
    with score p has another label and a score from ``low`` to ``high`` hundredths of p; the
    first ``k`` are returned.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _whole_vectors(df, scale, id_col, label_col, vec_col).withColumn("node", F.monotonically_increasing_id())
    rows = written(rows, "whole-vectors")
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], result)

    def near(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return _compared(rows, anchors, lambda a, s, labels, nodes: [(0, best(s, np.flatnonzero(nodes != a["node"]), n_positives))])

    first = Window.partitionBy("node", "slot").orderBy(F.desc("score"), "vec_id")
    found = _cells(rows, anchors, n_rows, n_anchors, True, tasks).applyInArrow(near, _FOUND)
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= n_positives)
    found = found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("positives"))  # at most n_positives
    asked = written(anchors.join(found, "node"), "anchors")

    def below(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        def pick(a, s, labels, nodes):
            s = np.where(labels == a["label"], _NONE, s)
            return slots(s, limits([p["score"] for p in a["positives"]], low, high), k)

        return _compared(rows, anchors, pick)

    found = _cells(rows, asked, n_rows, n_anchors, False, tasks).applyInArrow(below, _FOUND)
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    found = found.groupBy("node").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("found"))  # at most k a slot
    whole = asked.join(found, "node").select("vec_id", "positives", "found")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a in batch.to_pylist():
                by_slot: dict[int, list[tuple[int, int]]] = {}
                for f in a["found"]:
                    by_slot.setdefault(f["slot"], []).append((f["score"], f["vec_id"]))
                answers = windows_from_slots(limits([p["score"] for p in a["positives"]], low, high), by_slot, k)
                out += [(a["vec_id"], p["vec_id"], r, i, p["score"], s) for p, answer in zip(a["positives"], answers, strict=True) for r, (s, i) in enumerate(answer, 1)]
            names = [c.split()[0] for c in result.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "rank" else pa.int64()) for c, v in zip(names, columns, strict=True)})

    return whole.mapInArrow(merge, result)
