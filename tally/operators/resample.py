"""Minority oversampling (E9, SMOTE) and its exact nearest-neighbour join.

Exact k-NN without an all-pairs product:
1. equal vectors become one vector with its k + 1 smallest ids, which is all an
   answer can hold; a bounded sample of the vectors is cut into cells by median
   splits (a k-d tree), and cells that hold too many vectors are cut again by a
   bounded sample of each, until none holds more than twice ``CELL``;
2. the k-th distance inside a vector's own cell bounds its true k-th distance;
3. the vector visits just the cells whose box (of the points in it) is not
   farther than that, distances there are exact, and the k nearest (ties by id)
   are kept. Boxes of the first cells, whose number is bounded, go to the tasks;
   boxes of cells cut later are joined with the vectors that visit the cell they
   were cut from.
A vector meets the points of its own and of neighbouring cells, so that the work
per point stays level as points are added (in few dimensions; in many, boxes
overlap and more cells have to be visited).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.exprs import seeded_key
from tally.operators.ordered import running_counts

SAMPLE = 20_000  # vectors that decide the first cuts, into at most a quarter as many cells
CELL = 1024  # points of a cell, about
FAN = 64  # cells that one cell is cut into at most in one pass
PICK = 64 * FAN  # vectors of a cell, about, that decide its cuts


def _cuts(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the cut of every inner node of a complete k-d tree (axis -1: nothing to cut)."""
    depth = max(0, (cells - 1).bit_length())
    axis, value = np.full(1 << depth, -1), np.zeros(1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        x = parts.pop(node)
        if len(x) > 1:
            spread = x.max(0) - x.min(0)
            j = int(spread.argmax())
            if spread[j] > 0:
                axis[node] = j
                value[node] = np.partition(x[:, j], len(x) // 2)[len(x) // 2]
                if value[node] == x[:, j].min():  # most are equal here: the others go to the right
                    value[node] = x[x[:, j] > value[node], j].min()
        right = x[:, axis[node]] >= value[node] if axis[node] >= 0 else np.zeros(len(x), bool)
        parts[2 * node], parts[2 * node + 1] = x[~right], x[right]
    return axis, value


def _cells(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(len(axis).bit_length() - 1):
        a = axis[node]
        node = 2 * node + ((a >= 0) & (x[np.arange(len(x)), a] >= value[node]))
    return node


def _dist2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, summed in feature order."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += np.square(x[:, j, None] - y[None, :, j])
    return out


def _matrix(column, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _cut_again(placed: DataFrame, dim: int, id_type: str, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cut every cell of more than 2 * ``CELL`` vectors by about ``PICK`` of its own, until there is none.

    Returns ``node, v, cell`` and, for every pass, ``parent, child, lo, hi``: the new cells' boxes.
    """
    def cut(t: pa.Table) -> pa.Table:
        size = t["n"][0].as_py()
        axis, value = _cuts(_matrix(t["v"], dim), min(FAN, size // CELL + 1))
        return pa.table({"cell": t["cell"][:1], "axis": pa.array([axis.tolist()], pa.list_(pa.int32())), "value": pa.array([value.tolist()])})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, parent = _matrix(batch.column("v"), dim), batch.column("cell").to_numpy()
            child = np.zeros(len(x), np.int64)
            for c, first in zip(*np.unique(parent, return_index=True), strict=True):
                own = parent == c
                axis, value = (np.array(batch.column(k)[int(first)].as_py()) for k in ("axis", "value"))
                child[own] = c * 2 * FAN + _cells(x[own], axis, value)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), pa.array(child), batch.column("cell")], ["node", "v", "cell", "parent"])

    parts, boxes, at = [], [], placed
    while True:
        sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CELL).checkpoint(eager=True)
        if sizes.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*parts, at.select("node", "v", "cell")]), boxes
        parts.append(at.select("node", "v", "cell").join(sizes, "cell", "left_anti"))
        full = at.select("node", "v", "cell").join(sizes, "cell")
        picked = full.where(F.pmod(F.xxhash64("v", F.lit(seed + len(parts))), F.col("n")) < PICK)
        cuts = picked.groupBy("cell").applyInArrow(cut, "cell long, axis array<int>, value array<double>").checkpoint(eager=True)
        at = full.join(cuts, "cell").mapInArrow(move, f"node {id_type}, v array<double>, cell long, parent long").checkpoint(eager=True)
        edge = lambda f: F.array(*[f(F.col("v")[j]) for j in range(dim)])
        boxes.append(at.groupBy("parent", F.col("cell").alias("child")).agg(edge(F.min).alias("lo"), edge(F.max).alias("hi")))


def nearest_in_cell(asks: pa.Table, there: pa.Table, dim: int, k: int) -> pa.Table:
    """``node, other, dist2``: the ``k`` nearest of ``there`` for every vector of ``asks`` that are not farther than its ``far``."""
    rows, others, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if asks.num_rows and there.num_rows:
        x, y = _matrix(asks["v"], dim), _matrix(there["v"], dim)
        far = asks["far"].to_numpy() * (1 + 1e-12)
        mine, names = np.array(asks["node"].to_pylist()), np.array(there["node"].to_pylist())
        for i in range(0, len(x), 256):
            d = _dist2(x[i:i + 256], y)
            row, at = np.nonzero(d <= far[i:i + 256, None])
            other = names[at] != mine[i + row]
            row, at = row[other], at[other]
            order = np.lexsort((names[at], d[row, at], row))
            row, at = row[order], at[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(i + row[first])
            others.append(at[first])
            dists.append(d[row[first], at[first]])
    rows, others = pa.array(np.concatenate(rows)), pa.array(np.concatenate(others))
    return pa.table({"node": asks["node"].take(rows), "other": there["node"].take(others), "dist2": pa.array(np.concatenate(dists))})


def knn(points: DataFrame, id_col: str, vec: str, dim: int, k: int = 5, seed: int = 0, stats: dict | None = None) -> DataFrame:
    """Exact k nearest neighbours (excluding self) -> (id, nn_rank 1..k, nn_id, dist2).

    Raises if there are not more than k points, as the library does. ``stats`` gets
    the numbers of cells and of visits of vectors to cells, and the size of the largest cell.
    """
    from tally.session import checkpoint_dir

    checkpoint_dir(points.sparkSession)
    p = points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    p = p.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 equals 0.0
    n = p.count()
    if n <= k:
        raise ValueError(f"{n} points are too few for {k} neighbours")
    ids = p.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r").checkpoint(eager=True)
    nodes = ids.groupBy("v").agg(F.min("id").alias("node"))
    some = _matrix(nodes.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(SAMPLE).toArrow()["v"], dim)
    axis, value = _cuts(some, int(min(SAMPLE // 4, nodes.count() // CELL + 1)))
    some = some[:CELL]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(_cells(_matrix(batch.column("v"), dim), axis, value)))

    id_type = points.schema[id_col].dataType.simpleString()
    first = nodes.select("node", "v").mapInArrow(place, f"node {id_type}, v array<double>, cell long").checkpoint(eager=True)
    placed, later = _cut_again(first, dim, id_type, seed)

    def reach(t: pa.Table) -> pa.Table:
        x = _matrix(t["v"], dim)
        far = np.full(len(x), np.inf)
        y = x if len(x) > k else some  # any k + 1 vectors give a bound
        if len(y) > k:
            for i in range(0, len(x), 256):
                far[i:i + 256] = np.partition(_dist2(x[i:i + 256], y), k, axis=1)[:, k]
        return t.append_column("far", pa.array(far))

    known = placed.groupBy("cell").applyInArrow(reach, f"node {id_type}, v array<double>, cell long, far double").checkpoint(eager=True)
    edges = [f(F.col("v")[j]).alias(f"{c}{j}") for j in range(dim) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    boxes = first.groupBy("cell").agg(*edges).toArrow()  # at most SAMPLE / 2 rows
    cells = boxes["cell"].to_numpy()
    lo, hi = (np.stack([boxes[f"{c}{j}"].to_numpy() for j in range(dim)], 1) for c in ("lo", "hi"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column("v"), dim)
                gap = np.zeros((len(x), len(cells)))
                for j in range(dim):
                    gap += np.square(np.maximum(0, np.maximum(lo[None, :, j] - x[:, j, None], x[:, j, None] - hi[None, :, j])))
                row, at = np.nonzero(gap <= part.column("far").to_numpy()[:, None] * (1 + 1e-12))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("node", "v", "far")), pa.array(cells[at])], ["node", "v", "far", "cell"])

    visits = known.select("node", "v", "cell", "far").mapInArrow(visit, f"node {id_type}, v array<double>, far double, cell long")
    below = F.zip_with("v", "lo", lambda x, e: e - x)
    above = F.zip_with("v", "hi", lambda x, e: x - e)
    gap = F.aggregate(F.zip_with(below, above, lambda b, a: F.greatest(b, a, F.lit(0.0))), F.lit(0.0), lambda t, g: t + g * g)
    for box in later:
        met = visits.join(box, F.col("cell") == F.col("parent"), "left").where(F.col("parent").isNull() | (gap <= F.col("far") * (1 + 1e-12)))
        visits = met.select("node", "v", "far", F.coalesce("child", "cell").alias("cell"))
    if stats is not None:
        sizes = placed.groupBy("cell").count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
        stats.update(cells=sizes[0], visits=visits.count(), points=sizes[1], largest=sizes[2])

    def nearest(asks: pa.Table, there: pa.Table) -> pa.Table:
        return nearest_in_cell(asks, there, dim, k)

    found = visits.groupBy("cell").cogroup(placed.select(F.col("cell").alias("of"), "node", "v").groupBy("of")).applyInArrow(
        nearest, f"node {id_type}, other {id_type}, dist2 double")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("dist2", "other"))).where(F.col("_r") <= k)
    own = nodes.select("node", F.col("node").alias("other"), F.lit(0.0).alias("dist2"))  # copies of the vector itself
    members = ids.join(nodes, "v").select(F.col("node").alias("other"), F.col("id").alias("nn_id"))
    near = best.select("node", "other", "dist2").unionByName(own).join(members, "other").select("node", "nn_id", "dist2")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("dist2", "nn_id"))).where(F.col("_r") <= k + 1)
    asked = p.join(nodes, "v").select("id", "node")
    top = asked.join(near, "node").where(F.col("nn_id") != F.col("id"))
    top = top.withColumn("nn_rank", F.row_number().over(Window.partitionBy("id").orderBy("dist2", "nn_id")))
    return top.where(F.col("nn_rank") <= k).select("id", "nn_rank", "nn_id", "dist2")


def smote(train: DataFrame, label: str, id_col: str, feature_cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Oversample the minority class of ``train`` to parity.

    Synthetic row j of base point b: neighbour = one of b's k nearest minority
    neighbours and gap in [0, 1), both drawn from md5(seed, id, j) — results do
    not depend on partitioning. Base points are used round-robin, so every
    minority point seeds floor(need / n_min) or one more rows. Returns
    ``train`` plus the synthetic rows (id NULL, column ``synthetic`` = true).
    """
    dim = len(feature_cols)
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    c = counts.select(F.struct(F.min_by(label, "n").alias("minor"), F.min("n").alias("n_min"),
                               F.max("n").alias("n_max"))).scalar()
    minor = train.where(F.col(label) == c.getField("minor"))
    pts = minor.select(F.col(id_col).alias("id"), F.array(*[F.col(x).cast("double") for x in feature_cols]).alias("v"))
    nn = knn(pts.withColumnRenamed("id", id_col), id_col, "v", dim, k, seed)
    need = c.getField("n_max") - c.getField("n_min")
    ranked = running_counts(pts.withColumn("_key", seeded_key(seed, "id")).withColumn("_one", F.lit(1)), [],
                            "_key", ["_one"]).select("id", "v", F.col("cum__one").alias("rk"))
    per = F.floor(need / c.getField("n_min")) + F.when(F.col("rk") <= need % c.getField("n_min"), 1).otherwise(0)
    gen = ranked.withColumn("j", F.explode(F.sequence(F.lit(1), F.greatest(per.cast("int"), F.lit(0)))))
    gen = gen.where(per > 0)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("j").cast("string")))
    gen = gen.withColumns({
        "nn_rank": (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % k + 1).cast("int"),
        "gap": F.conv(F.substring(h, 9, 13), 16, 10).cast("double") / F.lit(float(16 ** 13)),
    })
    gen = gen.join(nn.select("id", "nn_rank", "nn_id"), ["id", "nn_rank"]).join(
        pts.select(F.col("id").alias("nn_id"), F.col("v").alias("w")), "nn_id")
    new = F.zip_with("v", "w", lambda a, b: a + F.col("gap") * (b - a))
    syn = gen.select(F.col("id").alias("base_id"), "nn_id", "gap", new.alias("x"))
    out_syn = syn.select(F.lit(None).cast(train.schema[id_col].dataType).alias(id_col),
                         *[F.col("x")[i].alias(x) for i, x in enumerate(feature_cols)],
                         c.getField("minor").alias(label), F.lit(True).alias("synthetic"),
                         "base_id", "nn_id", "gap")
    base = train.select(id_col, *feature_cols, label).withColumns({
        "synthetic": F.lit(False), "base_id": F.lit(None).cast("long"), "nn_id": F.lit(None).cast("long"),
        "gap": F.lit(None).cast("double")})
    base = base.withColumns({x: F.col(x).cast("double") for x in feature_cols})
    return base.unionByName(out_syn)
