"""Regularised linear and kernel models by Newton steps, many fits in one pass.

A fit minimises ``w'Rw / 2 + C * sum(c_i * loss(y_i, w'x_i))`` with class weights c and the
unit matrix R, whose entry of the intercept is 1 (``penalised``: the logistic regression of
the reference's solver) or 0. Each step needs the gradient and the Gram matrix of the
weighted rows, which are sums over rows: all fits of a call (draws of a search x folds)
get theirs from one pass over blocks of rows, added up in a tree, and only matrices of
features x features reach the driver. Folds are masks on the same blocks. A step that
doesn't lower the objective enough is halved; the pass that takes a step also gives the
objective along it, so that a halved step costs one more pass.

* ``logistic``: log loss. With ``targets="smoothed"`` the labels are replaced by
  (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), as sigmoid calibration does (L5).
* ``hinge``: the hinge with a rounded corner, narrowed to ``WIDTH`` in steps; what it
  differs from the hinge by is at most ``WIDTH / 2`` a row.

A kernel is a Nystroem map: kernel values with bounded many landmark rows (the first in a
seeded order), whitened by the Cholesky factor of the landmarks' own kernel matrix, so that
inner products of mapped rows are the kernel projected on the landmarks. With all rows as
landmarks it is the kernel itself.

If the table is one block, or up to ``WHOLE`` for many fits, each task runs whole fits on it
by the same code.
"""

from __future__ import annotations

import io
import itertools
import math
import uuid
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.exprs import seeded_key, sigmoid
from tally.session import checkpoint_dir

BLOCK = 1 << 14  # rows
WHOLE = 8  # blocks on which a task runs whole fits, if there are as many fits as cores: no Gram matrices are exchanged
MAX_DIM = 4096  # features of a Gram matrix
LANDMARKS = 256
WIDTH = 1e-3  # of the hinge's rounded corner, in the end
STEPS = 0.5 ** np.arange(12)
RIDGE = 1e-10


@dataclass(frozen=True)
class Kernel:
    """A kernel and its landmarks: ``rbf`` exp(-gamma |x-z|^2) or ``poly`` (gamma x'z)^degree."""

    name: str
    gamma: float
    degree: int
    landmarks: tuple[tuple[float, ...], ...]

    def values(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        if self.name == "rbf":
            apart = (x * x).sum(1)[:, None] + (z * z).sum(1) - 2 * x @ z.T
            return np.exp(-self.gamma * np.maximum(apart, 0))
        if self.name == "poly":
            return (self.gamma * (x @ z.T)) ** self.degree
        raise ValueError(f"unknown kernel {self.name!r}")

    def whitening(self) -> np.ndarray:
        """What kernel values with the landmarks are multiplied by."""
        z = np.array(self.landmarks)
        own = self.values(z, z)
        factor = np.linalg.cholesky(own + 1e-9 * max(1.0, float(np.trace(own)) / len(z)) * np.eye(len(z)))
        return np.linalg.solve(factor, np.eye(len(z))).T

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return self.values(x, np.array(self.landmarks)) @ self.whitening()


@dataclass(frozen=True)
class LinearSpec:
    """Settings of one fit."""

    loss: str = "logistic"
    C: float = 1.0
    weights: str = "balanced"  # class weights: "balanced" n/2n_c or "none"
    targets: str = "labels"  # or "smoothed"
    penalised: bool = True  # the intercept counts in the penalty
    penalty: float = 1.0  # 0: none at all
    kernel: Kernel | None = None
    held_out: int | None = None  # fold left out, by which the fit is judged
    only: int | None = None  # the one fold that it sees
    max_iter: int = 100  # steps at a width
    tolerance: float = 1e-12  # of the decrease that a last step promises, relative to the objective


@dataclass
class Ask:
    """Weights to look at, where they come from and the direction, and the corner's width."""

    weights: np.ndarray
    origin: np.ndarray
    direction: np.ndarray
    width: float


@dataclass
class Sums:
    """Losses at the origin and at steps along the direction; gradient and Gram matrix at the weights; rows judged."""

    losses: np.ndarray
    gradient: np.ndarray
    gram: np.ndarray
    judged: np.ndarray  # n, tp, fp, fn

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.losses + other.losses, self.gradient + other.gradient, self.gram + other.gram, self.judged + other.judged)


def losses(spec: LinearSpec, z: np.ndarray, t: np.ndarray, width: float) -> np.ndarray:
    """Loss of scores ``z`` with targets ``t`` in 0..1 (of the hinge: 0 or 1)."""
    if spec.loss == "logistic":
        return np.maximum(z, 0) - t * z + np.log1p(np.exp(-np.abs(z)))
    short = 1 - (2 * t - 1) * z
    inside = np.clip(short, 0, width)
    return inside * (short - inside / 2) / width


def slopes(spec: LinearSpec, z: np.ndarray, t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the score."""
    if spec.loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return p - t, p * (1 - p)
    sign = 2 * t - 1
    short = 1 - sign * z
    inside = (short > 0) & (short < width)
    return -sign * np.clip(short / width, 0, 1), inside / width


def newton(spec: LinearSpec, dim: int) -> Generator[Ask, Sums, tuple[np.ndarray, np.ndarray]]:
    """Weights (the intercept last) and how the judged rows do."""
    w = np.zeros(dim + 1)
    r = np.full(dim + 1, spec.penalty)
    r[-1] *= spec.penalised
    # the first corner is wider than all rows' shortfall at weights of zero, so that every row counts in the Gram matrix
    widths = [1.0] if spec.loss == "logistic" else list(np.geomspace(2.0, WIDTH, 6))
    judged = np.zeros(4)
    for width in widths:
        s = yield Ask(w, w, np.zeros(dim + 1), width)
        for _ in range(spec.max_iter):
            judged = s.judged
            g = r * w + spec.C * s.gradient
            h = np.diag(r) + spec.C * s.gram
            h[np.diag_indices(dim + 1)] += RIDGE * max(1.0, np.trace(h) / (dim + 1))
            d = -np.linalg.solve(h, g)
            promised = -float(g @ d)
            value = float(r @ (w * w)) / 2 + spec.C * float(s.losses[0])
            least = spec.tolerance if width == widths[-1] else 1e-5
            if promised <= least * max(1.0, abs(value)):
                w = w + d  # no step could be told from rounding; the full one is closer
                break
            s = yield Ask(w + d, w, d, width)
            along = (((w + STEPS[:, None] * d) ** 2) @ r) / 2 + spec.C * s.losses[1:]
            good = np.flatnonzero(along <= value - 1e-4 * STEPS * promised)
            if not len(good):
                break  # as low as sums of doubles can tell
            step = STEPS[good[0]]
            w = w + step * d
            if step < 1 or True in np.isnan(s.gradient):
                s = yield Ask(w, w, np.zeros(dim + 1), width)
            else:
                s = Sums(np.concatenate([s.losses[1:2], s.losses[1:]]), s.gradient, s.gram, s.judged)
    return w, judged


@dataclass
class Totals:
    """Rows and positives of each fold."""

    folds: dict[int, tuple[int, int]]
    n_features: int

    def of(self, spec: LinearSpec) -> tuple[int, int]:
        """Negatives and positives that a fit sees: the total less the fold left out, or one fold."""
        if spec.only is not None:
            n, p = self.folds.get(spec.only, (0, 0))
            return n - p, p
        n, p = (sum(f[i] for f in self.folds.values()) for i in (0, 1))
        less = self.folds.get(spec.held_out, (0, 0)) if spec.held_out is not None else (0, 0)
        return n - less[0] - (p - less[1]), p - less[1]

    def dim(self, spec: LinearSpec) -> int:
        return len(spec.kernel.landmarks) if spec.kernel else self.n_features


class Block:
    """Rows of one block, and their kernel values.

    A score is a kernel row times the whitened weights, so that only the rows of a Gram matrix are whitened themselves.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, key: np.ndarray | None = None):
        self.x, self.y, self.fold, self.key = x, y, fold, key  # key: a hash of the row's id
        self.cache: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def features(self, kernel: Kernel | None) -> np.ndarray:
        """Mapped rows, and a one for the intercept."""
        return np.hstack([kernel.mapped(self.x) if kernel else self.x, np.ones((len(self.y), 1))])

    def values(self, kernel: Kernel | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Columns of the rows (kernel values, or features) and the matrix that whitens them, if any."""
        if kernel not in self.cache:
            self.cache = {kernel: (kernel.values(self.x, np.array(kernel.landmarks)), kernel.whitening()) if kernel else (self.x, None)}
        return self.cache[kernel]

    def sums(self, spec: LinearSpec, totals: Totals, ask: Ask) -> Sums:
        return self.many([(spec, ask)], totals)[0]

    def many(self, asks: list[tuple[LinearSpec, Ask]], totals: Totals) -> list[Sums]:
        """The sums of several fits of one kernel, whose scores and gradients are one matrix product each."""
        (f, white), y = self.values(asks[0][0].kernel), self.y
        ends = np.stack([w for _, ask in asks for w in (ask.origin, ask.direction, ask.weights - (ask.origin + ask.direction))])
        some = ends.any(1)  # most weights are where the whole step leads, and first steps lead nowhere
        straight = ends[some, :-1] if white is None else ends[some, :-1] @ white.T
        scores = np.zeros((3 * len(asks), len(y)))
        scores[some] = straight @ f.T + ends[some, -1:]
        scores = scores.reshape(len(asks), 3, -1)
        slope = np.zeros((len(asks), len(y)))
        parts = []
        for i, (spec, ask) in enumerate(asks):
            seen = np.ones(len(y), bool) if spec.held_out is None else self.fold != spec.held_out
            if spec.only is not None:
                seen = self.fold == spec.only
            rows = np.flatnonzero(seen)
            neg, pos = totals.of(spec)
            high, low = ((pos + 1) / (pos + 2), 1 / (neg + 2)) if spec.targets == "smoothed" else (1.0, 0.0)
            c = np.where(y == 1, (neg + pos) / (2 * max(pos, 1)), (neg + pos) / (2 * max(neg, 1))) if spec.weights == "balanced" else np.ones(len(y))
            t, c, start, along = np.where(y == 1, high, low)[rows], c[rows], scores[i][0, rows], scores[i][1, rows]
            here = float(c @ losses(spec, start, t, ask.width))
            at = [here, *(float(c @ losses(spec, start + s * along, t, ask.width)) if ask.direction.any() else here for s in STEPS)]
            z = scores[i].sum(0)
            first, second = slopes(spec, z[rows], t, ask.width)
            judge = ~seen if spec.held_out is not None else np.zeros(len(y), bool)
            hit, real = z[judge] > 0, y[judge] == 1
            judged = np.array([judge.sum(), (hit & real).sum(), (hit & ~real).sum(), (~hit & real).sum()], float)
            curved = second > 0  # of the hinge, only the rows in the corner
            some = f[rows[curved]]
            some = np.hstack([some if white is None else some @ white, np.ones((len(some), 1))])
            slope[i, rows] = c * first
            parts.append((np.array(at), c @ first, (some * (c * second)[curved, None]).T @ some, judged))
        slope = slope @ f
        if white is not None:
            slope = slope @ white
        return [Sums(at, np.append(g, last), gram, judged) for g, (at, last, gram, judged) in zip(slope, parts, strict=True)]


@dataclass
class Data:
    """Rows in written blocks."""

    spark: SparkSession
    columns: list[str]
    totals: Totals
    path: str
    n_blocks: int

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def prepare(df: DataFrame, columns: list[str], label: str = "y", id_col: str = "id", fold: str | None = None) -> Data:
    """Write the rows of ``df`` in blocks; NULL features or labels raise."""
    spark = df.sparkSession
    fold_col = (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold")
    rows = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"), fold_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, fold, key, n = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            raw = io.BytesIO()
            np.savez(raw, x=np.concatenate(x), y=np.concatenate(y), fold=np.concatenate(fold), key=np.concatenate(key))
            return pa.RecordBatch.from_pydict({"block": pa.array([raw.getvalue()], pa.binary())})

        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            labels = batch.column("y").to_numpy(zero_copy_only=False)
            if np.isnan(values).any() or np.isnan(labels).any():
                raise ValueError("features and labels must not be NULL or NaN")
            for a in range(0, batch.num_rows, BLOCK):
                s = slice(a, a + BLOCK)
                if n and n + len(labels[s]) > BLOCK:
                    yield out()
                    x, y, fold, key, n = [], [], [], [], 0
                x, y, fold, n = [*x, values[s]], [*y, labels[s]], [*fold, batch.column("fold").to_numpy()[s]], n + len(labels[s])
                key = [*key, batch.column("key").to_numpy().view(np.uint64)[s]]
        if n:
            yield out()

    counts = df.groupBy(fold_col).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).collect()
    n = sum(r.n for r in counts)
    path = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(n / BLOCK * (1.1 if n > BLOCK else 1)))
    rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(pack, "block binary").write.parquet(path)
    return Data(spark, list(columns), Totals({r.fold: (r.n, r.p) for r in counts}, len(columns)), path, spark.read.parquet(path).count())


def landmarks(df: DataFrame, columns: list[str], n: int = LANDMARKS, id_col: str = "id", seed: int = 42) -> tuple[tuple[float, ...], ...]:
    """The ``n`` different rows that come first in a seeded order of ids (all, if fewer)."""
    x = df.select(seeded_key(seed, id_col).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names = [f"x{i}" for i in range(len(columns))]
    first = x.groupBy(*names).agg(F.min("k").alias("k")).orderBy("k").limit(n)
    return tuple(tuple(r[c] for c in names) for r in first.collect())


def gamma_of(df: DataFrame, columns: list[str], gamma: float | str = "scale") -> float:
    """Kernel width: 'scale' is 1 / (features * variance of all values), 'auto' 1 / features."""
    if gamma == "auto":
        return 1.0 / len(columns)
    if gamma == "scale":
        values = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
        var = values.agg(F.var_pop("v")).first()[0]
        return 1.0 / (len(columns) * var) if var else 1.0
    return float(gamma)


@dataclass
class LinearModel:
    """Weights of the (mapped) features and the intercept."""

    spec: LinearSpec
    columns: list[str]
    weights: np.ndarray
    intercept: float
    judged: dict = field(default_factory=dict)

    @property
    def f1(self) -> float:
        tp, fp, fn = (self.judged.get(k, 0) for k in ("tp", "fp", "fn"))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    def margins(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``score``, the decision value."""
        if self.spec.kernel is None:
            z = F.lit(float(self.intercept))
            for c, w in zip(self.columns, self.weights, strict=True):
                z = z + F.col(c).cast("double") * F.lit(float(w))
            return df.select(*keep, z.alias("score"))
        rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in self.columns]).alias("_x"))
        kernel, b, n = self.spec.kernel, self.intercept, len(self.columns)
        marks, straight = np.array(kernel.landmarks), kernel.whitening() @ self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
                z = kernel.values(x, marks) @ straight + b if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(z, pa.float64())], [*keep, "score"])

        return rows.mapInArrow(run, rows.select(*keep, F.lit(0.0).alias("score")).schema)

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``score``: probability of class 1 (logistic) or decision value (hinge)."""
        out = self.margins(df, keep)
        return out.withColumn("score", sigmoid("score")) if self.spec.loss == "logistic" else out


    def save(self, spark: SparkSession, path: str) -> None:
        """Two Parquet tables: weights by position (the intercept last), and settings with the kernel."""
        names = [*(self.columns if self.spec.kernel is None else [f"landmark {i}" for i in range(len(self.weights))]), "intercept"]
        rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip(names, [*self.weights, self.intercept], strict=True))]
        spark.createDataFrame(rows, "position int, feature string, weight double").write.mode("overwrite").parquet(f"{path}/weights")
        k = self.spec.kernel
        kernel = None if k is None else (k.name, float(k.gamma), int(k.degree), [list(map(float, z)) for z in k.landmarks])
        spark.createDataFrame([(self.spec.loss, self.columns, kernel)], "loss string, columns array<string>, kernel struct<name:string,gamma:double,degree:int,landmarks:array<array<double>>>") \
            .write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> LinearModel:
    """A model that ``LinearModel.save`` wrote, to predict with (of its settings only the loss and the kernel)."""
    s = spark.read.parquet(f"{path}/settings").first()
    w = [r.weight for r in spark.read.parquet(f"{path}/weights").orderBy("position").collect()]
    kernel = s.kernel and Kernel(s.kernel.name, s.kernel.gamma, s.kernel.degree, tuple(map(tuple, s.kernel.landmarks)))
    return LinearModel(LinearSpec(loss=s.loss, kernel=kernel), list(s.columns), np.array(w[:-1]), w[-1])


def fit_many(data: Data, specs: list[LinearSpec]) -> list[LinearModel]:
    """Fit all settings at once; the models in their order."""
    sc, totals = data.spark.sparkContext, data.totals
    if any(totals.dim(s) > MAX_DIM for s in specs):
        raise ValueError(f"more than {MAX_DIM} features")
    if data.n_blocks == 1 or data.n_blocks <= WHOLE and len(specs) >= sc.defaultParallelism:
        raw = sc.broadcast([bytes(r["block"]) for r in data.blocks().collect()])  # at most WHOLE * BLOCK rows

        def whole(items: list[tuple[int, LinearSpec]]):
            blocks = [_block(r) for r in raw.value]
            for _, some in itertools.groupby(items, lambda x: x[1].kernel):  # fits of one kernel go step by step together
                fits = dict(some)
                steps = {i: newton(s, totals.dim(s)) for i, s in fits.items()}
                asks = {i: next(s) for i, s in steps.items()}
                while asks:
                    total: list[Sums] = []
                    for b in blocks:
                        got = b.many([(fits[i], a) for i, a in asks.items()], totals)
                        total = [s + t for s, t in zip(total, got, strict=True)] if total else got
                        if len(blocks) > 1:  # kernel values of one block at a time
                            b.cache = {}
                    for i, s in zip(list(asks), total, strict=True):
                        try:
                            asks[i] = steps[i].send(s)
                        except StopIteration as done:
                            yield i, done.value
                            del asks[i]

        tasks = min(len(specs), 2 * sc.defaultParallelism)
        order = sorted(range(len(specs)), key=lambda i: (specs[i].kernel is not None, hash(specs[i].kernel)))
        dealt = [[(i, specs[i]) for i in order[t * len(order) // tasks: (t + 1) * len(order) // tasks]] for t in range(tasks)]
        found = dict(sc.parallelize(dealt, tasks).flatMap(whole).collect()) if specs else {}
        raw.unpersist()
    else:
        found = _in_passes(data, specs, sc)
    return [LinearModel(s, data.columns, found[i][0][:-1], float(found[i][0][-1]), dict(zip(("n", "tp", "fp", "fn"), found[i][1].tolist()))) for i, s in enumerate(specs)]


def _block(raw: bytes) -> Block:
    return Block(**np.load(io.BytesIO(raw)))


def _in_passes(data: Data, specs: list[LinearSpec], sc) -> dict[int, tuple]:
    totals = data.totals
    steps = {i: newton(s, totals.dim(s)) for i, s in enumerate(specs)}
    asks = {i: next(s) for i, s in steps.items()}
    blocks = data.blocks().select("block").rdd.map(lambda r: _block(bytes(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)
    found: dict[int, tuple] = {}
    while asks:
        sent = sc.broadcast({i: (specs[i], a) for i, a in asks.items()})

        def sums(some: Iterator[Block], sent=sent):
            total: dict[int, Sums] = {}
            alike: dict[Kernel | None, list[int]] = {}
            for i, (spec, _) in sent.value.items():
                alike.setdefault(spec.kernel, []).append(i)
            for b in some:
                for fits in alike.values():
                    for i, s in zip(fits, b.many([sent.value[i] for i in fits], totals), strict=True):
                        total[i] = total[i] + s if i in total else s
            yield from total.items()

        replies = dict(blocks.mapPartitions(sums).reduceByKey(lambda a, b: a + b, min(len(asks), sc.defaultParallelism)).collect())
        for i, s in replies.items():
            try:
                asks[i] = steps[i].send(s)
            except StopIteration as done:
                found[i] = done.value
                del asks[i]
        sent.unpersist()
    blocks.unpersist()
    return found
