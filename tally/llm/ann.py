"""Approximate nearest neighbours by multiprobe p-stable hashing, nearest by inner product.

Vectors are lengthened by one coordinate so that the largest inner product becomes the
least Euclidean distance. Norms are scaled within bands of half an octave, each by its own
largest norm, and every band has buckets of its own, all of which are searched; one long
vector changes nothing for the others. In bands above the one that holds the median norm a
vector can be among the nearest at a wider angle, so that as many times more buckets are
visited there as the band's norms are larger (up to all within one step). Each of
``tables`` tables hashes a vector by ``hashes`` Gaussian projections cut into cells of
width ``width``. A query visits its own bucket and buckets whose cells differ by one step
in some projections, in the order of their estimated success (the sum of squared distances
to the crossed cell borders), ``probes`` buckets a table. All rows of the visited buckets
are candidates, none is dropped; the candidates of all tables are merged and ranked by
their exact inner product in double precision. Queries that found fewer than k rows are
compared with all vectors of their length, block by block.

Equal vectors are searched once, and each stands for its ``k + 1`` smallest ids, which is
all that any answer can hold. Buckets are gathered into groups by table and a hash of the
bucket; a group with more than ``group_rows`` vectors is split by vector and its queries
visit every part, so that no task holds a hot bucket whole.

Vectors that are null, empty, all zero or hold a null or non-finite component take no
part, neither do null ids; vectors of different lengths are never compared (each length has
tables of its own). Several rows
of one id are separate rows. Ties go to the smaller id. Other input columns are ignored;
an empty table gives an empty result; fewer than k other rows of a length give fewer rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import mix, written

TABLES, HASHES, WIDTH, PROBES = 12, 7, 1.5, 160
GROUP_ROWS = 1 << 16
SCAN_QUERIES = 1 << 12  # queries that one task of the exact scan holds
MAX_BANDS = 100_000  # of all vector lengths; their norms are held by the driver
SEED = 3
_U = np.uint64


class Hashes:
    """Projections and offsets of all tables for vectors of one length, scaled by ``norm`` (of all or of each vector)."""

    def __init__(self, dim: int, norm: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES):
        rng = np.random.default_rng([SEED, dim])
        self.a = rng.normal(size=(tables, dim + 1, hashes))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.dim, self.norm, self.width, self.probes = dim, norm, width, probes
        steps = np.array(list(itertools.product((0, -1, 1), repeat=hashes)))
        self.steps = steps
        self.pick = np.zeros((hashes, 3, len(steps)))  # which border each set of steps crosses
        for i in range(hashes):
            self.pick[i, steps[:, i] % 3, np.arange(len(steps))] = 1

    def places(self, x: np.ndarray, query: bool, norm: np.ndarray | None = None) -> np.ndarray:
        """Positions in cells: tables x vectors x hashes."""
        x = x / (np.abs(x).max(1, keepdims=True) if query else self.norm if norm is None else norm[:, None])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        y = np.hstack([x / size, np.zeros_like(size)]) if query else np.hstack([x, np.sqrt(np.maximum(0, 1 - size**2))])
        return (np.einsum("nd,tdk->tnk", y, self.a) + self.b[:, None]) / self.width

    def buckets(self, cells: np.ndarray, table: int) -> np.ndarray:
        h = np.full(cells.shape[:-1], table * 1000003 + self.dim, _U)
        for i in range(cells.shape[-1]):
            h = mix(h * _U(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(_U))
        return h.view(np.int64)

    def visited(self, places: np.ndarray, table: int) -> np.ndarray:
        """Buckets of one table that each query visits, best first."""
        cell = np.floor(places)
        part = places - cell
        cost = np.stack([np.zeros_like(part), (1 - part) ** 2, part**2], 2)  # steps 0, +1, -1
        total = np.einsum("nks,ksp->np", cost, self.pick)
        order = np.argsort(total, axis=1, kind="stable")[:, : self.probes]
        return self.buckets(cell[:, None, :] + self.steps[order], table)


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec`` (doubles as bytes) of the rows that take part, and their length and norm."""
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x) + 0.0 for x in batch.column(1).to_pylist()]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "vec": pa.array([x.tobytes() for x in rows], pa.binary()), "dim": pa.array([len(x) for x in rows], pa.int32()), "norm": pa.array([float((m := np.abs(x).max()) * np.linalg.norm(x / m)) for x in rows], pa.float64())})

    return v.mapInArrow(run, "vec_id long, vec binary, dim int, norm double").withColumn("band", F.floor(F.log2("norm") * 2 + 0.5).cast("int"))


def _probes(bands: list) -> dict[int, dict[int, tuple[float, int]]]:
    """Largest norm and number of buckets to visit by length and band, from rows of length, band, largest norm and count."""
    out: dict[int, dict[int, tuple[float, int]]] = {}
    for dim, group in itertools.groupby(sorted(bands), key=lambda r: r[0]):
        rows = list(group)
        upto = np.cumsum([n for *_, n in rows])
        median = rows[int(np.searchsorted(upto, (upto[-1] + 1) // 2))][2]
        out[dim] = {b: (norm, math.ceil(min(3**HASHES, PROBES * max(1.0, norm / median)))) for _, b, norm, _ in rows}
    return out


def _best(x: np.ndarray, q: np.ndarray, least: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k + 1`` nearest of the rows ``at``."""
    s = x[at] @ q
    if len(at) > 2 * k + 2:  # all that can be among the k + 1 best, ties included
        least_score = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
        at = at[s >= least_score - 1e-9 * max(1.0, abs(least_score))]
    s = (x[at] * q).sum(1)
    best = np.lexsort((least[at], -s))[: k + 1]
    return at[best], s[best]


_FOUND = ("query", pa.string()), ("node", pa.string()), ("least", pa.int64()), ("score", pa.float64())


def _scanned(nodes: DataFrame, short: DataFrame, k: int, blocks: int) -> DataFrame:
    """The ``k + 1`` nearest of each block of all vectors of a query's length, for the queries ``short``."""
    n_parts = short.count() // SCAN_QUERIES + 1
    rows = nodes.select("dim", "node", "vec", "least", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    asks = short.select(F.col("dim").alias("d"), F.col("node").alias("query"), F.col("vec").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("node"), F.lit(n_parts)).cast("int").alias("p"))

    def scan(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c, _ in _FOUND}
        if rows.num_rows and asks.num_rows:
            x, least, names = _matrix(rows["vec"]), rows["least"].to_numpy(), np.array(rows["node"].to_pylist())
            for name, vec in zip(asks["query"].to_pylist(), asks["asked"].to_pylist(), strict=True):
                at, s = _best(x, np.frombuffer(vec, np.float64), least, np.arange(len(x)), k)
                for c, v in zip(found, ([name] * len(at), names[at].tolist(), least[at].tolist(), s.tolist()), strict=True):
                    found[c] += v
        return pa.table({c: pa.array(found[c], t) for c, t in _FOUND})

    both = rows.groupBy("dim", "block", "part").cogroup(asks.groupBy("d", "b", "p"))
    return both.applyInArrow(scan, "query string, node string, least long, score double")


def neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows found for every row that ``is_query`` (of ``vec_id``) marks."""
    rows = written(_vectors(df, id_col, vec_col), "vectors")
    bands = [tuple(r) for r in rows.groupBy("dim", "band").agg(F.max("norm"), F.count("*")).limit(MAX_BANDS).collect()]
    if not bands:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", "norm").toDF("query_id", "rank", "vec_id", "score").limit(0)
    if len(bands) == MAX_BANDS:
        raise ValueError("too many vector lengths and bands of norm")
    visits = _probes(bands)
    # equal vectors: the k + 1 smallest ids of each, and one search for all its queries
    by_vec = Window.partitionBy("vec").orderBy("vec_id")
    ids = written(rows.select("vec", "dim", "band", "vec_id").withColumn("r", F.row_number().over(by_vec)).filter(F.col("r") <= k + 1).drop("r").withColumn("node", F.md5("vec")), "vector-ids")
    nodes = ids.groupBy("node").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.first("band").alias("band"), F.min("vec_id").alias("least"))
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.md5("vec").alias("node"))
    queries = asked.select("node").distinct().join(nodes, "node").select("node", "vec", "dim")

    def hashes(dim: int, cache: dict = {}) -> Hashes:  # noqa: B006
        if dim not in cache:
            cache[dim] = Hashes(dim, 1.0, probes=max(n for _, n in visits[dim].values()))
        return cache[dim]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                h = hashes(dim)
                norm = np.array([visits[dim][b][0] for b in part["band"].to_pylist()])
                for t, places in enumerate(h.places(_matrix(part["vec"]), False, norm)):
                    yield pa.RecordBatch.from_pydict({**{c: part[c] for c in ("node", "vec", "least", "band")}, "tab": pa.array(np.full(part.num_rows, dim * TABLES + t, np.int32)), "bucket": pa.array(h.buckets(np.floor(places), t))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                whole = batch.filter(pa.array(dims == dim))
                for at in range(0, whole.num_rows, 256):
                    part = whole.slice(at, 256)
                    h = hashes(dim)
                    for t, places in enumerate(h.places(_matrix(part["vec"]), True)):
                        visit = h.visited(places, t)
                        for band, (_, n) in visits[dim].items():
                            yield pa.RecordBatch.from_pydict({"node": part["node"], "vec": part["vec"], "tab": pa.array(np.full(len(visit), dim * TABLES + t, np.int32)), "band": pa.array(np.full(len(visit), band, np.int32)), "visit": pa.array(list(visit[:, :n]), pa.list_(pa.int64()))})

    placed = nodes.select("node", "vec", "least", "dim", "band").mapInArrow(index, "node string, vec binary, least long, band int, tab int, bucket long")
    size = ids.select("node").distinct().count()
    n_groups = size // group_rows + 1  # of each table
    placed = placed.withColumn("grp", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)))
    parts = placed.groupBy("tab", "band", "grp").agg(F.ceil(F.count("*") / group_rows).alias("parts"))
    placed = placed.join(parts, ["tab", "band", "grp"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    asks = queries.mapInArrow(probe, "node string, vec binary, tab int, band int, visit array<long>")
    if n_groups > 1:  # a query goes to each group that holds a bucket it visits
        asks = asks.withColumn("grp", F.explode(F.array_distinct(F.transform("visit", lambda b: F.pmod(F.xxhash64(b), F.lit(n_groups))))))
        asks = asks.withColumn("visit", F.filter("visit", lambda b: F.pmod(F.xxhash64(b), F.lit(n_groups)) == F.col("grp")))
    else:
        asks = asks.withColumn("grp", F.lit(0).cast("long"))
    asks = asks.join(parts, ["tab", "band", "grp"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c, _ in _FOUND}
        if rows.num_rows and asks.num_rows:
            bucket = rows["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            x, least, names = _matrix(rows["vec"])[order], rows["least"].to_numpy()[order], np.array(rows["node"].to_pylist())[order]
            for name, vec, visit in zip(asks["node"].to_pylist(), asks["vec"].to_pylist(), asks["visit"].to_pylist(), strict=True):
                visit = np.unique(np.array(visit, np.int64))
                lo, hi = np.searchsorted(bucket, visit), np.searchsorted(bucket, visit, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if not len(at):
                    continue
                at, s = _best(x, np.frombuffer(vec, np.float64), least, at, k)
                for c, v in zip(found, ([name] * len(at), names[at].tolist(), least[at].tolist(), s.tolist()), strict=True):
                    found[c] += v
        return pa.table({c: pa.array(found[c], t) for c, t in _FOUND})

    got = placed.groupBy("tab", "band", "grp", "part").cogroup(asks.select(F.col("tab").alias("t"), F.col("band").alias("b"), F.col("grp").alias("g"), F.col("part").alias("p"), "node", "vec", "visit").groupBy("t", "b", "g", "p"))
    got = got.applyInArrow(search, "query string, node string, least long, score double").dropDuplicates(["query", "node"])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    got = written(got.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("query", "node", "score"), "near-vectors")
    n_found = got.join(ids.groupBy("node").agg(F.count("*").alias("n")), "node").groupBy("query").agg(F.sum("n").alias("n"))
    short = written(queries.join(n_found, queries.node == n_found["query"], "left").filter(F.coalesce("n", F.lit(0)) <= k).select("node", "vec", "dim"), "short-queries")
    if not short.isEmpty():
        more = _scanned(nodes, short, k, size // group_rows + 1)
        more = more.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("query", "node", "score")
        got = got.join(short.select(F.col("node").alias("query")), "query", "left_anti").unionByName(more)
    wide = got.join(ids.select("node", "vec_id"), "node").select("query", "vec_id", "score")
    some = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k + 1).drop("r")
    own = asked.join(wide, asked.node == wide["query"]).filter("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
