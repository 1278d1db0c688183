"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Each distinct shingle set (documents with equal sets form a class) gets two small
collections of keys, ``left`` and ``right``, of ``side`` keys each; a key combines
``per_key`` minhashes. A table (i, j) is keyed by the pair (left_i, right_j), so that
``2 * side * per_key`` minhashes serve ``side ** 2`` tables. Two classes share a table
bucket if and only if they share a left and a right key; this is tested inside the buckets
of left keys, so that no class is written once per table.

Links: every class of a left bucket is first compared with the bucket's most popular class
(of most neighbours, mostly the text that the others are copies of); connected components
of the confirmed links follow. In buckets that then still hold several components, the
classes outside the largest one are compared with all classes of other components, block
by block (a bucket of any size is split among tasks): pairs without a shared table, of too
different sizes, or whose histograms of shingle hashes prove too small an overlap are ruled
out, the others confirmed on the full sets. Every pair that shares a table is thus
confirmed, refuted, or already in one component; nothing is capped. A pair at exactly the
threshold of 80 % meets in no table with probability 2 * (1 - 0.8 ** per_key) ** side (9e-5
by default; 2e-6 at 85 %).

Null, empty or wordless text: an empty set, linked with nothing, kept. A text with fewer
words than a shingle is one shingle. Rows with a null id take part; the component id is
the least non-null id. Repeated rows and equal ids are separate documents of one class.
Other input columns are ignored; an empty table gives an empty result. Ties need no rule:
components do not depend on order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import mix, pieces, segment_reduce, shingle_hashes, string_buffer, word_hashes, written
from tally.llm.components import components

_U = np.uint64
BINS = 8  # bits of a shingle hash that choose its histogram bin
FULL = 65535  # a bin that holds so many shingles or more
BITMAP = 24  # bits of a digest that choose its place in the bitmap of wanted sets
REST_ROWS, OTHER_ROWS = 512, 8192  # rows of a block of a bucket that is compared pair by pair


def shingle_sets(text, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per piece of a text column: its first row, and the shingle hashes with each text's offsets."""
    data, offs = string_buffer(text)
    for a, b in pieces(offs):
        words, wo = word_hashes(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
        yield (a, *shingle_hashes(words, wo, k))


def _distinct(hashes: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _fixed_lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).reshape(-1)))


def sketches(rows: DataFrame, k: int, side: int, per_key: int) -> DataFrame:
    """Set size, set digest, histogram of hashes and both key collections of every row of ``doc_id, text``."""
    mult = np.random.default_rng(11).integers(1, 1 << 63, 2 * side * per_key, dtype=np.uint64) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, offs in shingle_sets(batch.column(1), k):
                n = len(offs) - 1
                keys = np.zeros((2 * side, n), _U)
                for j, m in enumerate(mult):
                    low = segment_reduce(np.minimum, hashes * m, offs, _U(0))
                    keys[j // per_key] = mix(keys[j // per_key] + low + _U(j))
                sets = _distinct(hashes, offs)
                hist = [np.minimum(np.bincount((s >> _U(64 - BINS)).astype(np.int64), minlength=1 << BINS), FULL).astype(np.uint16).tobytes() for s in sets]
                flat = keys.T.view(np.int64) if n else np.zeros((0, 2 * side), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _fixed_lists(flat[:, :side]), _fixed_lists(flat[:, side:]), pa.array(hist, pa.binary())],
                    ["doc_id", "n_shingles", "node", "left", "right", "hist"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, node binary, left array<long>, right array<long>, hist binary")


def full_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node, items`` (sorted shingle hashes) of the wanted nodes, from the texts.

    A bitmap of fixed size (at most 2^``BITMAP`` numbers reach the driver) rules out most
    other texts before the join with the wanted nodes.
    """
    number = F.conv(F.substring(F.hex("node"), 1, BITMAP // 4), 16, 10).cast("int")
    marks = wanted.select(number.alias("p")).distinct().toArrow()["p"].to_numpy()
    bits = np.zeros(1 << BITMAP, bool)
    bits[marks] = True
    bitmap = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bitmap.value)
        for batch in batches:
            for _, hashes, offs in shingle_sets(batch.column(0), k):
                found = {_digest(s): s for s in _distinct(hashes, offs) if len(s)}
                found = {d: s for d, s in found.items() if known[int.from_bytes(d[: BITMAP // 8], "big")]}
                yield pa.RecordBatch.from_pydict({"node": pa.array(found, pa.binary()), "items": pa.array([s.tobytes() for s in found.values()], pa.binary())})

    sets = rows.select("text").mapInArrow(run, "node binary, items binary")
    return sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def shared_keys(keys: DataFrame) -> DataFrame:
    """``key, c`` of the keys that two or more different nodes have, from ``key, node``."""
    return keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c")).filter("lo != hi").select("key", "c")


def near_enough(small: str, large: str, percent: int):
    """Sizes of two sets that can be similar enough at all."""
    return F.col(small) * 100 >= F.col(large) * percent


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    """Columns of nodes as arrays: one row per node."""
    n = t.num_rows
    wide = {c: np.array(t[c].to_pylist(), np.int64).reshape(n, -1) for c in ("left", "right")}
    hist = np.frombuffer(b"".join(t["hist"].to_pylist()), np.uint16).reshape(n, -1)
    return {"node": np.array(t["node"].to_pylist(), object), "label": np.array(t["label"].to_pylist(), object), "n": t["n"].to_numpy(), "hist": hist, **wide}


def cross_pairs(rest: pa.Table, others: pa.Table, percent: int) -> pa.Table:
    """Pairs of two blocks of one left bucket that may be links: other label, a shared right key, possible by size and histogram.

    A pair is formed only in the bucket of its first shared left key.
    """
    us, vs = [], []
    if rest.num_rows and others.num_rows:
        key, main = rest["key"][0].as_py(), rest["main"][0].as_py()
        a, b = _columns(rest), _columns(others)
        for r in range(rest.num_rows):
            x = {c: v[r] for c, v in a.items()}
            ok = (b["label"] != x["label"]) & ((b["label"] == main) | (b["node"] > x["node"]))
            ok &= (100 * np.minimum(b["n"], x["n"]) >= percent * np.maximum(b["n"], x["n"]))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            same = b["left"][at] == x["left"]
            at = at[x["left"][same.argmax(1)] == key]
            at = at[(b["right"][at] == x["right"]).any(1)]
            most = np.minimum(b["hist"][at], x["hist"]).sum(1, dtype=np.int64)  # at least the overlap
            full = ((b["hist"][at] == FULL) & (x["hist"] == FULL)).any(1)  # such bins bound nothing
            at = at[full | (100 * most >= percent * (b["n"][at] + x["n"] - most))]
            us += [x["node"]] * len(at)
            vs += b["node"][at].tolist()
    return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})


def unresolved(members: DataFrame, info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``u, v`` of pairs of different components that share a table and may be links."""
    at = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = at.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n"))
    mixed = sizes.filter("n > m.c").select("key", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.c")) / REST_ROWS).alias("na"), F.ceil(F.col("n") / OTHER_ROWS).alias("nb"))
    at = written(at.join(mixed, "key").join(info.drop("pop"), "node"), "mixed")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    rest = at.filter("label != main").withColumn("a", place("na")).withColumn("b", blocks("nb"))
    others = at.withColumn("b", place("nb")).withColumn("a", blocks("na")).select(F.col("key").alias("of"), F.col("a").alias("oa"), F.col("b").alias("ob"), "node", "label", "n", "left", "right", "hist")
    return rest.groupBy("key", "a", "b").cogroup(others.groupBy("of", "oa", "ob")).applyInArrow(lambda x, y: cross_pairs(x, y, percent), "u binary, v binary")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, side: int = 14, per_key: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    sketch = written(sketches(rows, k, side, per_key), "sketches")
    # classes that share a left key and a right key with another
    lefts = sketch.select("node", F.explode("left").alias("key")).dropna()
    members = lefts.join(shared_keys(lefts), "key").groupBy("key", "node").agg(F.max("c").alias("c"))
    members = written(members, "left-buckets")
    popular = members.groupBy("node").agg(F.sum("c").alias("pop"))
    info = sketch.join(popular, "node").dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), "left", "right", "hist", "pop")
    info = written(info, "shared-nodes")
    rights = info.select("node", F.explode("right").alias("key"))
    both = rights.join(shared_keys(rights), "key").select("node").distinct()
    info = written(info.join(both, "node", "left_semi"), "shared-nodes")
    members = members.select("key", "node").join(info.select("node", "pop"), "node")
    heads = members.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    first = members.join(heads, "key").select(F.col("node").alias("u"), F.col("head.node").alias("v")).filter("u != v").distinct()
    one, two = info.select(F.col("node").alias("u"), "n", "right"), info.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("right").alias("other"))
    first = first.join(one, "u").join(two, "v").filter(near_enough("n", "m", percent) & near_enough("m", "n", percent) & F.arrays_overlap("right", "other")).select("u", "v")
    first = written(first, "pairs")
    sets = written(full_sets(rows, info.select("node"), k), "sets")

    links = written(confirm(first, sets, percent), "confirmed")
    labels = components(links)
    more = unresolved(members, info, labels, percent)
    more = more.join(first, ["u", "v"], "left_anti").join(first.toDF("v", "u"), ["u", "v"], "left_anti")
    found = written(confirm(more, sets, percent), "confirmed")
    if not found.isEmpty():
        labels = components(links.union(found))
    named = sketch.dropna(subset=["node"]).groupBy("node").agg(F.min("doc_id").alias("rep")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "classes")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    where = named.join(least, "label").select("node", "component_id")
    out = sketch.select("doc_id", "n_shingles", "node").join(where, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
