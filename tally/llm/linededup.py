"""Line deduplication: repeated runs of lines, through content-defined chunks.

A rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is divisible by
a divisor, so that boundaries shift with the text. ``dedup_runs`` removes every line that
stands in a repeated run of two or more lines, in two levels:

1. Chunks of at least two lines whose hash repeats are compared by their bytes. All
   occurrences but the first (by id, then text, then place) go whole. Most of what is
   repeated goes here, and takes no part in what follows.
2. What is left between and inside kept chunks may still be repeated by shorter runs, or by
   runs that no boundary falls into alike. The second level has a chunk of two lines at
   every line: those that lie across boundaries or in chunks that stay. Their repeats are
   found in the same way, by hash and then by bytes, and line by line they extend a
   removed chunk into its neighbours.

Together that is every line of a pair of neighbouring lines that occurs before: the first
occurrence of a pair never lies in a removed chunk, whose own first occurrence is earlier.
An occurrence that shares a line with the first one, as in three equal lines, is no repeat
of it. Single lines between others are never removed. Since the first occurrence of each
pair stays, not of each run, a run may stay only in parts that stand in different
documents: of ``a b`` in document 1, ``a b c`` in 2 and ``b c`` in 3 no document keeps
``b c``, whose first occurrence shares a line with the repeated ``a b``.

``dedup_lines`` knows only the first level, with shorter chunks; no query uses it. A hash
that stands for different texts removes nothing there.

Null text stays null (0 lines); an empty text has one empty line. Rows equal in id and text
count as one document: what is first there stays in all of them. Null ids come first. Other
columns are passed on, if asked for, in one struct, so that their names can't clash; an empty
table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import mix, text_ranges, written

WINDOW = 2
DIVISOR = 2
LINES = 2  # of a chunk that may be removed
RUN_DIVISOR = 4  # of the first level of ``dedup_runs``
_MASK = (1 << 64) - 1


def chunks(text: str, divisor: int = DIVISOR) -> list[tuple[str, int, int]]:
    """``(chunk, number of lines, hash)`` of a text; chunks joined by line breaks give the text."""
    lines = text.split("\n")
    out, start, last = [], 0, [0] * WINDOW
    for i, line in enumerate(lines):
        last = [*last[1:], int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")]
        roll = 0
        for h in last:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & _MASK
        if (roll >> 32) % divisor == 0 or i + 1 == len(lines):
            body = "\n".join(lines[start:i + 1])
            digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out.append((body, i + 1 - start, int.from_bytes(digest, "little", signed=True)))
            start = i + 1
    return out


def chunk_table(rows: DataFrame, divisor: int, bodies: bool) -> DataFrame:
    """``doc_id, text_hash, place, h`` of every chunk that may be removed, with its text if ``bodies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_ranges(batch.column(2)):
                src, place, h, body = [], [], [], []
                for r, text in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    for i, (c, n, x) in enumerate(chunks(text, divisor) if text is not None else ()):
                        if n >= LINES:
                            src.append(a + r)
                            place.append(i)
                            h.append(x)
                            body.append(c if bodies else None)
                src = pa.array(src, pa.int64())
                cols = [batch.column(0).take(src), batch.column(1).take(src), pa.array(place, pa.int32()), pa.array(h, pa.int64())]
                names = ["doc_id", "text_hash", "place", "h"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(body, pa.string())][: 4 + bodies], [*names, "body"][: 4 + bodies])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, place int, h long" + ", body string" * bodies)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), divisor: int = DIVISOR) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row, without the repeated chunks, and the struct ``carried``."""
    extra = F.struct(*[df[c] for c in carry]) if carry else F.lit(None).cast("string")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col].cast("string")).alias("text_hash"), df[text_col].cast("string").alias("text"), extra.alias("carried"))
    seen = chunk_table(rows, divisor, True).groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place")).alias("first"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    repeated = written(seen.filter("n > 1 and lo = hi").select("h", "first"), "repeated-chunks")
    again = chunk_table(rows, divisor, False).join(repeated, "h").filter(~F.struct("doc_id", "text_hash", "place").eqNullSafe(F.col("first")))
    drops = again.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.collect_set("place").alias("drop"))
    both = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")), "left").select("doc_id", "text", "carried", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_ranges(batch.column(1)):
                part = batch.slice(a, b - a)
                texts, lines, gone = [], [], []
                for text, drop in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    removed = 0
                    n = 0 if text is None else text.count("\n") + 1
                    if drop:
                        out, drop = [], set(drop)
                        for i, (c, k, _) in enumerate(chunks(text, divisor)):
                            if i in drop:
                                removed += k
                            else:
                                out.append(c)
                        text = "\n".join(out)
                    texts.append(text)
                    lines.append(n)
                    gone.append(removed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), part.column(2)], names=schema.fieldNames())

    kinds = {f.name: f for f in both.schema.fields}
    schema = T.StructType([kinds["doc_id"], kinds["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), kinds["carried"]])
    done = both.mapInArrow(run, schema)
    return done if carry else done.drop("carried")


def pair_hashes(text: str) -> np.ndarray:
    """A hash of every two neighbouring lines."""
    lines = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in text.split("\n")]
    h = np.frombuffer(b"".join(lines), np.uint64)
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).view(np.int64)


def pair_table(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, chunk, h`` of every two neighbouring lines; ``chunk`` (null across a boundary) holds both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_ranges(batch.column(2)):
                found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t in batch.column(2).slice(a, b - a).to_pylist():
                    found.append(np.zeros(0, np.int64) if t is None else pair_hashes(t))
                    of = np.zeros(0, np.int64) if t is None else np.repeat(*np.array([(i, n) for i, (_, n, _) in enumerate(chunks(t, RUN_DIVISOR))]).T)
                    owner.append(np.where(of[:-1] == of[1:], of[:-1], -1))
                n = [len(x) for x in found[1:]]
                src = pa.array(np.repeat(np.arange(a, b), n))
                place = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
                chunk = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(src), batch.column(1).take(src), pa.array(place, pa.int32()), pa.array(chunk, pa.int32(), mask=chunk < 0), pa.array(np.concatenate(found))], ["doc_id", "text_hash", "place", "chunk", "h"])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, place int, chunk int, h long")


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """``of, of_text, chunk`` of all chunks that occur before: first by hash, then by their bytes."""
    often = written(chunk_table(rows, RUN_DIVISOR, False).groupBy("h").count().filter("count > 1").select("h"), "repeated-hashes")
    found = written(chunk_table(rows, RUN_DIVISOR, True).join(often, "h", "left_semi").drop("h").distinct(), "chunk-bodies")
    first = found.groupBy("body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place")).alias("first")).filter("n > 1").select("body", "first")
    first = written(first, "first-chunks")  # so that a join on it can split a body that many texts hold
    again = found.join(first, "body").filter(~F.struct("doc_id", "text_hash", "place").eqNullSafe(F.col("first")))
    return again.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"), F.col("place").alias("chunk"))


def pair_bodies(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, body`` of the pairs at the ``places`` of each text."""
    both = rows.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text"))).select("doc_id", "text_hash", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_ranges(batch.column(2)):
                part = batch.slice(a, b - a)
                src, place, body = [], [], []
                for r, (text, at) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    lines = text.split("\n")
                    at = [i for i in at if i + 1 < len(lines)]
                    src += [r] * len(at)
                    place += at
                    body += ["\n".join(lines[i:i + 2]) for i in at]
                src = pa.array(src, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(src), part.column(1).take(src), pa.array(place, pa.int32()), pa.array(body, pa.string())], ["doc_id", "text_hash", "place", "body"])

    return both.mapInArrow(run, "doc_id long, text_hash long, place int, body string")


def dedup_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row, without the repeated runs of lines, and the struct ``carried``."""
    extra = F.struct(*[df[c] for c in carry]) if carry else F.lit(None).cast("string")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col].cast("string")).alias("text_hash"), df[text_col].cast("string").alias("text"), extra.alias("carried"))
    own = [F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")]
    gone = written(repeated_chunks(rows), "repeated-chunks")
    inside = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")) & (F.col("pairs.chunk") == F.col("gone.chunk"))
    left = pair_table(rows).alias("pairs").join(gone.alias("gone"), inside, "left_anti").drop("chunk")
    left = written(left, "second-level")
    often = left.groupBy("h").count().filter("count > 1").select("h")
    places = left.join(often, "h", "left_semi").groupBy(*own).agg(F.collect_set("place").alias("places"))
    pairs = written(pair_bodies(rows, places), "pairs")
    first = written(pairs.groupBy("body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place")).alias("first")).filter("n > 1").select("body", "first"), "first-pairs")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    again = pairs.join(first, "body").filter(~same | (F.col("place") >= F.col("first.place") + 2))
    drops = again.select(*own, "place", F.lit(None).cast("int").alias("chunk")).unionByName(gone.select("of", "of_text", F.lit(None).cast("int").alias("place"), "chunk"))
    drops = drops.groupBy("of", "of_text").agg(F.collect_set("place").alias("drop"), F.collect_set("chunk").alias("whole"))
    both = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")), "left").select("doc_id", "text", "carried", "drop", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_ranges(batch.column(1)):
                part = batch.slice(a, b - a)
                texts, n, gone = [], [], []
                for text, drop, whole in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    lines = [] if text is None else text.split("\n")
                    drop = {j for i in drop or () for j in (i, i + 1) if j < len(lines)}
                    if whole:
                        sizes = [k for _, k, _ in chunks(text, RUN_DIVISOR)]
                        begin = np.concatenate([[0], np.cumsum(sizes)])
                        drop |= {j for i in whole for j in range(begin[i], begin[i + 1])}
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                    n.append(len(lines))
                    gone.append(len(drop))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), part.column(2)], names=schema.fieldNames())

    kinds = {f.name: f for f in both.schema.fields}
    schema = T.StructType([kinds["doc_id"], kinds["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), kinds["carried"]])
    done = both.mapInArrow(run, schema)
    return done if carry else done.drop("carried")
