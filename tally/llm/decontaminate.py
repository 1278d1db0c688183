"""Benchmark decontamination by spaced seeds.

Words are lower-cased (A-Z) and hashed. Fixed masks choose six positions of a window and
ignore the rest, so that a window still matches when ignored words were replaced. A first
pass over the documents keeps the windows whose hash may be one of the benchmark's (a
bitmap of fixed size, broadcast, with two probes); these are joined with the benchmark's
windows by hash. Around every hit the document and the item are then compared word by word
on the hit's diagonal: the longest stretch of which at least ``percent`` % are equal counts
as an overlap if it has ``least`` words, or ``percent`` % of the item's words if that is less.
Items of fewer than six words, into which no mask fits, are looked up whole and overlap where
they stand word for word in a text. Equal texts are compared once; places of a frequent window
are gathered by text and by item, and all diagonals of a text and an item are compared together.

Null and wordless texts and items overlap with nothing.
Result rows are per document row (repeated rows give repeated results) and item id; of
several items with one id, the longest overlap counts. Null ids are kept as null. Other
input columns are ignored; an empty table on either side gives an empty result; texts of
any length are read whole. Ties among stretches go to the first in the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import mix, pieces, string_buffer, word_hashes, written

MASKS = ("111111", "1110100011", "11010010101", "1100110101")
BITS = 24  # of the index of each of two bitmaps: 2 MB each, whatever the size of the benchmark
SHORT = 6  # items of fewer words are looked up whole
LEAST = 13
PERCENT = 80
DIFFERENCES = 1 << 20  # differences of places that are formed together
FEW = 64  # differences of one window of one text and item that are listed as they are, repeated ones too
_U = np.uint64


def windows(words: np.ndarray, offs: np.ndarray, short: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every mask, start positions of the windows that fit into their text, and their hashes.

    ``short`` are lengths of which all windows are given as well, without ignored words.
    """
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(words))
    for m, mask in [*enumerate(MASKS), *((len(MASKS) + k, "1" * k) for k in short or ())]:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, m + 1, _U)
        for j, c in enumerate(mask):
            if c == "1":
                h = h * _U(0x9E3779B97F4A7C15) + words[j: j + n]
        at = np.flatnonzero(left[:n] >= len(mask))
        yield at, mix(h[at])


def longest_overlap(equal: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """Start and length of the longest stretch that begins and ends with equal words and has ``percent`` % of them."""
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0
    run = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    low = np.minimum.accumulate(run[hits])  # before each possible start
    first = np.searchsorted(-low, -run[hits + 1])  # the first start from which the share is reached
    length = hits + 1 - hits[np.minimum(first, np.arange(len(hits)))]
    best = int(length.argmax())
    return int(hits[min(first[best], best)]), int(length[best])


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, item, words, pos, h``: every item's words and its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            words, offs = word_hashes(*string_buffer(batch.column(1)))
            for key, a, b in zip(batch.column(0).to_pylist(), offs[:-1], offs[1:], strict=True):
                own = words[a:b]
                got = list(windows(own, np.array([0, b - a]), [int(b - a)] if 0 < b - a < SHORT else None))
                if got:
                    out.append((key, _digest(own), own.tobytes(), np.concatenate([p for p, _ in got]).tolist(), np.concatenate([h for _, h in got]).view(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "item", "words", "pos", "h"])

    rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, item binary, words binary, pos array<int>, h array<long>")


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(64 - BITS)).astype(np.int64), (h & _U((1 << BITS) - 1)).astype(np.int64)


def suspects(rows: DataFrame, bitmap, short: list[int] | None = None) -> DataFrame:
    """Documents with windows that may be the benchmark's: their words, and these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (np.unpackbits(x).view(bool) for x in bitmap.value)
        for batch in batches:
            data, offs = string_buffer(batch.column(2))
            for a, b in pieces(offs):
                words, wo = word_hashes(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
                for pos, h in windows(words, wo, short):
                    one, two = _probes(h)
                    ok = first[one]
                    ok[ok] = second[two[ok]]
                    at.append(pos[ok])
                    hashes.append(h[ok])
                pos, h = np.concatenate(at), np.concatenate(hashes)
                order = np.argsort(pos, kind="stable")
                pos, h = pos[order], h[order].view(np.int64)
                cut = np.searchsorted(pos, wo)
                hit = np.flatnonzero(np.diff(cut))
                own = [words[wo[r]: wo[r + 1]] for r in hit]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(hit)), batch.column(1).slice(a, b - a).take(pa.array(hit)), pa.array([_digest(w) for w in own], pa.binary()), pa.array([w.tobytes() for w in own], pa.binary()),
                    pa.array([(pos[cut[r]: cut[r + 1]] - wo[r]).tolist() for r in hit], pa.list_(pa.int32())), pa.array([h[cut[r]: cut[r + 1]].tolist() for r in hit], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "body", "words", "pos", "h"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, body binary, words binary, pos array<int>, h array<long>")


def overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, item_id, n_words, n_equal, doc_start, item_start`` of every document row and item that overlap.

    ``text_hash`` is Spark's xxhash64 of the text; starts count words from 0.
    """
    items = written(items_of(benchmark, item_col, item_text), "items")
    marks = items.dropDuplicates(["item"]).select("item", F.explode(F.arrays_zip("pos", "h")).alias("w")).select("item", F.col("w.pos").alias("at"), F.col("w.h").alias("h"))
    ends = F.array(F.shiftrightunsigned("h", 64 - BITS), -1 - F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)))
    slots = marks.select(F.explode(ends).alias("s")).select(F.col("s").cast("int")).distinct().toArrow()["s"].to_numpy()
    bits = np.zeros((2, 1 << BITS), bool)  # at most 2 x 2^24 slots reach the driver
    bits[0, slots[slots >= 0]] = True
    bits[1, -1 - slots[slots < 0]] = True
    bitmap = df.sparkSession.sparkContext.broadcast((np.packbits(bits[0]), np.packbits(bits[1])))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col]).alias("text_hash"), df[text_col].cast("string").alias("text"))
    width = F.length("words") / 8
    short = sorted(int(r[0]) for r in items.select(width).where((width > 0) & (width < SHORT)).distinct().collect())  # at most five
    found = written(suspects(rows, bitmap, short), "suspects")
    bodies = found.dropDuplicates(["body"])
    hits = bodies.select("body", F.explode(F.arrays_zip("pos", "h")).alias("w")).groupBy("body", F.col("w.h").alias("h")).agg(F.collect_list("w.pos").alias("pos"))
    marks = marks.groupBy("item", "h").agg(F.collect_list("at").alias("at"))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x0, nx), (y, y0, ny) = ((c.values.to_numpy(), c.offsets.to_numpy()[:-1], np.diff(c.offsets.to_numpy())) for c in (batch["pos"], batch["at"]))
            few = np.flatnonzero(nx.astype(np.int64) * ny <= FEW)
            n = nx[few] * ny[few]
            row = np.repeat(few, n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            flat = x[x0[row] + k // ny[row]] - y[y0[row] + k % ny[row]]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(few)) for c in ("body", "item")), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))], ["body", "item", "diagonals"])
            for r in np.flatnonzero(nx.astype(np.int64) * ny > FEW):
                u, v = x[x0[r]: x0[r] + nx[r]], y[y0[r]: y0[r] + ny[r]]
                step = max(1, DIFFERENCES // len(v))
                some = np.unique(np.concatenate([np.unique(u[i: i + step, None] - v) for i in range(0, len(u), step)]))
                yield pa.RecordBatch.from_arrays([batch["body"].slice(r, 1), batch["item"].slice(r, 1), pa.array([some], pa.list_(pa.int32()))], ["body", "item", "diagonals"])

    met = hits.join(marks, "h").select("body", "item", "pos", "at").mapInArrow(differences, "body binary, item binary, diagonals array<int>")
    lines = met.groupBy("body", "item").agg(F.array_distinct(F.flatten(F.collect_list("diagonals"))).alias("diagonals"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch[c][r].as_buffer(), _U) for c in ("words", "item_words"))
                need = len(y) if len(y) < SHORT else min(least, len(y) * percent // 100)
                best = (0, 0, 0, 0)
                for d in batch["diagonals"][r].values.to_numpy().tolist():
                    x0, y0 = max(d, 0), max(-d, 0)
                    n = min(len(x) - x0, len(y) - y0)
                    equal = x[x0: x0 + n] == y[y0: y0 + n]
                    s, size = longest_overlap(equal, percent)
                    same = int(equal[s: s + size].sum())
                    if size and size >= need and (len(y) >= SHORT or same == size):
                        best = max(best, (size, same, -x0 - s, -y0 - s))
                if best[0]:
                    out.append((r, best[0], best[1], -best[2], -best[3]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["body"].take(pa.array(cols[0], pa.int64())), batch["item"].take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int32()) for c in cols[1:])], ["of", "item", "n_words", "n_equal", "doc_start", "item_start"])

    pairs = lines.join(bodies.select("body", "words"), "body").join(items.dropDuplicates(["item"]).select("item", F.col("words").alias("item_words")), "item")
    best = pairs.select("body", "item", "diagonals", "words", "item_words").mapInArrow(compare, "of binary, item binary, n_words int, n_equal int, doc_start int, item_start int")
    named = best.join(items.select("item", "item_id").distinct(), "item")
    top = F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("m")
    named = named.groupBy("of", "item_id").agg(top)
    return found.select("doc_id", "text_hash", "body").join(named, F.col("body") == F.col("of")).select(
        "doc_id", "text_hash", "item_id", "m.n_words", "m.n_equal", (-F.col("m.d")).alias("doc_start"), (-F.col("m.i")).alias("item_start"))
