"""Language-model scores by context-tree weighting over binary-decomposed byte contexts.

A text is coded byte by byte (A-Z lower-cased, an end mark after the last byte), each byte
as eight binary decisions. Every decision has a context tree over the preceding ``depth``
bytes; a node holds the counts of zeros and ones seen in its context and codes them with
the Krichevsky-Trofimov estimate. The weighted probability of a node is the mean of its
own estimate and of the product over its children, so that every depth takes part with
the weight the training data give it. All of this depends on counts only, so that it is
learnt by counting (depth + 1)-grams: texts are packed into blocks and counted there, the
blocks' distinct grams are summed over all blocks, subtrees are weighted by their two most recent context bytes, and
the two levels above (at most 256 x 255 and 255 nodes) are finished from their sums. The
result, one log-probability per distinct gram, is joined to the blocks' grams, and texts
are summed up within their block. Word counts for the unigram base go the same way, words
being known by 64-bit hashes (a billion distinct words: 3 % for one pair to collide).

Null text counts as empty: its end mark alone is scored. Null ids count as the empty id.
Repeated rows are scored (and learnt) one by one; other input columns are ignored; an
empty table gives an empty result; without training rows every bit costs one bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import _LOWER, pieces, released, string_buffer, text_ranges, word_hashes, written

BLOCK_BYTES = 64 << 20  # texts of a block at most
LEAST_BYTES = 4 << 20  # of a block, where there are more tasks than blocks
PACK_BYTES = 1 << 20  # texts packed into one row
END = 0xFF  # never part of UTF-8: stands before and after each text
DEPTH = 5
_U = np.uint64


# --- grams and words of a block -------------------------------------------------------------------------
def gram_keys(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte, its (depth + 1)-gram as a number; each text's offsets (length + 1 grams)."""
    n = np.diff(offs)
    starts = depth + np.concatenate([[0], np.cumsum(n + depth)])[:-1]
    buf = np.full(int(n.sum()) + depth * (len(n) + 1), END, np.uint8)
    buf[np.repeat(starts - offs[:-1], n) + np.arange(offs[-1])] = _LOWER[data]
    ends = np.cumsum(n + 1)
    new = np.concatenate([[0], ends])
    at = np.repeat(starts - new[:-1], n + 1) + np.arange(ends[-1] if len(ends) else 0)
    key = np.zeros(len(buf), _U)
    for j in range(depth + 1):
        key[depth:] |= buf[j: len(buf) - depth + j].astype(_U) << _U(8 * (depth - j))
    return key[at], new


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (64-bit hashes) of each text's words and its end (0); each text's offsets."""
    h, wo = word_hashes(data, offs)
    n = np.diff(wo)
    new = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.zeros(int(new[-1]), _U)
    out[np.repeat(new[:-1] - wo[:-1], n) + np.arange(len(h))] = np.maximum(h, _U(1))
    return out, new


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several parts with their counts added, in order."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def counted(data: np.ndarray, offs: np.ndarray, held: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams, and distinct words, of some texts with their counts in the training texts (0: held out only)."""
    out: list[list] = [[], []]
    for a, b in pieces(offs):
        part, cut = data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
        for parts, (keys, new) in zip(out, (gram_keys(part, cut, depth), word_keys(part, cut)), strict=True):
            learnt = np.repeat(~held[a:b], np.diff(new))
            parts.append(np.unique(keys[learnt], return_counts=True))
            rest = np.unique(keys[~learnt])
            parts.append((rest, np.zeros(len(rest), np.int64)))
    return [summed(parts) for parts in out]


# --- context-tree weighting ------------------------------------------------------------------------------
def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2 (Stirling's series after eight steps of recurrence)."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        s -= np.log(x + k)
    return s


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: ``ctx * 256 + prefix`` keys, counts, and log weighted probabilities."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray | None):
        self.keys, self.a, self.b = keys, a, b
        own = log_kt(a, b)
        self.log_p = own if children is None else np.logaddexp(own, children) - math.log(2)
        self.stop = np.ones(len(keys)) if children is None else np.exp(own - math.log(2) - self.log_p)


def bit_nodes(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes over grams: node keys, zeros, ones; for each of the 8 bits of each gram its node and bit."""
    keys, bits = [], []
    for j in range(8):
        keys.append(ctx * _U(256) + ((_U(1) << _U(j)) | (byte >> _U(8 - j))))
        bits.append((byte >> _U(7 - j)) & _U(1))
    nodes, inv = np.unique(np.concatenate(keys), return_inverse=True)
    bit = np.concatenate(bits).astype(np.float64)
    w = np.tile(n.astype(np.float64), 8)
    ones = np.bincount(inv, w * bit, len(nodes))
    zeros = np.bincount(inv, w * (1 - bit), len(nodes))
    return nodes, zeros, ones, inv.reshape(8, -1), bit.reshape(8, -1)


def subtree(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[Level, np.ndarray]:
    """Weight the nodes of depth 2 to ``depth`` below one pair of recent bytes.

    Returns the level of depth 2, and for each gram and bit the probability from depth 2 on.
    """
    byte, ctx = gram & _U(255), gram >> _U(8)
    made, below = [], None
    for d in range(depth, 1, -1):
        nodes, zeros, ones, at, bit = bit_nodes(ctx & _U((1 << (8 * d)) - 1), byte, n)
        children = None
        if below is not None:  # children: one more, older, byte of context
            child_ctx = (below.keys >> _U(8)) & _U((1 << (8 * d)) - 1)
            parent = np.searchsorted(nodes, child_ctx * _U(256) + (below.keys & _U(255)))
            children = np.bincount(parent, below.log_p, len(nodes))
        below = Level(nodes, zeros, ones, children)
        made.append((below, at, bit))
    p = None
    for level, at, bit in made:
        hits = np.where(bit > 0, level.b[at], level.a[at])
        own = (hits + 0.5) / (level.a[at] + level.b[at] + 1.0)
        p = own if p is None else level.stop[at] * own + (1 - level.stop[at]) * p
    return below, p


def merge_level(keys: np.ndarray, parent: np.ndarray, a: np.ndarray, b: np.ndarray, log_p: np.ndarray) -> Level:
    """The level above nodes whose parents' keys are given."""
    nodes, inv = np.unique(parent, return_inverse=True)
    return Level(nodes, np.bincount(inv, a, len(nodes)), np.bincount(inv, b, len(nodes)), np.bincount(inv, log_p, len(nodes)))


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram, value`` (log10 probability of its last byte after the others) from ``gram, n``."""
    sub = (F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).cast("int")
    grams = grams.select("gram", "n", sub.alias("sub"))

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        gram, n = t["gram"].to_numpy().astype(_U), t["n"].to_numpy()
        order = np.argsort(gram)
        return gram[order], n[order]

    def weigh(t: pa.Table) -> pa.Table:
        top, _ = subtree(*columns(t), depth)
        return pa.table({"key": top.keys.astype(np.int64), "a": top.a, "b": top.b, "log_p": top.log_p})

    def recent(t: pa.Table) -> pa.Table:
        key, a, b, log_p = (t[c].to_numpy() for c in ("key", "a", "b", "log_p"))
        up = merge_level(key, ((key >> 8) & 0xFF) * 256 + (key & 0xFF), a, b, log_p)
        return pa.table({"key": up.keys, "a": up.a, "b": up.b, "log_p": up.log_p, "stop": up.stop})

    nodes = grams.groupBy("sub").applyInArrow(weigh, "key long, a double, b double, log_p double")
    one = nodes.groupBy((F.shiftright("key", 8).bitwiseAND(F.lit(0xFF))).alias("last")).applyInArrow(recent, "key long, a double, b double, log_p double, stop double")
    got = one.toArrow()  # at most 256 x 255 rows
    key, a, b, log_p, stop = (got[c].to_numpy() for c in ("key", "a", "b", "log_p", "stop"))
    root = merge_level(key, key & 0xFF, a, b, log_p)
    kt1, w1, kt0, w0 = np.full((65536, 2), 0.5), np.full(65536, 0.5), np.full((256, 2), 0.5), np.full(256, 0.5)
    kt1[key] = (np.stack([a, b], 1) + 0.5) / (a + b + 1.0)[:, None]
    w1[key] = stop
    kt0[root.keys] = (np.stack([root.a, root.b], 1) + 0.5) / (root.a + root.b + 1.0)[:, None]
    w0[root.keys] = root.stop
    shared = grams.sparkSession.sparkContext.broadcast((kt1, w1, kt0, w0))

    def score(t: pa.Table) -> pa.Table:
        kt1, w1, kt0, w0 = shared.value
        gram, n = columns(t)
        _, p = subtree(gram, n, depth)
        byte, last = (gram & _U(255)).astype(np.int64), ((gram >> _U(8)) & _U(255)).astype(np.int64)
        total = np.zeros(len(gram))
        for j in range(8):
            prefix, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            at = last * 256 + prefix
            q = w1[at] * kt1[at, bit] + (1 - w1[at]) * p[j]
            total += np.log10(w0[prefix] * kt0[prefix, bit] + (1 - w0[prefix]) * q)
        return pa.table({"gram": gram.astype(np.int64), "value": total})

    return grams.groupBy("sub").applyInArrow(score, "gram long, value double")


# --- scoring of documents --------------------------------------------------------------------------------
class Lookup:
    """Places of keys that are all in ``table`` (sorted), by a hash index and a search for what it missed."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = _U(64 - max(8, int(len(table) * 2).bit_length()))
        self.index = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.index[self._slot(table)] = np.arange(len(table), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.index[self._slot(keys)]
        miss = np.flatnonzero(self.table[at] != keys)
        at[miss] = np.searchsorted(self.table, keys[miss])
        return at


def packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of ``doc_id, text, held_out`` packed into blocks: ids, flags, offsets and compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        block, size, zip_ = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b in text_ranges(batch.column(1), PACK_BYTES):
                data, offs = string_buffer(batch.column(1).slice(a, b - a))
                if size and size + len(data) > block_bytes:
                    block, size = block + 1, 0
                size += len(data)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block]), "ids": pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([batch.column(2).slice(a, b - a).to_pylist()], pa.list_(pa.bool_())),
                    "ends": pa.array([offs[1:].tolist()], pa.list_(pa.int64())), "body": pa.array([zip_.compress(data.tobytes())], pa.binary())})

    return rows.mapInArrow(run, "block long, ids array<long>, held array<boolean>, ends array<long>, body binary")


def unpacked(batch) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, ids, held-out flags, bytes and offsets of each packed row."""
    raw = zstandard.ZstdDecompressor()
    for r in range(batch.num_rows):
        get = lambda c: batch[c][r]  # noqa: B023, E731
        ends = np.array(get("ends").as_py(), np.int64)
        data = np.frombuffer(raw.decompress(get("body").as_buffer(), max_output_size=int(ends[-1]) + 1), np.uint8)
        yield get("block").as_py(), get("ids").as_py(), np.array(get("held").as_py(), bool), data, np.concatenate([[0], ends])


def block_counts(packs: DataFrame, depth: int) -> DataFrame:
    """``block, is_word, key, n``: distinct grams and words of each block (or part of one)."""

    def rows_of(block: int, grams: list, words: list) -> Iterator[pa.RecordBatch]:
        for is_word, parts in ((False, grams), (True, words)):
            keys, n = summed(parts)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(n), block)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n), "is_word": pa.array(np.full(len(n), is_word))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        now, grams, words = None, [], []
        for batch in batches:
            for block, _, held, data, offs in unpacked(batch):
                if block != now and grams:
                    yield from rows_of(now, grams, words)
                    grams, words = [], []
                now = block
                g, w = counted(data, offs, held, depth)
                grams.append(g)
                words.append(w)
                if len(grams) == 8:  # keep one sum, not all parts
                    grams, words = [summed(grams)], [summed(words)]
        if grams:
            yield from rows_of(now, grams, words)
        del grams, words
        released()

    return packs.mapInArrow(run, "block long, key long, n long, is_word boolean")


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(size // block_bytes + 1, min(rows.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES + 1))
    packs = written(packed(rows.coalesce(n_blocks), block_bytes), "lm-packs")  # few large blocks repeat fewer grams
    counts = written(block_counts(packs, depth), "lm-counts", partition_by="is_word")
    words, grams = counts.filter("is_word").drop("is_word"), counts.filter("not is_word").drop("is_word")
    by_word = written(words.groupBy("key").agg(F.sum("n").alias("c")), "lm-words")
    totals = by_word.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    n_all, distinct = totals[0] or 0, totals[1] or 0
    by_gram = written(grams.groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "lm-grams")
    scores = written(gram_scores(by_gram, depth), "lm-scores")
    word_rows = words.select("block", "key").join(by_word, "key").select(F.col("block").alias("of"), "key", F.lit(None).cast("float").alias("value"), "c")
    gram_rows = grams.select("block", F.col("key").alias("gram")).join(scores, "gram").select(F.col("block").alias("of"), F.col("gram").alias("key"), F.col("value").cast("float").alias("value"), F.lit(None).cast("long").alias("c"))

    def add_up(docs: pa.Table, known: pa.Table) -> pa.Table:
        def ordered(column: str, kind) -> tuple[Lookup, np.ndarray]:
            part = known.select(["key", column]).filter(known[column].is_valid())
            keys = part["key"].to_numpy().view(_U)
            order = np.argsort(keys)
            return Lookup(keys[order]), part[column].to_numpy()[order].astype(kind)

        released()
        gram_at, value = ordered("value", np.float64)
        word_at, c = ordered("c", np.int64)
        del known
        logs = np.log10((c + 0.5) / (n_all + 0.5 * (distinct + 1)))
        out: dict[str, list] = {x: [] for x in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for _, ids, held, data, offs in unpacked(docs):
            keys, new = gram_keys(data, offs, depth)
            toks, cut = word_keys(data, offs)
            at = word_at(toks)
            got = ids, held, np.diff(cut), np.add.reduceat((c[at] > 0).astype(np.int64), cut[:-1]), np.add.reduceat(logs[at], cut[:-1]), np.add.reduceat(value[gram_at(keys)], new[:-1]), np.diff(offs)
            for col, x in zip(out.values(), got, strict=True):
                col.append(pa.array(x, pa.int64()) if col is out["doc_id"] else pa.array(x))
        del gram_at, word_at, value, c, logs
        released()
        cols = {k: pa.chunked_array(v) for k, v in out.items()}
        return pa.table({**cols, "train_tokens": pa.array(np.full(len(cols["doc_id"]), n_all))})

    return packs.groupBy("block").cogroup(word_rows.unionByName(gram_rows).groupBy("of")).applyInArrow(
        add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, train_tokens long")
