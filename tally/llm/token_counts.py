"""Token counts without ids: pieces are counted once per distinct pre-token and summed by frequency.

Texts are cut into pre-tokens at places that no vocabulary piece spans (before a space
that follows a non-space, around line breaks). Each task gathers its texts in blocks and
writes the pre-token frequencies of every document over the block's dictionary, and the
dictionary itself, split into buckets by a hash of the pre-token. A bucket brings together
what all blocks know of its pre-tokens: there each distinct one is counted once with the
public library, and the counts are joined back to the blocks' dictionaries and, block by
block, to the documents' frequencies. A frequent pre-token is moved once per block, not
per use; there are as many buckets as input partitions, so that a bucket holds about as
many pre-tokens as a block, however many blocks there are.

Null or empty text: 0 bytes, 0 tokens. One result row per input row, repeated rows too;
other input columns, whatever their names, are ignored; an empty table gives an empty
result; whole texts are counted, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tally.llm.bpe import file_broadcast
from tally.llm.common import text_ranges, written

BLOCK_BYTES = 32 << 20  # UTF-8 bytes of a block's texts
MARK = "▁"  # the library's sign for a space
_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*").findall


def pretokens(text: str) -> list[str]:
    """Keys whose piece counts add up to the text's: a key stands after one space unless it starts with a line break."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[0] == " " or "  " in text:
        return [u if u[0] == "\n" else u[1:] for u in _RUNS(" " + text)]
    return text.replace("\n", " \n").split(" ")


class PieceCounter:
    """Piece counts of pre-token keys by the public library; checks that the vocabulary allows the cuts."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in names) or self.sp.encode("  ", out_type=str)[:1] == [] or self.sp.encode("\n", out_type=str)[0] != MARK:
            raise ValueError("a piece spans a pre-token boundary, or the model strips white space")
        self.lone = 1  # tokens of a space by itself
        self.lead = 1  # the library puts a space before each text; a line break never joins it

    def count(self, keys: list[str]) -> np.ndarray:
        ids = self.sp.encode(keys, num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(keys))
        n -= np.fromiter((k[:1] == "\n" for k in keys), np.int64, len(keys)) * self.lead
        n[np.fromiter((not k for k in keys), bool, len(keys))] = self.lone
        return n


_LOADED: dict[int, PieceCounter] = {}


def _load(blob: bytes) -> PieceCounter:
    key = hash(blob)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceCounter(blob)
    return _LOADED[key]


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


SCHEMA = "is_word boolean, block long, bucket int, ids array<long>, sizes array<long>, ends array<long>, slots binary, body binary"


def _row(**cols) -> pa.RecordBatch:
    """One row of packed columns; those not named are null."""
    kinds = {"is_word": pa.bool_(), "block": pa.int64(), "bucket": pa.int32(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "slots": pa.binary(), "body": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([cols.get(c)], k) for c, k in kinds.items()})


def _dictionary(block: int, words: dict[str, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's pre-tokens by bucket, in the order of their slots."""
    raw = [w.encode() for w in words]
    at = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    for k in range(buckets):
        slots = order[cuts[k]: cuts[k + 1]]
        if len(slots):
            own = [raw[i] for i in slots.tolist()]
            lens = np.fromiter(map(len, own), np.uint32, len(own))
            yield _row(is_word=True, block=block, bucket=k, slots=_zip(np.diff(slots, prepend=0).astype(np.uint32)), body=_zip(np.array([len(own)], np.uint32).tobytes() + lens.tobytes() + b"".join(own)))


def blocks(rows: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Documents' frequencies over their block's dictionary, and the dictionaries by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        size = 0
        for batch in batches:
            for a, b in text_ranges(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                sizes, ends, slots, counts = [], [], [], []
                for text in texts:
                    uses = Counter(pretokens(text))
                    for w in uses:
                        if w not in words:
                            words[w] = len(words)
                    own = np.fromiter(map(words.__getitem__, uses), np.uint32, len(uses))
                    order = np.argsort(own)
                    slots.append(np.diff(own[order], prepend=np.uint32(0)))
                    counts.append(np.fromiter(uses.values(), np.uint32, len(uses))[order])
                    sizes.append(len(text.encode()))
                    ends.append(len(uses))
                size += sum(sizes)
                yield _row(is_word=False, block=block, ids=batch.column(0).slice(a, b - a).to_pylist(), sizes=sizes, ends=np.cumsum(ends).tolist(), slots=_zip(np.concatenate(slots)), body=_zip(np.concatenate(counts)))
                if size >= block_bytes:
                    yield from _dictionary(block, words, buckets)
                    block, words, size = block + 1, {}, 0
        if words:
            yield from _dictionary(block, words, buckets)

    return rows.mapInArrow(run, SCHEMA)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text under the sentencepiece model at ``path``."""
    blob = file_broadcast(df, path)

    def count(t: pa.Table) -> pa.Table:
        """Count a bucket's distinct pre-tokens once, and give each block the counts of its own."""
        known: dict[bytes, int] = {}
        own: list[np.ndarray] = []
        for body in t["body"]:
            raw = zstandard.ZstdDecompressor().decompress(body.as_py())
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
            words = [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]
            own.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n))
        pieces, keys, counts = _load(blob.value), list(known), []
        for i in range(0, len(keys), 50_000):
            counts.append(pieces.count([k.decode() for k in keys[i:i + 50_000]]))
        n = np.concatenate(counts).astype(np.uint32)
        return pa.table({"of": t["block"], "places": t["slots"], "n": pa.array([_zip(n[x]) for x in own], pa.binary())})

    def add_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
        slots = [np.cumsum(_unzip(x, np.uint32), dtype=np.int64) for x in counts["places"].to_pylist()]
        n = np.zeros(1 + max((int(s[-1]) for s in slots), default=0), np.int64)
        for s, x in zip(slots, counts["n"].to_pylist(), strict=True):
            n[s] = _unzip(x, np.uint32)
        ids, sizes, total = [], [], []
        for r in range(docs.num_rows):
            get = lambda c: docs[c][r].as_py()  # noqa: B023, E731
            steps, uses, ends = _unzip(get("slots"), np.uint32).astype(np.int64), _unzip(get("body"), np.uint32), [0, *get("ends")]
            ids += get("ids")
            sizes += get("sizes")
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                total.append(int(n[np.cumsum(steps[a:b])] @ uses[a:b].astype(np.int64)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total, pa.int64())})

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    buckets = max(16, rows.rdd.getNumPartitions())
    kept = written(blocks(rows, block_bytes, buckets), "token-blocks", partition_by="is_word")
    docs, words = kept.filter("not is_word").drop("is_word", "bucket"), kept.filter("is_word").select("block", "bucket", "slots", "body")
    known = words.groupBy("bucket").applyInArrow(count, "of long, places binary, n binary")
    return docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add_up, "doc_id long, n_bytes long, n_tokens long")
