"""Shared helpers: table access, written tables, text batches and vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import checkpoint_dir

PIECE_BYTES = 1 << 21  # texts are handled in pieces of about this many bytes inside a task
WORD_BYTES = 1 << 22  # bytes of a long text whose words are hashed together
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(col, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def string_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.fill_null("").cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]: o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about ``limit`` bytes (one long text stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def text_ranges(column, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    return pieces(string_buffer(column)[1], limit)


# --- words and their 64-bit hashes, for a whole buffer of texts at once ------------------------------
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOLS = _SPACE.copy()  # every ASCII character but letters and digits
SYMBOLS[:128] = [not chr(c).isalnum() for c in range(128)]
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POW = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, _U)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans(data: np.ndarray, breaks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end at a byte in ``breaks`` (a longer word stays whole) or at the end."""
    a, n = 0, len(data)
    while a < n:
        b = a + size
        while b < n:
            hit = np.flatnonzero(breaks[data[b: b + size]])
            if len(hit):
                b += int(hit[0])
                break
            b += size
        b = min(b, n)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and each text's offsets into them.

    ``breaks`` marks the bytes between words;
    with ``prefixes`` the result has a column for the word and one for each prefix of so many bytes.
    Long texts are taken in parts that end between words, so that beside the hashes memory is bounded.
    """
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, _U), np.zeros(len(offsets), np.int64)
    parts = []
    for a, b in spans(data, breaks, WORD_BYTES):
        inner = offsets[np.searchsorted(offsets, a, "right"): np.searchsorted(offsets, b)] - a
        h, s = _part_hashes(data[a:b], inner, breaks, prefixes)
        parts.append((h, s + a))
    h, s = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.searchsorted(s, offsets).astype(np.int64)


def _part_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words; texts also end at ``offsets``."""
    n = len(data)
    low = _LOWER[data]
    inside = ~breaks[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    p, inv = _powers(n)
    run = _BYTE[low]
    run *= p
    run = np.cumsum(run, dtype=_U)
    before = np.where(s > 0, run[s - 1], _U(0))
    inv = inv[s]

    def hashed(last: np.ndarray, tag: int) -> np.ndarray:
        return mix((run[last] - before) * inv + (last - s).astype(_U) + _U(tag << 32))

    h = hashed(e, 0)
    if prefixes:
        h = np.stack([h, *(hashed(np.minimum(e, s + k - 1), k) for k in prefixes)], 1)
    return h, s


def shingle_hashes(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows inside each text; a text with 1..k-1 words gives its whole sequence as one."""
    n = len(words)
    counts = np.diff(offs)
    out = np.zeros(max(n, 0), _U)
    acc = np.zeros(n, _U)
    short = (counts > 0) & (counts < k)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = (offs[1:][owner] - np.arange(n)) if n else np.zeros(0, np.int64)
    for j in range(k):
        nxt = np.zeros(n, _U)
        nxt[: n - j] = words[j:]
        use = left > j
        acc = np.where(use, mix(acc * _U(0x9E3779B97F4A7C15) + nxt + _U(j + 1)), acc)
    full = left >= k
    keep = full.copy()
    if short.any():
        keep[offs[:-1][short]] = True
    out = acc[keep]
    new = np.concatenate([[0], np.cumsum(np.where(short, 1, np.maximum(counts - k + 1, 0)))]).astype(np.int64)
    return out, new


def segment_reduce(ufunc, values: np.ndarray, offs: np.ndarray, empty):
    """``ufunc.reduceat`` over text offsets along axis 0; empty texts get ``empty``."""
    shape = (len(offs) - 1, *values.shape[1:])
    out = np.full(shape, empty, dtype=values.dtype if values.size else np.asarray(empty).dtype)
    has = np.flatnonzero(np.diff(offs) > 0)
    if len(has):
        out[has] = ufunc.reduceat(values, offs[:-1][has], axis=0)
    return out


def released() -> None:
    """Give memory back that earlier work of this process freed: reused workers would hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
