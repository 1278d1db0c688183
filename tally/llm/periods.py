"""Periodic runs of words, located by block convolution at dyadic scales.

A run is a stretch of words that repeats with its smallest period q, is at least
``max(min_length, min_exponent * q)`` words long, and isn't extended by a neighbouring
word. For periods of L to 2L - 1 words, L a power of two, the words are cut into blocks of
L. With an exponent of four or more, every such run holds a whole block and the block's
next occurrence, q words on. All occurrences of a block at a distance of L to 2L - 1 are
found at once: with words as integers, the sum of squared differences between the block
and each place of the following window is zero if and only if they match, and the sums
come from one convolution, computed by a number-theoretic transform modulo a prime (whole
numbers, nothing is rounded). A block's transform serves as pattern and, with its
neighbour's, as window. A sum that is zero by chance (modulo the prime) is refuted when
the words themselves are compared.

The distances found seed extensions: from a block and its copy the stretch on which words
that far apart agree is extended to both sides, by doubling steps on hashes of stretches
and a last comparison of the words themselves. Scales go upwards, and a place that a run of
a smaller period covers is no seed any more, so that every run is found with its smallest
period and the number of seeds stays about the number of blocks.

The texts of a batch are searched together, longest first: each has an own word between it
and the next, which matches nothing, and a scale takes only texts that can hold its
periods. Words are compared as bytes (a dictionary numbers them), without folding case.

Null, empty or wordless text: no runs, empty text. A very long text is numbered in slices,
so that no list of all its words is ever made; the search needs about 100 bytes a
word. Rows with a null id and repeated rows are treated as any other. Ties need no rule: all
runs are returned, by start and period. Other input columns are ignored unless named in
``carry``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tally.llm.common import PIECE_BYTES, mix, pieces, string_buffer

P = 7 * 2**26 + 1  # a prime; 3 generates its units, so it has roots of unity of order 2^26
ROOT = 3
SLAB = 1 << 14  # words whose blocks are transformed together
SLICE = 1 << 20  # bytes of a text whose words are numbered together
_U = np.uint64
_PRIME = _U(P)
_BASE = _U(0x9E3779B97F4A7C15)


def _mod(x: np.ndarray) -> np.ndarray:
    whole = x // _PRIME  # faster than the remainder, which is not vectorised
    whole *= _PRIME
    return np.subtract(x, whole, out=whole)


class Transform:
    """Number-theoretic transform of rows of ``size`` numbers; places of the result are bit-reversed."""

    def __init__(self, size: int):
        self.size, self.bits = size, size.bit_length() - 1
        if P - 1 & size - 1:
            raise ValueError("a text is too long for its convolutions")
        w = pow(ROOT, (P - 1) // size, P)
        table = np.ones(max(size // 2, 1), _U)
        k = 1
        while k < size // 2:  # w^0 .. w^(size/2 - 1) by doubling
            table[k: 2 * k] = _mod(table[:k] * _U(pow(w, k, P)))
            k *= 2
        self.roots = table
        inverse = np.ones_like(table)
        if size > 2:
            inverse[1:] = _PRIME - table[:0:-1]  # w^-k = -w^(size/2 - k)
        self.inverse = inverse
        reverse = np.zeros(size, np.int64)
        for b in range(self.bits):
            reverse |= ((np.arange(size) >> b) & 1) << (self.bits - 1 - b)
        self.negated = reverse[-reverse % size]  # where the transform at minus a place's frequency stands
        self.scale = _U(pow(size, -1, P))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Transform of rows of numbers below the prime, in bit-reversed order; sums are reduced every fourth step."""
        n, step = self.size, 0
        x = x.copy()
        while n > 1:
            half = x.reshape(len(x), -1, 2, n // 2)
            a, b = half[:, :, 0], half[:, :, 1]
            least = _PRIME << _U(step % 4)  # a multiple of the prime that is not below any b
            down = _mod((a + least - b) * self.roots[:: self.size // n][: n // 2])
            half[:, :, 0] += b
            half[:, :, 1] = down
            step, n = step + 1, n // 2
            if step % 4 == 0 or n == 1:
                x = _mod(x)
        return x

    def backward(self, x: np.ndarray) -> np.ndarray:
        """Rows of numbers from their bit-reversed transforms; sums grow by a prime a step and are reduced every fourth."""
        n, step = 2, 0
        x = x.copy()
        while n <= self.size:
            half = x.reshape(len(x), -1, 2, n // 2)
            b = _mod(half[:, :, 1] * self.inverse[:: self.size // n][: n // 2])
            half[:, :, 1] = half[:, :, 0] + (_PRIME - b)
            half[:, :, 0] += b
            step, n = step + 1, n * 2
            if step % 4 == 0 or n > self.size:
                x = _mod(x)
        return _mod(x * self.scale)


def matches(codes: np.ndarray, block: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks below ``upto`` and distances of ``block`` to ``2 * block - 1`` at which they may occur again.

    Every occurrence inside ``codes`` is among them.
    """
    n_blocks = min(-(-upto // block), len(codes) // block)
    if n_blocks < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    transform = Transform(2 * block)
    starts, distances = [], []
    step = max(1, SLAB // block)
    for first in range(0, n_blocks, step):
        last = min(n_blocks, first + step)
        need = (last + 2 - first) * block
        words = codes[first * block: first * block + need]
        words = np.concatenate([words, np.full(need - len(words), P - 1, np.int64)]).astype(_U)  # P - 1: after the end
        rows = np.zeros((last + 2 - first, 2 * block), _U)
        rows[:, :block] = words.reshape(-1, block)
        spectra = transform.forward(rows)
        pattern = spectra[:-2][:, transform.negated]
        window = spectra[2:].copy()  # the second half of a window is shifted by half the size: odd frequencies change sign
        window[:, block:] = _PRIME - window[:, block:]
        products = transform.backward(_mod(_mod(window + spectra[1:-1]) * pattern))[:, :block]
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_mod(words * words))])  # of squares; exact below 2^35 words
        own = total[block:-2 * block:block] - total[:-3 * block:block]
        other = (total[2 * block: -1] - total[block: -1 - block]).reshape(-1, block)  # of the window's places
        different = _mod(own[:, None] + other + ((_PRIME << _U(1)) - (products << _U(1))))
        k, d = np.nonzero(different == 0)
        starts.append((k + first) * block)
        distances.append(d + block)
    return np.concatenate(starts), np.concatenate(distances)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Stretches:
    """Hashes of all stretches of words, to extend agreements by doubling steps."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n = len(codes) + 1
        powers = np.full(n, _BASE, _U)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(codes.astype(_U) + _U(1)) * self.powers[:-1], dtype=_U)])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from ``a`` and from ``b >= a`` on have one hash."""
        return (self.sums[a + length] - self.sums[a]) * self.powers[b - a] == self.sums[b + length] - self.sums[b]

    def agreement(self, a: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
        """How many words from ``a`` and from ``b > a`` on (or just before them) are the same."""
        left = a.copy() if backward else len(self.codes) - b  # at most so many more
        done = np.zeros(len(a), np.int64)
        step = np.ones(len(a), np.int64)
        growing = np.ones(len(a), bool)
        live = np.flatnonzero(left > 0)
        while len(live):  # steps double until one fails, then the rest is halved
            s = np.where(growing[live], np.minimum(step[live], left[live]), (left[live] + 1) // 2)
            x = a[live] - done[live] - s if backward else a[live] + done[live]
            y = b[live] - done[live] - s if backward else b[live] + done[live]
            same = self.equal(x, y, s)
            done[live] += np.where(same, s, 0)
            left[live] = np.where(same, left[live] - s, s - 1)
            growing[live] &= same
            step[live] *= 2
            live = live[left[live] > 0]
        return done

    def confirmed(self, start: int, end: int, period: int) -> bool:
        """Whether the words themselves repeat with the period, and not one word further."""
        c = self.codes
        if not np.array_equal(c[start: end - period], c[start + period: end]):
            return False
        return (start == 0 or c[start - 1] != c[start + period - 1]) and (end == len(c) or c[end] != c[end - period])

    def exactly(self, a: int, period: int) -> tuple[int, int]:
        """The stretch around ``a`` that repeats with the period, word by word (empty if ``a`` doesn't)."""
        c, s, e = self.codes, a, a
        while e + period < len(c) and c[e] == c[e + period]:
            e += 1
        while s > 0 and c[s - 1] == c[s - 1 + period]:
            s -= 1
        return (s, e + period) if e > a else (a, a)


def _covered(begin: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether some run holds the whole stretch from ``begin`` to ``end``."""
    if not runs:
        return np.zeros(len(begin), bool)
    known = np.array(sorted(runs), np.int64)
    reach = np.maximum.accumulate(known[:, 1])
    at = np.searchsorted(known[:, 0], begin, "right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= end)


def find_runs(codes: np.ndarray, lengths: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """Start, end and period of all runs in texts of falling ``lengths`` that stand one after the other in ``codes``.

    Words that differ from all others must stand between two texts; the lengths include them.
    """
    if min_exponent < 4:
        raise ValueError("blocks find runs of four or more repeats")
    stretches = Stretches(codes)
    ends = np.cumsum(lengths)
    runs: list[tuple[int, int, int]] = []
    block = 1
    while len(lengths) and lengths[0] >= max(min_length, min_exponent * block):
        fits = int(np.searchsorted(-lengths, -max(min_length, min_exponent * block), "right"))
        a, d = matches(codes[: ends[fits - 1]], block, int(ends[fits - 1]))
        seed = ~_covered(a, a + d + block, runs)
        a, d = a[seed], d[seed]
        found: set[tuple[int, int, int]] = set()
        if len(a):
            s = a - stretches.agreement(a, a + d, True)
            e = a + stretches.agreement(a, a + d, False) + d
            long = (e - s >= np.maximum(min_length, min_exponent * d)) & (e - d >= a + block)
            for run in np.unique(np.stack([s[long], e[long], d[long], a[long]], 1), axis=0).tolist():
                s_, e_, d_, a_ = run
                if (s_, e_, d_) in found:
                    continue
                if not stretches.confirmed(s_, e_, d_):  # unequal words of one hash
                    s_, e_ = stretches.exactly(a_, d_)
                    if e_ - s_ < max(min_length, min_exponent * d_):
                        continue
                found.add((s_, e_, d_))
        runs += sorted(found)
        block *= 2
    return sorted(runs)


def _numbered(data: np.ndarray, start: int, end: int, known: Numbers) -> np.ndarray:
    """Numbers of a text's words; ``known`` numbers each distinct word."""
    parts, at = [], start
    while at < end:
        stop = min(end, at + SLICE)
        raw = data[at:stop].tobytes()
        if stop < end:  # cut after the last space, or take more if a word fills the slice
            cut = max(raw.rfind(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            while cut < 0 and stop < end:
                stop = min(end, stop + (stop - at))
                raw = data[at:stop].tobytes()
                cut = max(raw.rfind(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if stop < end else len(raw)
            raw = raw[: cut + 1] if cut < len(raw) else raw
        words = raw.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at += len(raw)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _joined(codes: np.ndarray, words: list[bytes]) -> str:
    parts = [b" ".join([words[c] for c in codes[i: i + SLICE].tolist()]) for i in range(0, len(codes), SLICE)]
    return b" ".join(parts).decode()


def batch_runs(data: np.ndarray, offsets: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs (start, length, period) and collapsed text of each text of a piece, in order."""
    known = Numbers()
    texts = [_numbered(data, int(a), int(b), known) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    words = list(known)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) + 1 for i in order], np.int64)
    codes = np.zeros(int(lengths.sum()), np.int64)
    starts = np.cumsum(lengths) - lengths
    for rank, i in enumerate(order):
        codes[starts[rank]: starts[rank] + len(texts[i])] = texts[i]
        codes[starts[rank] + len(texts[i])] = len(words) + rank  # the text's own end
    if len(words) + len(texts) >= P - 1:
        raise ValueError("too many distinct words")
    of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(codes, lengths, min_length, min_exponent)
    for (s, e, q), rank in zip(found, np.searchsorted(starts, [s for s, _, _ in found], "right") - 1, strict=True):
        of[order[rank]].append((s - int(starts[rank]), e - s, q))
    for codes_of, runs in zip(texts, of, strict=True):
        if runs:
            gone = np.zeros(len(codes_of) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            codes_of = codes_of[np.cumsum(gone)[:-1] == 0]
        yield runs, _joined(codes_of, words)


def periodic_runs(df: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` of every row.

    ``collapsed`` has the text's words joined by one space, without those that some run
    holds after its first period. Columns of ``carry`` follow as a struct ``carried``.
    """
    carried = F.struct(*[df[c] for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), carried.alias("carried"))
    out = rows.select("doc_id", "carried").schema.add("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for a, b in pieces(offs, PIECE_BYTES):
                got = list(batch_runs(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a], min_length, min_exponent))
                flat = [r for runs, _ in got for r in runs]
                ends = np.cumsum([0, *(len(runs) for runs, _ in got)]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), struct, type=kind), pa.array([t for _, t in got], pa.string())], ["doc_id", "carried", "runs", "collapsed"])

    return rows.select("doc_id", "text", "carried").mapInArrow(run, out).select("doc_id", "runs", "collapsed", *(["carried"] if carry else []))
