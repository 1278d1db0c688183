"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every pre-token is a row of symbols; a segment tree holds, per position, the rank of
the pair that starts there (``rank * width + position``), so that the root is the
leftmost lowest-rank merge. A merge changes three leaves, each updated along its path
to the root in logarithmic time, until the root holds no mergeable pair. Short
pre-tokens are merged together, one tree per row of a matrix; long ones get a tree of
their own. Ids of units (mostly one pre-token) are kept per worker in a bounded table.

Null or empty text: no ids, decoded text is empty. Special strings inside texts become
their special id, as the library does by default. Output columns are fixed, so extra
input columns of any name are ignored; repeated rows are encoded one by one; an empty
table gives an empty result; texts have no length limit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tally.llm.common import text_ranges

MAX_FILE = 64 << 20  # bytes of a tokenizer file that may be broadcast
CACHE = 3 << 17  # units a worker keeps before it starts afresh
WIDE = 64  # pre-tokens longer than this get a tree of their own
INF = np.iinfo(np.int64).max
# White space and pre-token pattern of the byte-level scheme.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
           "[" + SPACE + "]+(?![^" + SPACE + "])|[" + SPACE + "]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder built from a tokenizer file's JSON text."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if (model["type"], pre.get("type"), spec["normalizer"]) != ("BPE", "ByteLevel", None) or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip white space are not supported")
        vocab = model["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for tok, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in tok) if all(c in back for c in tok) else tok.encode()
        for tok, i in self.special.items():
            self.tokens[i] = tok.encode()
        tail = [*self.tokens, b""]  # the last stands for ids outside the vocabulary
        self.lens = np.fromiter(map(len, tail), np.int64, size + 1)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tail), np.uint8)
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.rank = np.minimum.reduceat(order, first) if len(order) else order
        self.ranks = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        first = self._lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256), np.True_)
        self.byte_pair = first.reshape(256, 256)
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # what the quick cut can't take: runs of white space, a mark before a comma or full stop
        self.odd = re.compile(f"[{SPACE}][{SPACE}]|[\\W_][,.]|\0").search
        self.units_of = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])").split
        self.units: dict[str, bytes] = {"": b""}

    # --- the merge loop -------------------------------------------------------------------------
    def _lookup(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Rank of each pair, INF where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(ok & (self.keys[at] == key), self.rank[at], INF)

    def _merge_rows(self, rows: Sequence[bytes], width: int) -> list[bytes]:
        """Merge rows of at most ``width`` (a power of two) symbols, a segment tree per row."""
        m = len(rows)
        lens = np.fromiter(map(len, rows), np.int64, m)
        col = np.arange(width)
        inside = col < lens[:, None]
        ids = np.full((m, width), -1, np.int64)
        raw = np.zeros((m, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(rows), np.uint8)
        ids[inside] = self.byte_id[raw[inside]]
        nxt = np.where(col + 1 < lens[:, None], col + 1, width)
        prv = np.broadcast_to(col - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), INF, np.int64)
        pair = np.where(inside[:, 1:], self.byte_pair[raw[:, :-1], raw[:, 1:]], INF)
        tree[:, width:-1] = np.where(pair < INF, pair * width + col[:-1], INF)
        k = width // 2
        while k:
            np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2], out=tree[:, k:2 * k])
            k //= 2
        act = np.flatnonzero(tree[:, 1] < INF)
        while len(act):
            best = tree[act, 1]
            pos, new = best % width, self.merged[best // width]
            gone = nxt[act, pos]
            after, before = nxt[act, gone], prv[act, pos]
            ids[act, pos], ids[act, gone] = new, -1
            nxt[act, pos] = after
            has = after < width
            prv[act[has], after[has]] = pos[has]
            tree[act, width + gone] = INF
            pr = self._lookup(new, ids[act, np.where(has, after, 0)], has)
            tree[act, width + pos] = np.where(pr < INF, pr * width + pos, INF)
            had = before >= 0
            pr = self._lookup(ids[act, np.where(had, before, 0)], new, had)
            tree[act[had], width + before[had]] = np.where(pr < INF, pr * width + before, INF)[had]
            for r, leaf in ((act, gone), (act, pos), (act[had], before[had])):
                node = (width + leaf) >> 1
                while len(node) and node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
            act = act[tree[act, 1] < INF]
        left = ids >= 0
        flat = ids[left].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(left.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long pre-token, with a tree of its own."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        width = 1 << (n - 1).bit_length()
        none, get, size, merged = INF, self.ranks.get, self.size, self.merged.tolist()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get(ids[i] * size + ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                v = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == v:
                    break
                tree[i] = v
                i >>= 1

        while tree[1] < none:
            r, p = divmod(tree[1], width)
            gone = nxt[p]
            ids[p], ids[gone] = merged[r], -1
            after, before = nxt[gone], prv[p]
            nxt[p] = after
            put(gone, none)
            v = none
            if after >= 0:
                prv[after] = p
                r = get(ids[p] * size + ids[after])
                v = none if r is None else r * width + p
            put(p, v)
            if before >= 0:
                r = get(ids[before] * size + ids[p])
                put(before, none if r is None else r * width + before)
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def _merge(self, words: Iterable[str]) -> None:
        """Put the ids of new pre-tokens into the table."""
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            sized.setdefault((len(b) - 1).bit_length(), []).append((w, b))
        for bits, group in sized.items():
            width = max(2, 1 << bits)
            if width > WIDE:
                self.units.update((w, self._merge_long(b)) for w, b in group)
                continue
            for i in range(0, len(group), 4096):
                names, rows = zip(*group[i:i + 4096], strict=True)
                self.units.update(zip(names, self._merge_rows(rows, width), strict=True))

    # --- texts ----------------------------------------------------------------------------------
    # A text is cut before every run of white space, and before a comma or full stop that follows a
    # letter or digit: the pre-tokens of such a unit do not depend on its neighbours, so that its ids
    # can be kept. Most units are one pre-token, a space and a word.
    def _know(self, fresh: set[str]) -> None:
        """Add units to the table: pre-tokens by the pattern, then their merges."""
        units = self.units
        plain = {u for u in fresh if (u[1:] if u[:1] == " " else u).isalpha()}
        split = {u: self.find(u) for u in fresh - plain}
        plain.update(chain.from_iterable(split.values()))
        self._merge(plain.difference(units))
        units.update((u, b"".join([units[w] for w in ws])) for u, ws in split.items() if len(ws) != 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        docs: list[list[list[str]]] = []
        for text in texts:
            parts = []
            for k, part in enumerate(self.cut.split(text)) if self.cut and self.cut.search(text) else ((0, text),):
                if k % 2:
                    parts.append([part])
                elif self.odd(part):
                    parts.append(self.units_of(part))
                else:
                    parts.append(part.replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").replace(" ", "\0 ").split("\0"))
            docs.append(parts)
        seen: set[str] = set()
        seen.update(*chain.from_iterable(parts[::2] for parts in docs))
        if len(self.units) > CACHE:
            self.units = {"": b""}
        self._know(seen.difference(self.units))
        ids_of, out = self.units.__getitem__, []
        for parts in docs:
            ids = [b"".join(map(ids_of, us)) if k % 2 == 0 else np.int32(self.special[us[0]]).tobytes() for k, us in enumerate(parts)]
            out.append(np.frombuffer(b"".join(ids), np.int32))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of runs of ids; bytes that are not UTF-8 become U+FFFD; unknown ids give nothing."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[offsets]
        raw = data.tobytes()
        cut = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.array([x.decode("utf-8", "replace") for x in cut], pa.string())


_LOADED: dict[int, Tokenizer] = {}


def _load(blob: bytes) -> Tokenizer:
    key = hash(blob)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(blob)
    return _LOADED[key]


def file_broadcast(df: DataFrame, path: str):
    """The tokenizer file as a broadcast value: its size is checked and does not depend on the data."""
    with open(path, "rb") as f:
        blob = f.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    return df.sparkSession.sparkContext.broadcast(blob)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row's whole text; with ``decoded`` also the text that the ids decode to."""
    blob = file_broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(blob.value)
        for batch in batches:
            key, text = batch.columns
            for a, b in text_ranges(text):
                ids = tok.encode([t or "" for t in text.slice(a, b - a).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids)
                cols = {"doc_id": key.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))}
                if decoded:
                    cols["decoded"] = tok.decode(flat, ends)
                yield pa.RecordBatch.from_pydict(cols)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of every row's ids (null or empty: empty text; null and unknown ids give nothing)."""
    blob = file_broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(blob.value)
        for batch in batches:
            rows = [[-1 if i is None else i for i in x or ()] for x in batch.column(1).to_pylist()]
            flat = np.array(list(chain.from_iterable(rows)), np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": tok.decode(flat, np.cumsum([0, *map(len, rows)]))})

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
