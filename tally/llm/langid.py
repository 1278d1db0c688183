"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed 1- to 3-grams of lower-cased characters (text start and end
included) per language, partly in each task and then over all tasks; nothing but these
counts, at most ``languages x buckets`` numbers, reaches the driver. The matrix of log
probabilities, whose size is checked, is broadcast, and batches of whole texts are scored
by gathering its rows in numpy.

A text that is null or holds no letter is ``und`` with score 0, as is every text if there
is nothing to learn from. Ties go to the first language in alphabetical order. Very long
texts are counted and scored in slices that overlap by two characters, whose log probabilities
are added, so that memory beside the text is bounded. Repeated rows are scored one by one; other input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import text_ranges

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.1  # added to every count
MAX_MATRIX = 64 << 20  # bytes of log probabilities that may be broadcast
SLICE = 1 << 18  # characters of a long text that are taken at a time
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, the bucket of the gram at every position (``buckets``: crosses the text's end); text offsets."""
    return _grams([_marked(t) for t in texts], buckets)


def _marked(text: str) -> str:
    return "\0" + text.lower() + "\0"


def slices(text: str, buckets: int = BUCKETS) -> Iterator[list[np.ndarray]]:
    """The same buckets of one text, slice by slice."""
    low = _marked(text)
    for a in range(0, len(low), SLICE):
        yield [g[:SLICE] for g in _grams([low[a: a + SLICE + max(ORDERS) - 1]], buckets)[0]]


def _grams(low: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    offs = np.cumsum([0, *map(len, low)])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(c))
    h, out = np.zeros(len(c), np.uint32), []
    for k in ORDERS:
        nxt = np.zeros(len(c), np.uint32)
        nxt[: len(c) - k + 1] = c[k - 1:]
        h = (h * np.uint32(0x01000193)) ^ (nxt * np.uint32(0x9E3779B1) + np.uint32(k))
        h = h ^ (h >> np.uint32(15))
        b = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) % buckets
        out.append(np.where(left >= k, b, buckets))
    return out, offs


def gram_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``text, lang``; bucket -1 counts the language's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in text_ranges(batch.column(0)):
                by: dict[str, list[str]] = {}
                for t, l in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    by.setdefault(l, []).append(t)
                for lang, texts in by.items():
                    n = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    short = [t for t in texts if len(t) <= SLICE]
                    for by_order in (grams(short, buckets)[0], *(s for t in texts if len(t) > SLICE for s in slices(t, buckets))):
                        for g in by_order:
                            n[:buckets] += np.bincount(g, minlength=buckets + 1)[:buckets]
                    n[buckets] += len(texts)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(np.where(at == buckets, -1, at).astype(np.int32)), "n": pa.array(n[at])})

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and their log probabilities, one row per bucket (the last, all zero, for no gram)."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def _rows(self, by_order: list[np.ndarray]) -> np.ndarray:
        at = self.matrix[by_order[0]]
        for g in by_order[1:]:
            at += self.matrix[g]
        return at

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability of each text."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs = np.zeros((len(texts), len(self.langs)))
        short = [i for i, t in enumerate(texts) if len(t) <= SLICE]
        if short:
            by_order, offs = grams([texts[i] for i in short], len(self.matrix) - 1)
            logs[short] = np.add.reduceat(self._rows(by_order), offs[:-1], axis=0, dtype=np.float64)
        for i, t in enumerate(texts):
            if len(t) > SLICE:
                for by_order in slices(t, len(self.matrix) - 1):
                    logs[i] += self._rows(by_order).sum(axis=0, dtype=np.float64)
        logs += self.prior
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = np.array([bool(_LETTER(t)) for t in texts])
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from all rows whose text and language are not null."""
    rows = df.select(df[text_col].cast("string").alias("text"), df[label_col].cast("string").alias("lang")).dropna()
    counts = gram_counts(rows, buckets)
    langs = sorted(r[0] for r in counts.filter("bucket = -1").select("lang").limit(MAX_MATRIX // (4 * buckets) + 1).collect())
    if len(langs) * (buckets + 1) * 4 > MAX_MATRIX:
        raise ValueError(f"more than {MAX_MATRIX // (4 * buckets)} languages: the matrix would exceed {MAX_MATRIX} bytes")
    n = np.zeros((buckets + 1, len(langs)))
    docs = np.ones(len(langs))
    got = counts.toArrow().to_pydict()
    col = {l: i for i, l in enumerate(langs)}
    at, b = np.array([col[l] for l in got["lang"]], np.int64), np.array(got["bucket"], np.int64)
    value = np.array(got["n"], np.float64)
    docs[at[b < 0]] = value[b < 0]
    n[b[b >= 0], at[b >= 0]] = value[b >= 0]
    n = n[:buckets] + ALPHA
    logs = np.vstack([np.log(n / n.sum(axis=0)), np.zeros((1, len(langs)))]).astype(np.float32)
    return Model(langs, logs, np.log(docs / docs.sum()) if langs else docs)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text, and the ``keep`` columns."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for a, b in text_ranges(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                lang, p = m.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(p)], names=out.fieldNames())

    from pyspark.sql import types as T
    out = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).drop("text")
