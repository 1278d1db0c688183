"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of characters without ASCII punctuation and space, A-Z lower-cased. A
word's embedding is the sum of hashed table rows, for the word and for its beginnings; filters of width 1, 2 and
3 slide over the words, a ReLU and a maximum over the whole text follow, and a logistic
layer. Adam on minibatches, the best of several epochs on a validation part. The decision
threshold is then calibrated by language on the training documents: a text's language, in
training and in scoring, is predicted from its words by a naive Bayes model over the same
hashes, so that no language label is read when a text is scored. The score is the logistic of
the distance to the threshold of the predicted language: 0.5 stands for the threshold.

All labelled documents are learnt from (``classify``). Up to ``MAX_ROWS`` of each class are
trained on together (``train``). Of more, those least by a hash of their id only give the
start: tasks go on from it over shards of about ``SHARD`` documents, cut by hash, and their steps
are averaged (of a table row over the shards that moved it), so that four fifths of all
documents move the filters. Word counts of languages are summed over all documents, and
thresholds are cut by the logits of all of them, those of the last fifth counting fully.
Logits are rounded to a ``GRID``-th for it. Very long texts are learnt slice by slice.

Very long texts are scored in slices that overlap by two words: the maximum is taken over all
slices, the evidence for a language is added, and memory beside the text is bounded (but for
a single word that is longer than a slice).
Null, empty or wordless text: the pooled features are zero; it gets the score of a text
without any signal. Rows with a null id are never used for learning. Several labels of one
document: it is toxic if any is. Null labels are left out. Without documents of both
classes every score is 0. Repeated rows are scored one by one; other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import SYMBOLS, pieces, segment_reduce, spans, string_buffer, word_hashes, written

MAX_ROWS = 2500  # labelled documents of a class that are trained on in one process
SHARD = 8192  # labelled documents, about, that a task goes on with by itself
RANGES = 256  # parts of the embedding table whose steps are added up apart
GRID = 1024  # logits are whole multiples of its inverse when thresholds are cut
SLOTS = 1 << 20  # rows of the embedding table
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginnings that have rows of their own
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 14
PART = 1 << 17  # words that are convolved together
TEXT = 1 << 20  # bytes of texts that are scored together; longer ones are cut into slices
LANG_SLOTS = 1 << 15
MAX_LANGS = 256
DENSE = ("out", "out_bias", "filters", "bias")  # parameters beside the table
LEAST = 8  # toxic and other documents that a language of its own threshold needs
_U = np.uint64


@dataclass
class Model:
    table: np.ndarray  # SLOTS x DIM
    filters: np.ndarray  # DIM x (taps * FILTERS), taps of all widths side by side
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    langs: np.ndarray  # LANG_SLOTS x languages
    thresholds: np.ndarray
    scale: float
    second: np.ndarray | None = None  # sums of squared gradients of the table's rows, while it is trained


def word_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word (two for the word, one for each prefix), and each text's offsets."""
    h, wo = word_hashes(data, offs, breaks=SYMBOLS, prefixes=PREFIXES)
    h = np.concatenate([h[:, :1], h[:, :1] >> _U(32), h[:, 1:]], 1)
    return (h & _U(SLOTS - 1)).astype(np.int32), wo


def embed(m: Model, rows: np.ndarray) -> np.ndarray:
    x = m.table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x += m.table[rows[:, k]]
    return x


def _taps(w: int) -> slice:
    at = sum(x for x in WIDTHS if x < w) * FILTERS
    return slice(at, at + w * FILTERS)


def convolve(m: Model, x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled features (texts x widths * FILTERS) and, per width, every window's value."""
    taps = x @ m.filters
    n = np.diff(offs)
    left = np.repeat(offs[1:], n) - np.arange(len(x))
    pooled, all_z = [], []
    for i, w in enumerate(WIDTHS):
        t = taps[:, _taps(w)].reshape(-1, w, FILTERS)
        z = t[:, 0].copy()
        for k in range(1, w):  # past the text's end the words are blank
            z[:-k] += np.where(left[:-k, None] > k, t[k:, k], 0)
        z += m.bias[i * FILTERS:(i + 1) * FILTERS]
        np.maximum(z, 0, out=z)
        all_z.append(z)
        pooled.append(segment_reduce(np.maximum, z, offs, np.float32(0)))
    return np.concatenate(pooled, 1), all_z


def logits(m: Model, words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in pieces(offs, PART):
        pooled, _ = convolve(m, embed(m, words[offs[a]: offs[b]]), offs[a: b + 1] - offs[a])
        out.append(pooled.astype(np.float64) @ m.out + m.out_bias)
    return np.concatenate(out)


def languages(m: Model, words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the likeliest language of each text (0 for a text without words)."""
    if m.langs.shape[1] < 2:
        return np.zeros(len(offs) - 1, np.int64)
    return segment_reduce(np.add, m.langs[words[:, 0] % LANG_SLOTS], offs, np.float32(0)).argmax(1)


def scores(m: Model, words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    z = (logits(m, words, offs) - m.thresholds[languages(m, words, offs)]) * m.scale
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def long_logit(m: Model, data: np.ndarray) -> tuple[float, int]:
    """Logit and language of one text, slice by slice."""
    pooled, lang = np.zeros(len(m.bias), np.float32), np.zeros(m.langs.shape[1])
    rest = np.zeros((0, 2 + len(PREFIXES)), np.int32)  # words whose windows reach into the next slice
    for a, b in spans(data, SYMBOLS, TEXT // 4):
        words, _ = word_slots(data[a:b], np.array([0, b - a]))
        lang += m.langs[words[:, 0] % LANG_SLOTS].sum(0, dtype=np.float64)
        rest = np.concatenate([rest, words])
        done = len(rest) if b == len(data) else max(len(rest) - max(WIDTHS) + 1, 0)
        if done:
            _, z = convolve(m, embed(m, rest), np.array([0, len(rest)]))
            pooled = np.maximum(pooled, np.concatenate([v[:done].max(0) for v in z]))
        rest = rest[done:]
    return float(pooled.astype(np.float64) @ m.out + m.out_bias), int(lang.argmax())


def long_score(m: Model, data: np.ndarray) -> float:
    """Score of one text, slice by slice."""
    z, lang = long_logit(m, data)
    return float(1 / (1 + np.exp(-np.clip((z - m.thresholds[lang]) * m.scale, -500, 500))))


# --- training --------------------------------------------------------------------------------------------
def _pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.cumsum([0, *map(len, docs)])


def _step(m: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the weighted log loss: dense parameters, and rows of the embedding table."""
    words, offs = _pack(docs)
    x = embed(m, words)
    pooled, all_z = convolve(m, x, offs)
    p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -50, 50)))
    d = (p - y) * weight / len(docs)
    g = {"out": pooled.T @ d, "out_bias": d.sum(), "filters": np.zeros_like(m.filters), "bias": np.zeros_like(m.bias)}
    d_pool = np.outer(d, m.out) * (pooled > 0)
    rows, grads = [], []
    for i, w in enumerate(WIDTHS):
        part = d_pool[:, i * FILTERS:(i + 1) * FILTERS]
        g["bias"][i * FILTERS:(i + 1) * FILTERS] = part.sum(0)
        f = np.arange(FILTERS)
        kernel = m.filters[:, _taps(w)].reshape(DIM, w, FILTERS)
        gk = g["filters"][:, _taps(w)].reshape(DIM, w, FILTERS)
        for r, (s, e) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
            if e == s or not part[r].any():
                continue
            at = all_z[i][s:e].argmax(0)
            for k in range(w):
                ok = s + at + k < e
                pos = (s + at + k)[ok]
                gk[:, k, f[ok]] += x[pos].T * part[r][ok]
                rows.append(pos)
                grads.append((kernel[:, k, f[ok]] * part[r][ok]).T)
        g["filters"][:, _taps(w)] = gk.reshape(DIM, -1)
    if not rows:
        return g, np.zeros(0, np.int32), np.zeros((0, DIM))
    at = words[np.concatenate(rows)]
    uniq, inv = np.unique(at, return_inverse=True)
    total = np.zeros((len(uniq), DIM))
    np.add.at(total, inv.reshape(-1), np.repeat(np.concatenate(grads), at.shape[1], axis=0))
    return g, uniq, total


class _Steps:
    """Adam for the dense parameters, Adagrad for each row of the embedding table."""

    def __init__(self, m: Model, rate: float):
        self.m, self.rate, self.t = m, rate, 0
        self.dense = {k: [np.zeros_like(np.asarray(getattr(m, k), np.float64)) for _ in range(2)] for k in DENSE}
        if m.second is None:
            m.second = np.zeros((SLOTS, 1), np.float32)

    def take(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One step; the table's rows that it moved."""
        m = self.m
        g, rows, grad = _step(m, docs, y, weight)
        self.t += 1
        for k, (m1, m2) in self.dense.items():
            m1 *= 0.9
            m1 += 0.1 * g[k]
            m2 *= 0.999
            m2 += 0.001 * np.square(g[k])
            step = self.rate * (m1 / (1 - 0.9**self.t)) / (np.sqrt(m2 / (1 - 0.999**self.t)) + 1e-8)
            setattr(m, k, (getattr(m, k) - step).astype(np.float32) if k in ("filters", "bias") else getattr(m, k) - step)
        m.second[rows] += np.square(grad).mean(1, keepdims=True)
        m.table[rows] -= (0.05 * grad / (np.sqrt(m.second[rows]) + 1e-8)).astype(np.float32)
        return rows


def train(docs: list[np.ndarray], y: np.ndarray, lang: list[str | None], seed: int = 5) -> Model | None:
    """Fit on documents given as word rows; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32), rng.normal(0, 0.4, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32),
              np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0.3, 0.2, len(WIDTHS) * FILTERS), -1.0, np.zeros((LANG_SLOTS, 1), np.float32), np.zeros(1), 1.0)
    order = rng.permutation(len(docs))
    val, fit = order[: len(order) // 5], order[len(order) // 5:]
    if len(set(y[val].tolist())) < 2 or len(set(y[fit].tolist())) < 2:
        val = fit = order
    share = y[fit].mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    steps = _Steps(m, 0.01)
    best, kept = -1.0, None
    for _ in range(EPOCHS):
        for i in range(0, len(fit), 32):
            at = fit[i:i + 32]
            steps.take([docs[j] for j in at], y[at], weight[at])
        fit = rng.permutation(fit)
        z = np.concatenate([logits(m, *_pack([docs[j] for j in val[i:i + 64]])) for i in range(0, len(val), 64)])
        rank = np.argsort(np.argsort(z, kind="stable"), kind="stable") + 1
        pos = y[val] > 0
        auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
        if auc > best:
            best, kept = auc, (m.table.copy(), m.filters.copy(), m.bias.copy(), np.array(m.out), float(m.out_bias))
        elif auc < best - 0.02:
            break
    m.table, m.filters, m.bias, m.out, m.out_bias = kept
    m.out_bias = float(m.out_bias)
    calibrate(m, docs, y, lang, val)
    return m


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 of the weighted documents, half-way to the next lower logit."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], weight[order]
    tp, n = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * tp / (n + (y * w).sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # tied logits are on one side
    k = int(f1.argmax())
    return float(z[k] - 1.0 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def _names(langs) -> list[str]:
    names = sorted({x for x in langs if x is not None}) or [""]
    if len(names) > MAX_LANGS:
        raise ValueError(f"{len(names)} languages or more: the model holds a column for at most {MAX_LANGS}")
    return names


def calibrate(m: Model, docs: list[np.ndarray], y: np.ndarray, lang: list[str | None], val: np.ndarray) -> None:
    """Languages by naive Bayes over word hashes; a threshold for each language with enough documents."""
    names = _names(lang)
    counts = np.full((LANG_SLOTS, len(names)), 0.1)
    col = {x: i for i, x in enumerate(names)}
    for d, x in zip(docs, lang, strict=True):
        if x in col:
            counts[:, col[x]] += np.bincount(d[:, 0] % LANG_SLOTS, minlength=LANG_SLOTS)
    m.langs = np.log(counts / counts.sum(0)).astype(np.float32)
    by_part = [(logits(m, *p), languages(m, *p)) for p in (_pack(docs[i:i + 64]) for i in range(0, len(docs), 64))]
    z, by = (np.concatenate(x) for x in zip(*by_part, strict=True))
    unseen = np.zeros(len(docs), bool)
    unseen[val] = True
    everywhere = _threshold(z[unseen], y[unseen], np.ones(unseen.sum()))
    m.thresholds = np.full(len(names), everywhere)
    weight = np.where(unseen, 1.0, 0.25)  # documents the filters were fitted to say less
    for i in range(len(names)):
        own = by == i
        if min((y[own] > 0).sum(), (y[own] == 0).sum()) >= LEAST:
            m.thresholds[i] = _threshold(z[own], y[own], weight[own])
    m.scale = 1.0


# --- Spark -----------------------------------------------------------------------------------------------
def _marks(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``: 1 if any of the document's labels is."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _marked(docs: DataFrame, marks: DataFrame, shards: int | None = None) -> DataFrame:
    """Documents with their marks; with ``shards``, dealt by id into as many partitions (texts are moved once)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if shards:
        rows, marks = (x.dropna(subset="doc_id").repartition(shards, "doc_id") for x in (rows, marks))
    return rows.join(marks, "doc_id")


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
    """Word rows, labels and languages of at most ``max_rows`` labelled documents of each class."""
    marks = _marks(labels)
    one = lambda k: marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _marked(docs, one(1).union(one(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offs = word_slots(*string_buffer(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([words[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], ["doc_id", "lang", "toxic", "words"])

    got = rows.select("text", "doc_id", "lang", "toxic").mapInArrow(run, "doc_id long, lang string, toxic int, words binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    return [np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 2 + len(PREFIXES)) for w in got["words"]], np.array(got["toxic"].to_pylist(), np.float64), got["lang"].to_pylist()


class _Local:
    """What one task learns from a shard: its own steps from the shared start, and words by language."""

    def __init__(self, start: Model, n_langs: int, weights: tuple[float, float]):
        self.start, self.weights, self.n = start, weights, 0
        self.m = replace(start, table=start.table.copy(), second=start.second.copy())
        self.steps = _Steps(self.m, 0.002)
        self.moved = np.zeros(SLOTS, bool)
        self.words = np.zeros((n_langs, LANG_SLOTS), np.int64)
        self.waiting: list[tuple[np.ndarray, float, float]] = []

    def learn(self, batch: pa.RecordBatch) -> None:
        """``text, lang, toxic, fitted`` of documents, in pieces of bounded size."""
        data, offs = string_buffer(batch.column("text"))
        lang, y, fitted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "toxic", "fitted"))
        for a, b in pieces(offs, TEXT):
            whole = data[offs[a]: offs[b]]
            for u, v in [(0, len(whole))] if len(whole) <= TEXT or b > a + 1 else spans(whole, SYMBOLS, TEXT // 4):
                at = offs[a: b + 1] - offs[a] if v - u == len(whole) else np.array([0, v - u])
                words, wo = word_slots(whole[u:v], at)
                for i in range(a, b):
                    own = words[wo[i - a]: wo[i - a + 1]]
                    if lang[i] >= 0:
                        np.add.at(self.words[lang[i]], own[:, 0] % LANG_SLOTS, 1)
                    if fitted[i]:
                        self.waiting.append((own, float(y[i]), self.weights[y[i]] * ((v - u) / len(whole) if v - u < len(whole) else 1)))
                        if len(self.waiting) == 32 or sum(len(w) for w, _, _ in self.waiting) > TEXT // 4:
                            self._step()

    def _step(self) -> None:
        docs, y, weight = zip(*self.waiting, strict=True)
        self.moved[self.steps.take(list(docs), np.array(y), np.array(weight))] = True
        self.n += len(docs)
        self.waiting.clear()

    def out(self) -> Iterator[pa.RecordBatch]:
        """Steps of each range of the table, of the dense parameters (key -1), words of each language (-2, -3, ...)."""
        if self.waiting:
            self._step()
        rows = []
        if self.n:
            at = np.flatnonzero(self.moved).astype(np.int32)
            step = self.m.table[at] - self.start.table[at]
            cut = np.searchsorted(at, np.arange(RANGES + 1) * (SLOTS // RANGES))
            rows = [(r, self.n, at[a:b], step[a:b]) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            rows.append((-1, self.n, np.zeros(0, np.int32), _flat(self.m) - _flat(self.start)))
        for i, n in enumerate(self.words):
            some = np.flatnonzero(n).astype(np.int32)
            rows.append((-2 - i, 0, some, n[some]))
        for key, n, at, value in rows:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([n], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], ["key", "n", "rows", "value"])


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([np.ravel(np.asarray(getattr(m, k), np.float64)) for k in DENSE])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of one key: the mean step of every row by the shards that moved it, of dense parameters by documents; sums of words.

    Steps are rounded to a 2^32nd, so that their sums are exact in any order.
    """
    total = count = None
    for batch in batches:
        for key, n, rows, value in zip(*(batch.column(c) for c in ("key", "n", "rows", "value")), strict=True):
            key, n, at, raw = key.as_py(), n.as_py(), np.frombuffer(rows.as_buffer(), np.int32), value.as_buffer()
            if key >= 0:
                size, weight = SLOTS // RANGES, 1
                got = np.frombuffer(raw, np.float32).reshape(-1, DIM)
                at = at - key * size
            elif key == -1:
                got, weight = np.frombuffer(raw, np.float64)[None], n
                size, at = 1, np.zeros(1, np.int64)
            else:
                got, size, weight = np.frombuffer(raw, np.int64)[:, None], LANG_SLOTS, 1
            if total is None:
                total, count = np.zeros((size, got.shape[1])), np.zeros(size, np.int64)
            total[at] += (np.rint(got * 2.0**32) * 2.0**-32 if key > -2 else got) * weight
            count[at] += weight
    some = np.flatnonzero(count)
    mean = total[some] / count[some, None] if key > -2 else total[some]
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["key", "rows", "value"])


def _fitted(doc_id):
    """Whether a document moves the filters; the others are for the thresholds."""
    return F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(5)) != 0


def learned(docs: DataFrame, marks: DataFrame, start: Model, names: list[str], n: list[int]) -> Model:
    """Go on from ``start`` over shards of all labelled documents (``n`` of each class); filters, table and words of languages, not thresholds."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(start)
    weights = (0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1])
    shards = max(1, round(sum(n) / SHARD))
    lang = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1, F.lit(-1))
    rows = _marked(docs, marks, shards).select("doc_id", "text", lang.alias("lang"), "toxic", _fitted(F.col("doc_id")).alias("fitted"))
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id", F.lit(29)), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = None
        for batch in batches:
            local = local or _Local(shared.value, len(names), weights)
            local.learn(batch)
        if local is not None:
            yield from local.out()

    found = rows.select("text", "lang", "toxic", "fitted").mapInArrow(run, "key int, n long, rows binary, value binary")
    m = replace(start, table=start.table.copy(), second=None)
    counts = np.full((LANG_SLOTS, len(names)), 0.1)
    for r in found.groupBy("key").applyInArrow(_added, "key int, rows binary, value binary").toLocalIterator():
        at, value = np.frombuffer(r.rows, np.int32), np.frombuffer(r.value, np.float64)
        if r.key >= 0:
            m.table[at + r.key * (SLOTS // RANGES)] += value.reshape(-1, DIM).astype(np.float32)
        elif r.key == -1:
            begin = 0
            for k in DENSE:
                old = np.asarray(getattr(m, k))
                new = old + value[begin: begin + old.size].reshape(old.shape)
                setattr(m, k, float(new) if old.ndim == 0 else new.astype(old.dtype))
                begin += old.size
        else:
            counts[at, -2 - r.key] += value
    shared.unpersist()
    m.langs = np.log(counts / counts.sum(0)).astype(np.float32)
    return m


def evidence(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, logit`` of every row's whole text: the likeliest language's index, and the rounded logit."""
    shared = df.sparkSession.sparkContext.broadcast(replace(model, thresholds=np.zeros(model.langs.shape[1]), second=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for a, b in pieces(offs, TEXT):
                if offs[b] - offs[a] > TEXT:
                    z, by = (np.array([x]) for x in long_logit(m, data[offs[a]: offs[b]]))
                else:
                    words = word_slots(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                    z, by = logits(m, *words), languages(m, *words)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "lang": pa.array(by.astype(np.int32)), "logit": pa.array(np.rint(np.clip(z, -30, 30) * GRID) / GRID)})

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang int, logit double")


def _cut(t: pa.Table) -> pa.Table:
    """The threshold of one language (-1: of all), if it has enough documents: by its logits, at most 60 * ``GRID`` + 1."""
    z, p, n, new_p, new_n = (t[c].to_numpy().astype(np.float64) for c in ("logit", "p", "n", "new_p", "new_n"))
    key = t["lang"][0].as_py()
    if key < 0 or min(p.sum(), n.sum()) >= LEAST:
        w = [new_p, new_n] if key < 0 and new_p.any() and new_n.any() else [new_p + 0.25 * (p - new_p), new_n + 0.25 * (n - new_n)]
        seen = np.concatenate(w) > 0
        cut = [_threshold(np.tile(z, 2)[seen], np.repeat([1.0, 0.0], len(z))[seen], np.concatenate(w)[seen])]
    else:
        cut = []
    return pa.table({"lang": pa.array([key] * len(cut), pa.int32()), "cut": pa.array(cut, pa.float64())})


def thresholds(found: DataFrame, marks: DataFrame, n_langs: int) -> np.ndarray:
    """Thresholds of all languages by the logits of all labelled documents in ``found`` (see ``evidence``)."""
    new = ~_fitted(F.col("doc_id"))
    count = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    sums = [count(F.col("toxic") == 1).alias("p"), count(F.col("toxic") == 0).alias("n"), count((F.col("toxic") == 1) & new).alias("new_p"), count((F.col("toxic") == 0) & new).alias("new_n")]
    cells = found.join(marks, "doc_id").groupBy("lang", "logit").agg(*sums)
    every = cells.groupBy(F.lit(-1).alias("lang"), "logit").agg(*[F.sum(c).alias(c) for c in ("p", "n", "new_p", "new_n")])
    got = {r.lang: r.cut for r in cells.unionByName(every).groupBy("lang").applyInArrow(_cut, "lang int, cut double").collect()}
    return np.array([got.get(i, got[-1]) for i in range(n_langs)])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, predicted`` of every document by a model of all labelled ones."""
    marks = _marks(labels).filter("toxic in (0, 1)")
    sizes = _marked(docs, marks).groupBy("lang", "toxic").count().limit(2 * MAX_LANGS + 3).collect()
    n = [sum(r["count"] for r in sizes if r.toxic == k) for k in (0, 1)]
    if not min(n) or max(n) <= MAX_ROWS:
        return score(docs, train(*sample(docs, labels, MAX_ROWS)))
    names = _names(r.lang for r in sizes)
    start = train(*sample(docs, labels.filter(_fitted(F.col("doc_id").cast("long"))), MAX_ROWS)) or train(*sample(docs, labels, MAX_ROWS))
    model = learned(docs, marks, start, names, n)
    found = written(evidence(docs, model), "toxicity")
    cut = F.element_at(F.array(*[F.lit(float(x)) for x in thresholds(found, marks, len(names))]), F.col("lang") + 1)
    p = 1 / (1 + F.exp(cut - F.col("logit")))
    return found.select("doc_id", p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model and replace(model, second=None))  # fixed size but for a column per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for a, b in pieces(offs, TEXT):
                p = np.zeros(b - a)
                if m is not None and offs[b] - offs[a] > TEXT:
                    p[0] = long_score(m, data[offs[a]: offs[b]])
                elif m is not None:
                    p = scores(m, *word_slots(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
