"""Language ID, toxicity and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import LONG, ROWS, SF, docs, fixture, texts

from tally.llm import common, ctw, langid, queries, toxicity
from tally.llm.common import remainder, word_hashes

SF2 = "/root/testdata/sf0.01"


def _crc(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def test_languages_of_held_out_documents(spark):
    lang = {r[0]: r[2] for r in fixture("documents")}
    got = queries.QUERIES["op2_langid"](spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (_crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    model = langid.fit(docs(spark, [(1, "der die das und"), (2, "the and of with"), (3, None)]))
    assert model.langs == ["en"]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs(spark), model).collect()), key=str)
    assert [(i, l) for i, l, _ in got] == sorted([(i, "en" if t and any(c.isalpha() for c in t) else "und") for i, t in ROWS], key=str)
    assert langid.predict(docs(spark).limit(0), model).count() == 0
    empty = langid.fit(docs(spark).limit(0))
    assert {r.lang_pred for r in langid.predict(docs(spark), empty).collect()} == {"und"}


def test_bayes_by_hand():
    model = langid.Model(["a", "b"], np.log(np.array([[0.9, 0.1], [0.1, 0.9], [1, 1]])).astype(np.float32), np.log([0.5, 0.5]))
    by_order, offs = langid.grams(["xy"], 2)
    n = sum(np.bincount(g, minlength=3) for g in by_order)
    odds = math.log(9) * (n[0] - n[1])
    lang, p = model.score(["xy"])
    assert lang == ["a" if odds >= 0 else "b"] and abs(p[0] - 1 / (1 + math.exp(-abs(odds)))) < 1e-5


def test_long_texts_are_scored_in_slices(monkeypatch):
    """Slices give what the whole text gives, at every length around their borders."""
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("abcdé İ'."), n)) for n in (0, 1, 6, 7, 8, 9, 13, 14, 15, 16, 40, 300)]
    model = langid.Model(["a", "b", "c"], np.log(rng.dirichlet(np.ones(64), 3).T).astype(np.float32), np.log([0.2, 0.3, 0.5]))
    model.matrix = np.vstack([model.matrix, np.zeros((1, 3), np.float32)])
    whole = model.score(made)
    counts = [sum(np.bincount(g, minlength=65)[:64] for g in langid.grams([t], 64)[0]) for t in made]
    monkeypatch.setattr(langid, "SLICE", 7)
    sliced = model.score(made)
    assert whole[0] == sliced[0] and np.allclose(whole[1], sliced[1], rtol=1e-9, atol=0)
    for t, n in zip(made, counts):
        assert np.array_equal(sum(np.bincount(g, minlength=65)[:64] for s in langid.slices(t, 64) for g in s), n)

    docs_ = [toxicity.word_slots(np.frombuffer(f"{w} one two {w} three".encode(), np.uint8), np.array([0, len(f"{w} one two {w} three")]))[0] for w in ("bad", "good", "worse", "fine") * 5]
    m = toxicity.train(docs_, np.array([1.0, 0, 1, 0] * 5), ["x", "y", None, "y"] * 5)
    for size in (8, 12, 32):
        monkeypatch.setattr(toxicity, "TEXT", size)
        for t in [*made, "bad one two", "one, bad! " * 30, "x" * 50, "a bad " + "y" * 60 + " two bad"]:
            data = np.frombuffer(t.encode(), np.uint8)
            want = toxicity.scores(m, *toxicity.word_slots(data, np.array([0, len(data)])))[0]
            assert abs(toxicity.long_score(m, data) - want) < 1e-6


def test_word_hashes_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    texts_ = ["".join(rng.choice(list("ab \n\u00e9"), n)) for n in (0, 5, 40, 0, 1, 17, 90)] + ["w" * 60, " " * 30, ""]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts_)])
    for prefixes in ((), (2, 3)):
        want = word_hashes(data, offs, prefixes=prefixes)
        for size in (1, 4, 16):
            monkeypatch.setattr(common, "WORD_BYTES", size)
            got = word_hashes(data, offs, prefixes=prefixes)
            assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))
        monkeypatch.undo()


def test_gradients_equal_finite_differences(monkeypatch):
    """The step's gradients are those of the weighted log loss."""
    monkeypatch.setattr(toxicity, "SLOTS", 32)
    rng = np.random.default_rng(11)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(rng.normal(size=(32, toxicity.DIM)), rng.normal(size=(toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS)), rng.normal(size=k), rng.normal(size=k) / 5, -0.3, None, None, 1)
    docs_ = [rng.integers(0, 32, (n, 2 + len(toxicity.PREFIXES))) for n in (5, 1, 0, 9)]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.5, 2, 1, 1.5])

    def loss():
        z = toxicity.logits(m, *toxicity._pack(docs_))
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / len(docs_))

    g, rows, table = toxicity._step(m, docs_, y, weight)
    dense = np.zeros_like(m.table)
    dense[rows] = table
    for name, got in (("filters", g["filters"]), ("bias", g["bias"]), ("out", g["out"]), ("table", dense)):
        value = getattr(m, name)
        for at in rng.choice(value.size, 25):
            at = np.unravel_index(at, value.shape)
            old, sides = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = old + step
                sides.append(loss())
            value[at] = old
            assert abs((sides[0] - sides[1]) / 2e-6 - got[at]) < 1e-5, name


def test_thresholds_against_all_cuts():
    rng = np.random.default_rng(12)
    for _ in range(50):
        n = rng.integers(2, 20)
        z, y, w = rng.integers(0, 6, n).astype(float), (rng.random(n) < 0.5).astype(float), rng.choice([0.25, 1.0], n)
        y[0] = 1
        f1 = lambda cut: 2 * (w * y * (z >= cut)).sum() / ((w * (z >= cut)).sum() + (w * y).sum())
        assert np.isclose(f1(toxicity._threshold(z, y, w)), max(f1(c) for c in z))


def test_toxicity_learns_and_is_calibrated(spark):
    marks = {r[0]: r[2] for r in fixture_labels()}
    got = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, SF2).collect()}
    held = [(r.score, marks[i]) for i, r in got.items() if i in marks and r.held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.75 and all(r.predicted == int(r.score >= 0.5) and r.held_out == (_crc(i, 5) == 0) for i, r in got.items())


def fixture_labels():
    import duckdb
    return duckdb.connect().sql(f"select * from '{SF2}/labels.parquet'").fetchall()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 0, 0), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows, y, lang = toxicity.sample(docs(spark), labels)
    assert sorted(y.tolist()) == [0.0, 1.0, 1.0, 1.0] and len(rows) == len(lang) == 4
    model = toxicity.train(rows, y, lang)
    out = toxicity.score(docs(spark), model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.train(rows[:1], y[:1], lang[:1]) is None
    assert {r.score for r in toxicity.score(docs(spark), None).collect()} == {0.0}
    assert toxicity.score(docs(spark).limit(0), model).count() == 0


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """A word that no document of the bounded start holds is learnt, the same however rows are dealt."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(toxicity, "MAX_ROWS", 40)
    monkeypatch.setattr(toxicity, "SHARD", 256)
    rng = np.random.default_rng(3)
    first = {k: {r.id for r in spark.range(1600).filter(F.col("id") % 2 == k).orderBy(F.xxhash64("id"), "id").limit(100).collect()} for k in (0, 1)}
    rows = []
    for i in range(2000):
        words = [f"word{k}" for k in rng.integers(0, 60, 12)]
        if i % 2:
            words[rng.integers(0, 12)] = "foul" if i in first[1] else "vile"
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1600)] + [(5, 0, 0), (7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*rows, (None, "no id vile"), (1, None), (3, LONG + " vile"), (3000, "")])
    got = sorted(map(tuple, toxicity.classify(frame.repartition(3, "text"), labels).collect()), key=str)
    held = [p for i, _, p in got if i is not None and 1600 <= i < 2000]
    assert len(got) == 2004 and np.mean([p == i % 2 for i, _, p in got if i is not None and 1600 <= i < 2000]) > 0.95 and len(held) == 400
    assert got == sorted(map(tuple, toxicity.classify(frame.repartition(7, "doc_id"), labels.repartition(5)).collect()), key=str)


def test_steps_of_shards_are_averaged():
    """Of a table row over the shards that moved it, of dense parameters by documents; words are added."""
    def batch(key, n, at, value):
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "n": pa.array([n], pa.int64()), "rows": pa.array([np.array(at, np.int32).tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})

    def result(*batches):
        t, = toxicity._added(iter(batches))
        return np.frombuffer(t["rows"][0].as_py(), np.int32).tolist(), np.frombuffer(t["value"][0].as_py(), np.float64)

    size, one = toxicity.SLOTS // toxicity.RANGES, np.ones(toxicity.DIM, np.float32)
    at, value = result(batch(2, 9, [2 * size, 2 * size + 3], np.stack([one, one])), batch(2, 1, [2 * size + 3], 3 * one[None]))
    assert at == [0, 3] and value.reshape(2, -1)[:, 0].tolist() == [1, 2]
    assert result(batch(-1, 3, [], np.array([1.0, 2])), batch(-1, 1, [], np.array([5.0, 2])))[1].tolist() == [2, 2]
    at, value = result(batch(-3, 0, [1, 4], np.array([2, 1])), batch(-3, 0, [4], np.array([6])))
    assert at == [1, 4] and value.tolist() == [2, 7]


def test_pooling_against_loops():
    rng = np.random.default_rng(0)
    m = toxicity.Model(rng.normal(size=(8, toxicity.DIM)), rng.normal(size=(toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS)), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), None, 0, None, None, 1)
    x, offs = rng.normal(size=(7, toxicity.DIM)), np.array([0, 2, 2, 7])
    got, _ = toxicity.convolve(m, x, offs)
    for t, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        for i, w in enumerate(toxicity.WIDTHS):
            kernel = m.filters[:, toxicity._taps(w)].reshape(toxicity.DIM, w, toxicity.FILTERS)
            for f in range(toxicity.FILTERS):
                z = [sum(x[s + k] @ kernel[:, k, f] for k in range(w) if s + k < b) + m.bias[i * toxicity.FILTERS + f] for s in range(a, b)]
                assert abs(got[t, i * toxicity.FILTERS + f] - max([0, *z])) < 1e-9


def _brute_ctw(train, text, depth):
    """Context-tree weighting with dictionaries: log10 probability of a text after counting training texts."""
    def events(t):
        b = [255] * depth + list(t.encode().lower()) + [255]
        for i in range(depth, len(b)):
            for j in range(8):
                yield (b[i] >> (8 - j)) | (1 << j), tuple(b[i - depth:i]), (b[i] >> (7 - j)) & 1
    counts = Counter()
    contexts = set()
    for t in train:
        for prefix, ctx, bit in events(t):
            for d in range(depth + 1):
                counts[prefix, ctx[depth - d:], bit] += 1
                contexts.add((prefix, ctx[depth - d:]))
    below = {}
    for prefix, ctx in contexts:
        if ctx:
            below.setdefault((prefix, ctx[1:]), []).append((prefix, ctx))

    def kt(node):
        a, b = counts[(*node, 0)], counts[(*node, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(node)
            memo[node] = own if len(node[1]) == depth else np.logaddexp(own, sum(weighted(c) for c in below.get(node, []))) - math.log(2)
        return memo[node]

    total = 0.0
    for prefix, ctx, bit in events(text):
        p = None
        for d in range(depth, -1, -1):
            node = (prefix, ctx[depth - d:])
            a, b = counts[(*node, 0)], counts[(*node, 1)]
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            stop = math.exp(kt(node) - math.log(2) - weighted(node)) if d < depth else 1
            p = own if p is None else stop * own + (1 - stop) * p
        total += math.log10(p)
    return total


def test_ctw_against_dictionaries(spark):
    rows = [(i, t) for i, t in texts()[:6] if t] + [(100, "Abra cadabra abra"), (101, ""), (102, None)]
    rows = [(i, t[:150] if t else t) for i, t in rows]
    frame = docs(spark, rows)
    for depth in (2, 3):
        got = {r.doc_id: r for r in ctw.lm_scores(frame, remainder(frame.doc_id, 5) == 1, depth=depth, block_bytes=300).collect()}
        train = [t or "" for i, t in rows if _crc(i, 5) != 1]
        for i, t in rows:
            assert abs(got[i].score - _brute_ctw(train, t or "", depth)) < 1e-4 * (1 + len(t or "")), (depth, i)


def test_base_and_edges(spark):
    frame = docs(spark)
    got = sorted(ctw.lm_scores(frame, remainder(frame.doc_id, 5) == 1, block_bytes=100_000).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    toks = sorted(((str(i), [*(t or "").lower().encode().split(), b""], _crc(i, 5) == 1) for i, t in ROWS), key=lambda x: (x[0], len(x[1])))
    c = Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    for r, (i, ws, held) in zip(got, toks, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) <= 1e-9 * abs(base) and r.score < 0
    assert ctw.lm_scores(frame.limit(0), remainder(frame.doc_id, 5) == 1).count() == 0


def test_word_hashes_cut_words_as_specified():
    parts = [b"A b\x0bB", b"", b" \t", "é x A".encode(), b"b"]
    data, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    h, wo = word_hashes(data, offs)
    assert np.diff(wo).tolist() == [3, 0, 0, 2, 1]
    assert h[1] == h[2] == h[5] and h[0] == h[4] and len(set(h.tolist())) == 3


def test_freed_memory_is_given_back():
    """What a worker freed below its last allocation goes back to the system."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    big = np.ones(31 << 17)
    del big  # blocks of up to this size now come from the heap
    parts = [np.ones(1 << 14) for _ in range(1600)]  # 200 MB, in pieces below a last one
    last, before = np.ones(1 << 14), held()
    del parts
    common.released()
    assert held() < before - (150 << 20) and last[0] == 1
