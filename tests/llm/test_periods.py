"""Periodic runs against brute force over all periods."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from helpers import SF, docs, texts

from tally.llm import periods as P
from tally.llm import queries


def brute(words, min_length=6, min_exponent=4):
    """Start, length, period of all runs, by comparing all words at every distance."""
    n, number, out = len(words), {}, []
    c = np.array([number.setdefault(w, len(number)) for w in words], int)
    for q in range(1, n // min_exponent + 1):
        same = np.concatenate([[False], c[:-q] == c[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            e += q
            if e - s >= max(min_length, min_exponent * q) and not any(np.array_equal(c[s: e - p], c[s + p: e]) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def odd_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice(["a", "b", "A", "é", "<x>"][: rng.randint(1, 5)]) for _ in range(rng.randint(1, 12))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 90)]
        out.append(rng.choice(["", " "]) + rng.choice([" ", "\n", " \t", "\x0b"]).join(words))
    return out


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (2, 4, 8, 64, 2048):
        t = P.Transform(size)
        x, y = rng.integers(0, P.P, (2, 3, size)).astype(np.uint64)
        assert (t.backward(t.forward(x)) == x).all()
        f, g = t.forward(x), t.forward(y)
        got = t.backward(P._mod(f[:, t.negated] * g))
        for r in range(3) if size <= 64 else ():
            assert got[r].tolist() == [sum(int(x[r, i]) * int(y[r, (i + j) % size]) for i in range(size)) % P.P for j in range(size)]


@pytest.mark.parametrize("block", [1, 2, 4, 16])
def test_blocks_occur_where_they_match(block, monkeypatch):
    monkeypatch.setattr(P, "SLAB", 32)
    c = np.array([random.Random(2).choice([0, 1, 1, 5]) for _ in range(150)], np.int64)
    a, d = P.matches(c, block, len(c))
    want = {(i, k) for i in range(0, len(c) - block + 1, block) for k in range(block, 2 * block) if i + k + block <= len(c) and np.array_equal(c[i: i + block], c[i + k: i + k + block])}
    got = set(zip(a.tolist(), d.tolist(), strict=True))
    assert want <= got and all(i + k + block > len(c) for i, k in got - want)


def test_runs_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(3, 120))]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "z z z z z z z"), (7, "a a a a a a"), (7, "a a a a a a"), (503, "a " * 5), (504, "x y z " * 4), (505, "x y z " * 4 + "x y"), (506, "lorem ipsum dolor " * 20_000), (507, "é é é é é é Z")]
    got = P.periodic_runs(docs(spark, rows), carry=("lang", "word")).collect()
    assert len(got) == len(rows) and all(r.carried.lang == "en" and r.carried.word == "k" for r in got)
    seen = sorted(((-1 if r.doc_id is None else r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute(words) if i != 506 else [(0, 60_000, 3)]
        want.append((-1 if i is None else i, runs, collapsed(words, runs)))
    assert seen == sorted(want, key=str) and sum(len(r) for _, r, _ in want) > 100
    assert P.periodic_runs(docs(spark).limit(0)).count() == 0


def test_other_lengths_and_exponents():
    for seed, length, exponent in ((4, 1, 4), (5, 12, 5), (6, 6, 7)):
        for t in odd_texts(seed, 40):
            data = np.frombuffer(t.encode(), np.uint8)
            (runs, _), = P.batch_runs(data, np.array([0, len(data)]), length, exponent)
            assert runs == [r for r in brute(t.encode().split(), length, exponent) if r[1] > 1]
    with pytest.raises(ValueError):
        P.find_runs(np.arange(4), np.array([4]), 6, 3)


def test_unequal_words_of_one_hash(monkeypatch):
    """With hashes that always agree, the words themselves decide."""
    monkeypatch.setattr(P.Stretches, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    for t in odd_texts(7, 30):
        data = np.frombuffer(t.encode(), np.uint8)
        (runs, _), = P.batch_runs(data, np.array([0, len(data)]), 6, 4)
        assert runs == brute(t.encode().split())


def test_texts_numbered_in_slices(monkeypatch):
    text = "aa b  ccc\tdddddddddddddddd\n e f\x0bg " * 5 + "h" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    want = P._numbered(data, 0, len(data), P.Numbers()).tolist()
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(P, "SLICE", size)
        known = P.Numbers()
        assert P._numbered(data, 0, len(data), known).tolist() == want and list(known)[:3] == [b"aa", b"b", b"ccc"]


def test_the_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periods"](spark, SF).collect()}
    assert len(got) == 200
    changed = 0
    for i, t in texts():
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            changed += 1
        runs, r = brute(words), got[i]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert r.n_runs == len(runs) and r.collapsed_sha256 == sha(collapsed(words, runs))
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, None if s is None else 1000 * n // q)
    assert changed > 10 and sum(r.n_runs > 0 for r in got.values()) > 5


def test_memory_of_a_long_text():
    data = np.frombuffer((" ".join(f"w{i % 9973}" for i in range(400_000))).encode(), np.uint8)
    tracemalloc.start()
    (runs, _), = P.batch_runs(data, np.array([0, len(data)]), 6, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs == [(0, 400_000, 9973)] and peak < 200 * 400_000
    print(peak / 400_000)
