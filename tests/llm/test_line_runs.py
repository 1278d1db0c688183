"""Line dedup against all repeated runs of lines, without the chunker."""

import random
from collections import Counter

from helpers import docs, texts
from pyspark.sql import functions as F

from tally.llm import linededup, queries


def brute_runs(rows):
    """Texts without the lines of runs of two or more lines that occur before without sharing a line."""
    first, out = {}, {}
    for key, h, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 1):
            d, x, j = first.setdefault((lines[i], lines[i + 1]), (key, h, i))
            if (d, x) != (key, h) or i >= j + 2:
                gone |= {i, i + 1}
        out[key, h] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_planted_passages_of_every_length_go(spark):
    rng, rows, want = random.Random(11), [], {}
    for n in (2, 3, 4, 5, 8, 40):
        passage = [f"passage {n} {i}" for i in range(n)]
        for copy in range(4):
            head, tail = ([f"own {rng.random()}" for _ in range(rng.randint(1, 4))] for _ in "ab")
            key = len(rows)
            rows.append((key, "\n".join([*head, *passage, *tail])))
            want[key] = "\n".join([*head, *(() if copy else passage), *tail])
    got = linededup.dedup_runs(docs(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_runs_against_brute_force(spark):
    rng = random.Random(12)
    odd = [(i % 25, "\n".join(rng.choice("aabcdefgh") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    odd += [(3, "a\nb"), (3, "a\nb"), (None, "a\nb\nc"), (77, None), (78, ""), (79, "\n" * 200), (80, "z\nz\nz"), (81, "lone"), (82, "lone")]
    for rows in (odd, texts()):
        frame = docs(spark, rows)
        hashed = [(r.doc_id, r.h, r.text) for r in frame.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
        want = brute_runs([r for r in hashed if r[2] is not None])
        got = linededup.dedup_runs(frame, carry=("lang", "word")).collect()
        assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == Counter((i, *(want[i, h] if t is not None else (None, 0))) for i, h, t in hashed)
        assert all(r.carried.lang == "en" and r.carried.word == "k" for r in got)
    assert linededup.dedup_runs(docs(spark).limit(0)).count() == 0


def test_equal_hashes_of_unequal_pairs(spark, monkeypatch):
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb")]

    def table(rows):
        return rows.filter("text is not null").select("doc_id", "text_hash", F.lit(0).alias("place"), F.lit(None).cast("int").alias("chunk"), F.lit(42).cast("long").alias("h"))

    monkeypatch.setattr(linededup, "pair_table", table)
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_runs(docs(spark, rows)).collect()) == [(1, "a\nb"), (2, "c\nd"), (3, "")]


def test_chunks_carry_most_of_the_work(spark):
    """Whole repeated chunks go at the first level; of a copy, the second level sees only pairs across boundaries."""
    rng = random.Random(13)
    passage = "\n".join(f"line {rng.random()}" for _ in range(60))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(5)]
    frame = docs(spark, rows).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    gone = linededup.repeated_chunks(frame).collect()
    sizes = {i: [n for _, n, _ in linededup.chunks(t, linededup.RUN_DIVISOR)] for i, t in rows}
    lines = {i: sum(sizes[i][r.chunk] for r in gone if r.of == i) for i, _ in rows}
    assert lines[0] == 0 and all(30 < lines[i] <= 60 for i in range(1, 5))
    pairs = linededup.pair_table(frame).collect()
    inside = [r for r in pairs if (r.doc_id, r.chunk) in {(g.of, g.chunk) for g in gone}]
    assert len(inside) > 100 and all(r.chunk is None or sizes[r.doc_id][r.chunk] >= 2 for r in pairs)
    got = {r.doc_id: r.text for r in linededup.dedup_runs(docs(spark, rows)).collect()}
    assert got == {i: t if i == 0 else f"own {i}\nend {i}" for i, t in rows}


def test_chunks_of_one_hash_and_unequal_bytes(spark, monkeypatch):
    """Chunks are told apart by their bytes."""
    real = linededup.chunk_table
    monkeypatch.setattr(linededup, "chunk_table", lambda rows, divisor, bodies: real(rows, divisor, bodies).withColumn("h", F.lit(1).cast("long")))
    test_planted_passages_of_every_length_go(spark)


def test_the_query_removes_runs(spark):
    from helpers import SF
    rows = {r.doc_id: r.h for r in spark.createDataFrame(texts(), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("h")).collect()}
    want = {i: t for (i, _), (t, _) in brute_runs([(i, rows[i], t) for i, t in texts()]).items()}
    assert {r.doc_id: r.text for r in queries.QUERIES["op9_line_dedup"](spark, SF).collect()} == want


def test_the_pipeline_stage_removes_runs(spark):
    import corpus_pipeline
    df = docs(spark, texts()).select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r.doc_id, r.h, r.text) for r in df.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, None)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for (i, _), (t, _) in brute_runs(rows).items()}
