"""BPE encoding and decoding, and token counts, against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ROWS, SF, docs, texts
from tokenizers import Tokenizer

from tally.llm import bpe, queries, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    with open(BPE, "rb") as f:
        return bpe.Tokenizer(f.read())


def test_random_texts_encode_and_decode_as_the_library(tok):
    lib, rng = Tokenizer.from_file(BPE), random.Random(1)
    alphabet = [*"aest'rd19.,!_- \n\t\0", "é", "漢", "　", "\x85", "ll", "n't", " the", "<|endoftext|>"]
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["ab" * 500 + " x", "z" * 3000]
    want, got = lib.encode_batch(many, add_special_tokens=False), tok.encode(many)
    assert [w.ids for w in want] == [g.tolist() for g in got]
    back = tok.decode(np.concatenate(got), np.cumsum([0, *map(len, got)])).to_pylist()
    assert back == many


def test_tree_of_rows_and_of_one_word_agree(tok):
    rng = random.Random(2)
    for width in (2, 8, 64):
        rows = [bytes(rng.choice(b"aethinrs ") for _ in range(rng.randint(1, width))) for _ in range(200)]
        assert tok._merge_rows(rows, width) == [tok._merge_long(r) for r in rows]


def test_decode_of_any_ids(spark):
    frame = spark.createDataFrame([(1, [15496, 50256, None, -5, 99999]), (2, None), (3, []), (4, [50255 - 255 + 0, 107, 98])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(frame, BPE).collect()}
    lib = Tokenizer.from_file(BPE)
    assert got == {1: "Hello<|endoftext|>", 2: "", 3: "", 4: lib.decode([50000, 107, 98], skip_special_tokens=False)}


def test_encode_rows(spark):
    lib = Tokenizer.from_file(BPE)
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(docs(spark), BPE).collect()), key=str)
    assert got == sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS), key=str)
    assert bpe.encode(docs(spark).limit(0), BPE).count() == 0


def test_op1_digests(spark):
    lib = Tokenizer.from_file(BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.QUERIES["op1_bpe"](spark, SF).collect()} == want


def test_counts_of_random_texts():
    with open(PIECES, "rb") as f:
        blob = f.read()
    count, lib, rng = token_counts.PieceCounter(blob), sentencepiece.SentencePieceProcessor(model_proto=blob), random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice(" \n\t're.,19aé漢▁　") for _ in range(rng.randint(0, 30)))
        keys = token_counts.pretokens(t)
        assert (int(count.count(keys).sum()) if keys else 0) == len(lib.encode(t)), t


def test_counts_of_rows_in_small_blocks(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((tuple(r) for r in token_counts.token_counts(docs(spark), PIECES, block_bytes=1000).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in ROWS), key=str)
    assert token_counts.token_counts(docs(spark).limit(0), PIECES).count() == 0


def test_op5_counts(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op5_token_counts"](spark, SF).collect()}
    assert got == {(i, len(t.encode()), n := len(lib.encode(t)), n > 4096) for i, t in texts()}
