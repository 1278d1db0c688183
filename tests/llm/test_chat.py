"""Chat formatting: exact round trips, and order and digests against plain loops."""

import hashlib
import random

import pytest
from helpers import fixture
from hypothesis import given, settings
from hypothesis import strategies as st

from tally.llm import chat, queries
from tally.llm.chat import INSTRUCT, Machine, Template

PIECES = ["[INST]", "[/INST]", "</s>", "[OUT]", "[ROLE]", "[TEXT]", "\\", "[\\INST]", "[", "INST]", "<", "/s>", " ", "\n", "é", "漢", "a", ""]
SCHEMA = "conv_id long, turn int, role string, text string, part string, seq long, segments int, whole string"


def brute(rows):
    """conv_id -> digests and errors, by plain loops."""
    convs, out = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        state, bad = "", []
        for i, (_, _, r, _) in enumerate(turns, 1):
            if r not in INSTRUCT.order.get(state, ()):
                bad.append(i)
            state = r if r in INSTRUCT.order else state
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        formatted = "".join(t for *_, r, x in turns for t, _ in chat.segments(r, x, INSTRUCT))
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), len(formatted), len(bad), bad[0] if bad else None, state == "assistant")
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "p", 1, 2, "w") for r in rows], SCHEMA)
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.text()), st.lists(st.sampled_from(PIECES)).map("".join) | st.text())))
def test_round_trip(turns):
    segments = [s for r, x in turns for s in chat.segments(r, x, INSTRUCT)]
    formatted = "".join(t for t, _ in segments)
    assert list(chat.parse(formatted, INSTRUCT)) == turns
    assert "".join(chat.unescape(t) for t, loss in segments if loss) == "".join(x for r, x in turns if r == "assistant")
    for r, x in turns:
        assert not any(c in chat.escape(x, INSTRUCT) for c in INSTRUCT.controls)


def test_another_template():
    t = Template(marks={"user": ("<|user|>", "<|end|>"), "bot": ("<|bot|>", "<|end|>")}, named=("<|as|>", "<|says|>", "<|end|>"), trained=frozenset({"bot"}), order={"": ("user",), "user": ("bot",), "bot": ("user",)}, last=frozenset({"bot"}), pad="\n")
    turns = [("user", "<|end|>\\"), ("bot", "\n<|user|>x"), ("narrator <|says|>", "")]
    assert list(chat.parse("".join(s for r, x in turns for s, _ in chat.segments(r, x, t)), t)) == turns
    for marks in ({"user": ("[A]", "[A[B]")}, {"user": ("a\\", "bc")}, {"user": ("[", "]")}):
        with pytest.raises(ValueError):
            Template(marks=marks, named=t.named, trained=t.trained, order=t.order, last=t.last)


@pytest.mark.parametrize("text", ["x[INST] a [/INST]", "[INST] a", "[INST]a [/INST]", "[INST] a [/SYS]", "[/INST] a ", "[ROLE] a [/ROLE]", "[INST] a </s> [/INST]"])
def test_other_text_is_refused(text):
    with pytest.raises(ValueError):
        list(chat.parse(text, INSTRUCT))


def test_moves_compose():
    rng = random.Random(1)
    for _ in range(200):
        roles = [rng.choice(["user", "assistant", "system", "tool", ""]) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(roles))
        whole, a, b = (Machine(INSTRUCT) for _ in "abc")
        for m, some in ((whole, roles), (a, roles[:cut]), (b, roles[cut:])):
            for r in some:
                m.step(r)
        a.then(b.turns, b.moves)
        assert a.moves == whole.moves and a.turns == whole.turns


def test_conversations_against_loops(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(30))])) for t in range(rng.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"{t} </s>") for t in range(3000)]  # a third of a table and more
    rows += [(101, 5, "user", "same turn")] * 50 + [(101, 5, "assistant", "same turn"), (101, None, "system", "no turn"), (None, 1, "user", "no id"), (None, 2, "assistant", "no id")]
    rows += [(102, 0, "user", "q"), (102, 1, "assistant", "long " * 400_000)]
    rng.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(chat, "PART_CHARS", 200)  # many parts
    assert run(spark, rows) == want
    assert run(spark, []) == {}


def test_parts_are_the_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b [INST]"), (2, 0, "tool", "c")]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    text = {c: "".join(s.text for p in sorted(parts, key=lambda p: (p.turn, p.seq)) if p.conv_id == c for s in p.segments) for c in (1, 2)}
    assert text == {1: "[INST] a [/INST][OUT] b [\\INST] </s>", 2: "[ROLE] tool [TEXT] c [/ROLE]"}
    assert [s.text for p in parts for s in p.segments if s.loss] == ["b [\\INST]"]


def test_the_query(spark):
    tricky = "</s>[INST] ok [/INST]"
    want = brute([*fixture("conversations"), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_chat"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and got[-7][:3] == (2, hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest(), len(tricky))
