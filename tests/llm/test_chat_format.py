"""Chat formatting: exact round trips, masks, long conversations in pieces."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbline.llm import chat_format as cf

PARTS = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "<<ROLE:", ">>\n", "<</ROLE>>", "\\", "<", "[", ">", "é", " ", "\n", "s>", "x"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "tool", ""]) | TEXT


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=5), min_size=1, max_size=4))
def test_round_trip(chats):
    turns = [(r.encode(), t.encode()) for chat in chats for r, t in chat]
    firsts = np.cumsum([0, *map(len, chats[:-1])])
    formatted, loss = cf.assemble([r for r, _ in turns], [t for _, t in turns], firsts)
    for chat, text, spans in zip(chats, formatted.to_pylist(), loss.to_pylist()):
        raw = text.encode()
        assert [(r.decode(), t.decode()) for r, t in cf.read_turns(raw)] == chat
        assert [cf.unescape(raw[s["start"]:s["end"]]).decode() for s in spans] == [t for r, t in chat if r == "assistant"]
        for _, said in chat:
            assert not any(mark in cf.escape(said.encode()) for mark in cf.CONTROL)


def want(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = sum(len((a + cf.escape(t.encode()) + b).decode()) for r, t in turns for a, b in [cf.marks(r.encode())])
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(said), hashlib.sha256(said.encode()).hexdigest(), whole))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [1, 300, 4 << 20])
def test_chats(spark, piece, monkeypatch):
    rng = random.Random(piece)
    rows = [(rng.randrange(12), rng.randrange(40), rng.choice(["user", "assistant", "tool", None]),
             "".join(rng.choices(PARTS, k=rng.randrange(30)))) for _ in range(200)]
    rows += [(3, 7, "user", "tie"), (3, 7, "user", "tie"), (None, 1, "user", "who"), (None, None, None, None), (90, 1, "assistant", None)]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    old, cf.PIECE = cf.PIECE, piece
    try:
        source = cf._format
        monkeypatch.setattr(cf, "_format", lambda b, n: (setattr(cf, "PIECE", piece), source(b, n))[1])
        got = cf.read_back(cf.format_chats(chats)).collect()
        assert sorted((tuple(r) for r in got), key=str) == want(rows)
    finally:
        cf.PIECE = old
    assert cf.read_back(cf.format_chats(chats.limit(0))).collect() == []
