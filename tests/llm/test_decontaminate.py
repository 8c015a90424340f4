"""Decontamination: the automaton against brute-force windows."""

import hashlib
import random
import re

import pytest

from kerbline.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, window=13):
    doc, hit, found = words(text), set(), set()
    for k, (_, item) in enumerate(items):
        w = words(item)
        m = min(window, len(w))
        if m:
            parts = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)}
            for i in range(len(doc) - m + 1):
                if tuple(doc[i:i + m]) in parts:
                    hit |= set(range(i, i + m))
                    found.add(k)
    ids = sorted(str(items[k][0]) for k in found)
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def made_up(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)] + ["é", "Ünder"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, "w0, W1! w2"), (40, None), (41, " .. ")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(8)):
            source = rng.choice(items)[1] or ""
            part = words(source)
            a = rng.randrange(len(part) + 1)
            parts += part[a:a + rng.randrange(20)] + rng.choices(vocab + ["out", "side"], k=rng.randrange(4))
        docs.append((i, rng.choice([" ", ". ", "\n-"]).join(parts).upper() if i % 3 else " ".join(parts)))
    return items, docs + [(100, None), (101, ""), (102, "..."), (5, docs[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_matches_brute_force(seed, monkeypatch):
    items, docs = made_up(seed)
    pairs = [(str(i), [w.encode() for w in words(t)]) for i, t in items if words(t)]
    machine = dc.Automaton(pairs, 13)
    kept = [(i, t) for i, t in items if words(t)]
    for part in (4 << 20, 5, 31):
        monkeypatch.setattr(dc, "_PART", part)
        for _, text in docs:
            n, spans, found = machine.stream(dc.words_of((text or "").encode()))
            want = slow(text, kept)
            assert (n, sum(b - a + 1 for a, b in spans), len(found)) == want[:3]
            assert all(b < c - 1 for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("block", [10, 200_000])
def test_hits(spark, block):
    items, docs = made_up(3)
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.hits(table, bench, ["doc_id"], block=block).collect()
    assert sorted(map(tuple, got)) == sorted((i, *slow(t, items)) for i, t in docs)
    nothing = dc.hits(table, bench.limit(0), ["doc_id"]).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in nothing} == {(0, 0, False)} and len(nothing) == len(docs)
    assert dc.hits(table.limit(0), bench, ["doc_id"], block=block).collect() == []


def test_decontaminate_drops_or_cuts(spark):
    passage = " ".join(f"t{i}" for i in range(20))
    rows = [(1, f"Before it, {passage.upper()}! after."), (2, "clean " * 40), (3, passage + " pad" * 2000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in dc.decontaminate(docs, bench).collect()}
    assert kept == {2: rows[1][1], 3: rows[2][1], 4: None}
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, cut=True).collect()}
    assert cut == {**kept, 1: "Before it, ! after."}
    assert {r.doc_id for r in dc.decontaminate(docs, bench, longest=19).collect()} == {2, 4}
