"""Conversation tries against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kerbline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string, depth string, key binary"


def slow(rows):
    """All nodes of [(conv, turn, role, text)] by enumerating prefixes."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(said.get(head, [])[:h] + own[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, held in members.items():
        worth = (len(held) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + worth
    ends = {p: ",".join(str(c) for c in sorted(m) if whole[c] == p) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def nodes(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "clash", b"k") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in pt.conversation_trie(frame, **sizes).collect()), key=lambda r: tuple(-1 if x is None else x for x in r))


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(95, 130), -3, -100, -205, 700, 777, 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 30])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é" * 3, "", None, f"own {c}"])))
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(8)]  # exact copies
    rows += [(900, t, "user", f"w{t % 3}") for t in range(200)]  # one long conversation
    return rows + [(None, 1, "user", "of no conversation"), rows[3], rows[3]]


@pytest.mark.parametrize("width, shard", [(64, 100_000), (2, 40), (3, 7)])
def test_nodes(spark, width, shard):
    rows = made(width)
    assert nodes(spark, rows, width=width, shard=shard) == slow(rows)


def test_turnless_and_empty(spark):
    # Conversation 101 has one turn and takes none from its absent head: nothing is left of it.
    few = [(c, 0, "user", "hi") for c in range(101, 130) if zlib.crc32(str(c).encode()) % 6]
    assert nodes(spark, few) == slow(few)
    assert [r[:7] for r in nodes(spark, few)] == [(few[0][0], 0, None, len(few), 0, 1, 0)]
    assert nodes(spark, []) == [] and nodes(spark, [(None, 0, "user", "x")]) == []


def test_arrays_hold_the_trie():
    rng = random.Random(1)
    for n, kinds in ((1, 2), (300, 4), (2000, 900)):
        found, parent, symbol = {(): 0}, [0], [0]
        for _ in range(n):
            path = ()
            for _ in range(rng.randrange(1, 7)):
                path += (rng.randrange(kinds),)
                if path not in found:
                    parent.append(found[path[:-1]])
                    symbol.append(path[-1])
                    found[path] = len(parent) - 1
        base, check, slot = pt.pack(np.array(parent), np.array(symbol))
        assert len(set(slot.tolist())) == len(slot) and (check >= 0).sum() == len(slot) - 1
        for path, k in found.items():
            state = np.zeros(1, np.int64)
            for s in path:
                state = pt.step(base, check, state, np.array([s]))
            assert state[0] == slot[k]
        missing = [s for s in range(kinds) if (s,) not in found]
        for s in missing[:20]:
            assert pt.step(base, check, np.zeros(1, np.int64), np.array([s]))[0] == -1


def test_long_texts_and_positions_do_not_depend_on_ranges(spark):
    rows = [(5, t, "user", "x" * 100_000 * (t % 3)) for t in range(12)] + [(1, 0, "user", "x" * 500_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted((r.conv_id, r.pos, r.n) for r in pt.positions(frame).collect())
    assert got == sorted((c, t, len(x)) for c, t, _, x in rows)


def test_one_node_with_very_many_ends(spark, monkeypatch):
    monkeypatch.setattr(pt, "_PIECE", 200)
    frame = spark.range(-500, 1500).selectExpr("X'01' AS key", "id AS conv_id").union(spark.range(3).selectExpr("X'02' AS key", "id AS conv_id"))
    got = {bytes(r.key): r.ends_sha256 for r in pt.ends_hashes(frame).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"\1": digest(range(-500, 1500)), b"\2": digest(range(3))}
