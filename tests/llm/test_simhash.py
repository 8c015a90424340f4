"""SimHash: fingerprints and classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from kerbline.llm import simhash as sh
from kerbline.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_classes(marks):
    """Least id reachable for [(id, fingerprint)] at four or fewer bits."""
    least = {i: i for i, _ in enumerate(marks)}
    done = False
    while not done:
        done = True
        for i, (_, x) in enumerate(marks):
            for j, (_, y) in enumerate(marks):
                if (x ^ y).bit_count() <= 4 and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    done = False
    groups = {}
    for i, root in least.items():
        groups.setdefault(root, []).append(marks[i][0])
    return {i: min((x for x in groups[root] if x is not None), default=None) for i, root in least.items()}


TEXTS = ["", None, "  \t\n", "One", "one two three", "one two three four", "ONE two three four five",
         "é one Two\x0bthree four five six É", "a b c d " * 50]


def test_fingerprints_match_brute_force():
    got = sh.simhash([(t or "").encode() for t in TEXTS])
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in TEXTS]


def test_long_texts_are_cut_without_change(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(3000)) + "   x"
    want = slow_fingerprint(text)
    for part in (1, 7, 64, 5000):
        monkeypatch.setattr(sh, "_PART", part)
        monkeypatch.setattr(sh, "_HASHES", 100)
        assert int(sh.simhash([text.encode()])[0]) == want
    assert int(sh.simhash([b"one two"])[0]) == slow_fingerprint("one two")


def near_copies(rng, n):
    marks = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(marks)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        marks.append(x)
    return [0, 1, *marks]


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_lose_nothing(spark, tile):
    rng = random.Random(tile)
    marks = sorted(set(near_copies(rng, 150)))
    signed = [(int(np.uint64(x).view(np.int64)),) for x in marks]
    table = spark.createDataFrame(signed, "fp long").repartition(4)
    linked = sh.links(table, tile=tile).collect()
    for a, b in linked:
        assert (a ^ b) & ((1 << 64) - 1)
    got = sh.forest(*np.array([[signed.index((a,)), signed.index((b,))] for a, b in linked]).T, len(signed))
    want = slow_classes(list(enumerate(marks)))
    assert got.tolist() == [want[i] for i in range(len(marks))]


def test_layouts_cover_the_radius():
    for n in (10, 1 << 25, 1 << 34, 1 << 44):
        blocks, choices = sh._cells(n, 4)
        assert {len(c) for c in choices} == {blocks - 4}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    table = spark.createDataFrame(links, "a long, b long")
    got = dict(components(table).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}}
    assert components(table.limit(0)).count() == 0


def test_near_duplicates_and_keep_one(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [(9, base, "x"), (4, base, "y"), (4, base, "y"), (None, base, "n"), (7, base + " tail", "z"), (1, "", "e"),
            (2, None, "e"), (None, "alone one two three four five", "q"), (11, "other words here in this text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(sh.near_duplicates(docs).collect(), key=str)
    marks = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = slow_classes(marks)
    assert sorted(map(tuple, got), key=str) == sorted(((i, f"{m:016x}", want[k]) for k, (i, m) in enumerate(marks)), key=str)
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({want[k] for k in range(len(rows))}, key=str)
    assert sh.near_duplicates(docs.limit(0)).count() == 0
    assert sh.keep_one(docs.limit(0)).count() == 0
