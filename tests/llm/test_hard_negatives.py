"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from kerbline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int"


def slow(rows, every=50):
    """Mined rows of [(id, vector, label)] by scoring and sorting everything for each anchor."""
    usable = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in usable]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (anchor, vector, label) in enumerate(usable):
        if anchor % every:
            continue
        ranked = sorted(((-dot(vector, v), i, j) for j, (i, v, _) in enumerate(usable)))
        for p, pid, _ in [x for x in ranked if x[2] != k and usable[x[2]][2] == label][:5]:
            inside = [x for x in ranked if usable[x[2]][2] != label and -50 * p <= -100 * x[0] <= -95 * p]
            out += [(anchor, pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(inside[:3], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def vectors(n, seed, width=6, spread=0.5):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.uniform(-0.3, spread))) for _ in range(width)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


@pytest.mark.parametrize("components, anchors", [(1 << 19, 2048), (300, 2)])
def test_mined_rows(spark, monkeypatch, components, anchors):
    monkeypatch.setattr(hn, "COMPONENTS", components)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rows = vectors(260, 1)
    rows += [(300 + i, rows[0][1], y) for i, y in enumerate([0, 1, 1, 2, None])]  # ties
    rows += [(50, rows[3][1], 0), (50, rows[3][1], 0)]  # repeated ids
    rows += [(None, [0.1], 1), (400, None, 1), (401, [0.1, None], 0), (402, [math.nan] * 6, 0), (403, [math.inf] + [0.0] * 5, 0),
             (450, [], 1), (451, [0.2], 1), (500, [0.0] * 6, 2), (-50, [0.3] * 8, 1)]
    got = sorted(map(tuple, hn.hard_negatives(frame(spark, rows).repartition(3)).collect()))
    assert got == slow(rows) and len(got) > 30


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x * 3.1e6)) for x in v], y) for i, v, y in vectors(120, 2)]
    assert sorted(map(tuple, hn.hard_negatives(frame(spark, rows)).collect())) == slow(rows)
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [2e38, 1.0], 0)]
    assert hn.hard_negatives(frame(spark, huge)).count() >= 0  # scores end at the limits of a LONG


def test_empty_tables_and_columns(spark):
    out = hn.hard_negatives(frame(spark, []))
    assert out.count() == 0
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hn.hard_negatives(frame(spark, [(0, [0.5], 1)])).count() == 0


def test_keys_order_pairs():
    rng = random.Random(3)
    pairs = [(rng.choice([-5, 0, 7]), rng.choice([0, 1]), rng.choice([-2**63 + 1, -1, 0, 4, 2**63 - 1]), rng.random() < 0.5,
              rng.choice([-9, 0, 3]), rng.randrange(4)) for _ in range(500)]
    want = sorted(pairs, key=lambda p: (p[0], p[1], -p[2], p[3], p[4], p[5]))
    assert sorted(pairs, key=lambda p: hn.packed(*p)) == want


def test_iterator_holds_windows_only():
    keys = [hn.packed(1, 0, 100, False, 5, 0), *(hn.packed(1, 0, s, True, s, 0) for s in range(99, 40, -1)), hn.packed(2, 0, 0, False, 9, 0), hn.packed(2, 0, 0, True, 1, 0)]
    given = iter(keys)
    found = hn.negatives_of(given)
    assert [next(found) for _ in range(3)] == [(1, 5, k + 1, 95 - k, 100, 95 - k) for k in range(3)]
    assert list(found) == [(2, 9, 1, 1, 0, 0)]


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 3, 99, 10**18 + 7])
def test_window(score):
    low, high = hn.window(score)
    assert 50 * score <= 100 * low and 100 * (low - 1) < 50 * score
    assert 100 * high <= 95 * score < 100 * (high + 1)
