"""Entropy balancing: targets and rates against brute force, rounding against its bounds."""

import math
import random

import pytest

from kerbline.llm import entropy_mix as mix


def slow_targets(sizes):
    """Share out by rounds until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, out = set(names), 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def slow_multiplier(sizes, target):
    mean = max(1.0, sum(sizes) / len(sizes))
    low, high = -1e5, 1e5
    for _ in range(300):
        mid = (low + high) / 2
        got = sum(s * min(2.0, math.exp(min(700, mid * s / mean))) for s in sizes)
        low, high = (mid, high) if got < target else (low, mid)
    return low / mean


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows, names = [], ["b", "a", "é", None, "Z", "zz", "tiny", "blank"]
    for i in range(700):
        source = "a" if i % 3 == 0 else names[rng.randrange(6)]
        words = int(rng.paretovariate(1.1) * 12)
        rows.append((i, "\x0b".join(["w"] * words), source, "clash"))
    rows += [(1000, None, "blank", "x"), (1001, " \t", "blank", "x"), (1002, "", None, None), (1003, "one two", "tiny", "x")]
    rows += [(5, "same row again", "b", "x")] * 3 + [(None, "no id here", "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string"), rows


@pytest.fixture(scope="module")
def mixed(corpus):
    return mix.mix(corpus[0]).collect()


def test_mix_meets_every_target(spark, corpus, mixed):
    docs, rows = corpus
    got = mixed
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes.setdefault(source, []).append(len((text or "").split()))
    want = slow_targets({s: sum(x) for s, x in sizes.items()})
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.source_size == sum(sizes[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        least = min((s for s in sizes[source] if s), default=0)
        assert 0 <= want[source] - words < max(least, 1) + 1e-6, source
    for r in got:
        if 0 < want[r.source] < 2 * r.source_size * (1 - 1e-9):
            m = slow_multiplier(sizes[r.source], want[r.source])
            assert r.rate == pytest.approx(min(2.0, math.exp(m * r.size)), rel=1e-5, abs=1e-9)
            assert r.copies >= math.floor(r.rate)


def test_many_buckets(spark, corpus, monkeypatch):
    monkeypatch.setattr(mix, "ORDERED", 3)
    got = mix.mix(corpus[0]).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for source, taken, target in ((r.source, r["sum(taken)"], r["max(target)"]) for r in got):
        assert abs(taken - target) < 40, source


def test_sample_repeats_rows_and_reruns_agree(spark, corpus, mixed):
    docs = corpus[0].repartition(5)
    rows = mix.sample(docs)
    assert rows.columns == [*docs.columns, "copy"]
    want = {}
    for r in mixed:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in rows.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table(spark, corpus):
    none = corpus[0].limit(0)
    assert mix.mix(none).collect() == [] and mix.sample(none).collect() == []
