"""Near-copies by shingle sets: kept documents against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from kerbline.llm import near_copies as nc
from kerbline.llm.simhash import simhash


def slow_kept(rows):
    """Least id (NULL last) of each class of [(id, text)] linked at 0.8 or more on five words."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    least = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) and least[i] != least[j]:
                least = [least[j] if k == least[i] else k for k in least]
    groups = {}
    for (i, _), root in zip(rows, least):
        groups.setdefault(root, []).append(i)
    return sorted(map(str, (min(x, key=lambda i: (i is None, i or 0)) for x in groups.values())))


def edited(rng, words, share):
    return [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("often", [4, 1000])
def test_every_similar_pair_is_linked(spark, monkeypatch, often):
    monkeypatch.setattr(nc, "OFTEN", often)
    rng = random.Random(often)
    line = [f"licence{k}" for k in range(30)]
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 6, 40, 300]))] + line
        texts.append(base)
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            texts.append(edited(rng, base, share))
        texts.append(base + [f"t{k}" for k in range(len(base) // 4)])
        texts.append(texts[-2][len(base) // 10:])
    texts = [" ".join(x) for x in texts] + ["", None, " \t", "One two", "one TWO", "one two three", " ".join(line)]
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (None, texts[0]), (None, "alone"), (ids[3], texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == slow_kept(rows)
    assert nc.keep_one(docs.limit(0)).count() == 0


def test_fingerprints_are_simhash_of_the_set(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{i}.{k}" for k in range(rng.choice([1, 5, 6, 80]))).encode() for i in range(30)] + [b""]
    sets = [nc.shingles(x) for x in texts]
    want = simhash(texts, nc.WIDTH)
    assert np.array_equal(nc.fingerprints(sets), want) and want[-1] == 0
    monkeypatch.setattr(nc, "_HASHES", 7)
    assert np.array_equal(nc.fingerprints(sets), want)
    assert nc.fingerprints([nc.shingles(texts[0] + b" " + b"x y " * 90)]) == nc.fingerprints([nc.shingles(texts[0] + b" " + b"x y " * 9)])


@pytest.mark.parametrize("bits", [4, 9])
def test_families_link_fingerprints(spark, bits):
    """A family is what chains of fingerprints within the bound reach, as brute force finds it."""
    rng = random.Random(bits)
    marks = [rng.getrandbits(64) for _ in range(40)]
    marks += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12))) for x in rng.choices(marks, k=160)]
    marks += marks[:3]
    near = [(i, j) for i, x in enumerate(marks) for j, y in enumerate(marks[:i]) if (x ^ y).bit_count() <= bits]
    root = nc.forest(*(np.array(x) for x in zip(*near)), len(marks))
    rows = [(k, int(np.uint64(x).view(np.int64)), 5) for k, x in enumerate(marks)]
    got = {r.node: r.star for r in nc.families(nc.stored(spark.createDataFrame(rows, "node long, fp long, n long"), "test"), bits).collect()}
    assert len(got) == len(marks)
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in got for j in got)


def test_fingerprints_lead_and_nothing_is_lost(spark, monkeypatch):
    """SimHash families reach the exact check first; without any shingle meeting they alone are linked."""
    rng = random.Random(8)
    base = [[f"w{f}.{k}" for k in range(200)] for f in range(6)]
    rows = list(enumerate(" ".join(x) for b in base for x in (b, b[:120] + ["z"] + b[120:], edited(rng, b, 0.01))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls, found = [], nc.fingerprint_links
    monkeypatch.setattr(nc, "fingerprint_links", lambda marks, radius: calls.append(radius) or found(marks, radius))
    assert sorted(str(r.doc_id) for r in nc.keep_one(docs).collect()) == slow_kept(rows)
    assert calls == [nc.BITS]
    real = nc.meetings
    monkeypatch.setattr(nc, "meetings", lambda entries: real(entries.limit(0)))
    alone = {r.doc_id for r in nc.keep_one(docs).collect()}
    assert {int(x) for x in slow_kept(rows)} <= alone < {i for i, _ in rows}


def test_meetings_of_ranges(spark):
    """One h in half of all rows, whatever the ranges and batches it is dealt in."""
    rng = random.Random(1)
    rows = [(rng.randrange(60) if rng.random() < 0.5 else 7, k, k, k) for k in range(400)] + [(1000, 1, 1, 1), (-5, 3, 3, 3)]
    nodes = {}
    for h, node, *_ in rows:
        nodes.setdefault(h, []).append(node)
    want = sorted((h, node, min(nodes[h])) for h, node, *_ in rows if len(nodes[h]) > 1)
    frame = spark.createDataFrame(rows, "h long, node long, n long, p long")
    try:
        for parts, batch in ((8, 10_000), (3, 5), (40, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = sorted((r.h, r.node, r.hub) for r in nc.meetings(frame).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_set_links_are_a_forest_of_all_similar_pairs(monkeypatch):
    monkeypatch.setattr(nc, "_CELLS", 64)
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, 40)) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[k % 4], 38, False), rng.integers(0, 2**63, rng.integers(0, 5))])).astype(np.uint64) for k in range(30)]
    for cut in (None, 11):
        near = [(i, j) for i in range(30) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
                and (cut is None or j < cut <= i)]
        u, v = nc.set_links(sets, cut)
        assert np.array_equal(nc.forest(u, v, 30), nc.forest(*(np.array(x) for x in zip(*near)), 30)) and len(u) < len(near)


@pytest.mark.parametrize("tile, marks", [(1024, 1 << 20), (3, 1 << 20), (1024, 300)])
def test_large_family_in_tiles(spark, monkeypatch, tile, marks):
    """Half of all rows are near-copies of one text, many of them just below the similarity."""
    monkeypatch.setattr(nc, "TILE", tile)
    monkeypatch.setattr(nc, "MARKS", marks)
    rng = random.Random(tile)
    family = [f"w{k}" for k in range(90)]
    texts = [" ".join(edited(rng, family, 0.02)) for _ in range(60)] + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(r.doc_id) for r in nc.keep_one(docs).collect()) == slow_kept(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_what_stars_leave_open_never_becomes_rows_of_pairs(spark, monkeypatch, rounds):
    """Every star holds one node: all links are left to open shingles, the largest first or one by one."""
    def alone(met, *_):
        return stored(met.groupBy("node").agg(nc.F.first("n").alias("n")).selectExpr("node", "node AS star", "n"), "stars")

    def noted(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, label)

    plans, stored = [], nc.stored
    monkeypatch.setattr(nc, "stored", noted)
    monkeypatch.setattr(nc, "star_of", alone)
    monkeypatch.setattr(nc, "moved", lambda met, stars: stars)
    monkeypatch.setattr(nc, "REGATHERED", rounds, raising=False)
    rng = random.Random(rounds)
    families = [[f"w{f}.{k}" for k in range(90)] for f in range(3)]
    texts = [" ".join(edited(rng, family, 0.02)) for family in families for _ in range(20)]
    texts += [" ".join(families[f][k:k + 45] + families[f - 1][:30]) for f in range(3) for k in range(5)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(r.doc_id) for r in nc.keep_one(docs).collect()) == slow_kept(rows)
    assert not any(re.search(r"Join .*node#\d+L < node#\d+L", x) for x in plans)


def test_unsettled_shingles(spark):
    """Open is what has several roots and several stars in each layout."""
    nodes = [(1, 1, 1, 5), (2, 1, 2, 6), (3, 3, 2, 7), (4, 4, 4, 7), (5, 5, 1, 8)]
    groups = {10: [1, 2], 11: [2, 3], 12: [3, 4], 13: [1, 3], 14: [1, 2, 3, 4], 15: [1, 5]}
    entries = [(h, node, 9) for h, x in groups.items() for node in x]
    left = nc.unsettled(spark.createDataFrame(entries, "h long, node long, n long"),
                        spark.createDataFrame(nodes, "node long, root long, star long, star_0 long"), ["star", "star_0"])
    assert sorted((r.h, r.node) for r in left.collect()) == [(13, 1), (13, 3), (14, 1), (14, 2), (14, 3), (14, 4)]
    assert sorted((r.node, r.star) for r in nc.regathered(left).collect()) == [(1, 14), (2, 14), (3, 14), (4, 14)]


def test_sizes_cut_no_pair_that_can_be_similar(spark):
    """Of one h, sizes at a factor of 1.25 or less meet; those far apart do not."""
    sizes = [*range(1, 60), 100, 125, 126, 400, 500, 4000, 5000]
    groups = {}
    for r in nc.by_size(spark.createDataFrame([(7, k, n) for k, n in enumerate(sizes)], "h long, node long, n long")).collect():
        groups.setdefault(r.h, set()).add(r.n)
    met = {(a, b) for x in groups.values() for a in x for b in x}
    assert all((a, b) in met for a in sizes for b in sizes if 4 * b <= 5 * a and a <= b)
    assert not any((a, b) in met for a in sizes for b in sizes if b > 1.6 * a)


def test_shingles_of_the_same_nodes_are_one_star(spark):
    left = [(h, node, 9, 1) for h, x in {1: [1, 2], 2: [2, 1], 3: [1, 2, 3]}.items() for node in x]
    stars = {}
    for r in nc._alike(spark.createDataFrame(left, "h long, node long, n long, star long")).collect():
        stars.setdefault(r.star, []).append(r.node)
    assert sorted(map(sorted, stars.values())) == [[1, 2], [1, 2, 3]]


def test_stage_links_what_differs_in_more_than_four_bits(spark, small_sf):
    docs = cp.documents(spark, small_sf)
    got = sorted(str(r.doc_id) for r in cp.near_duplicates(spark, docs, small_sf).collect())
    assert got == slow_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert "1" in got and "177" not in got  # 0.8 alike, more than four bits apart


def overlap_sets(rng, n, others):
    """Hash sets of about ``n`` at Jaccard similarities from none to all with the first, and unrelated ones."""
    first = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
    sets = [np.unique(first)]
    for share in [0, 0.02, 0.08, 0.1, 0.11, 0.12, 0.2, 0.5, *[1] * others]:
        fresh = np.array([rng.getrandbits(64) for _ in range(round(share * n))], np.uint64)
        sets.append(np.unique(np.concatenate([first[len(fresh):], fresh])))
    return [*sets, np.unique(first[:n * 4 // 5]), np.unique(first[:n * 4 // 5 - 1])]


@pytest.mark.parametrize("n", [1, 5, 60, 64, 65, 120, 600, 3000])
def test_parities_rule_out_no_similar_pair(n):
    rng = random.Random(n)
    sets = [*overlap_sets(rng, n, 5), np.zeros(0, np.uint64)]
    fresh = sets[9:14]
    sets = [*{x.tobytes(): x for x in sets}.values()]
    size = np.array([len(x) for x in sets])
    bits = [nc.parity(x) for x in sets]
    similar = np.array([[5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for y in sets] for x in sets])
    apart = ~np.eye(len(sets), dtype=bool)
    nodes = np.arange(len(sets))
    got = nc.may_link(bits, size, nodes)
    assert got[(similar & apart).any(axis=1)].all()
    if n >= 60:  # unrelated sets are ruled out
        assert not any(got[k] for k, x in enumerate(sets) if any(np.array_equal(x, y) for y in fresh))
    cut = len(sets) // 3
    across = (nodes[:, None] < cut) != (nodes[None] < cut)
    got = nc.may_link(bits, size, nodes, cut)
    assert got[(similar & across).any(axis=1)].all()
    assert not nc.may_link(bits, size, np.zeros(len(sets), int)).any()  # linked by now


@pytest.mark.parametrize("tile", [4, 1024])
def test_texts_that_share_one_line_only_do_not_travel(spark, monkeypatch, tile):
    sent, links = [], nc.star_links

    def noted(kept, stars, *names):
        sent.append(stars.count())
        return links(kept, stars, *names)

    monkeypatch.setattr(nc, "star_links", noted)
    monkeypatch.setattr(nc, "TILE", tile)
    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng = random.Random(tile)
    line = " ".join(f"licence{k}" for k in range(12))
    texts = [line + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " less"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r.doc_id) for r in nc.keep_one(docs).collect()) == slow_kept(rows) == sorted(map(str, range(60)))
    assert sum(sent) <= 12
