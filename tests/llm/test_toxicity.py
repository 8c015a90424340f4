"""Toxicity: n-gram rates against a plain count, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from kerbline.llm import toxicity as tox


def test_rates_match_a_plain_count(monkeypatch):
    texts = ["", None, "Ab c\n\tAB  c", "é" * 5, "x" * 900 + " end"]
    want = {}
    for k, text in enumerate(texts):
        line = tox.normal(text)
        for n in tox.SIZES:
            for i in range(len(line) - n + 1):
                want[k, line[i:i + n]] = want.get((k, line[i:i + n]), 0) + 1
    for part in (1 << 20, 3, 50):
        monkeypatch.setattr(tox, "_PART", part)
        number, _, rate = tox.rates(texts)
        for k, text in enumerate(texts):
            full = max(len(tox.normal(text)), tox.SHORT)
            expected = sorted(min(c * 1000 / full, tox.HIGH) for (j, _), c in want.items() if j == k)
            assert np.allclose(sorted(rate[number == k]), expected)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioultnrs", k=rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(5, 120))
        bad = i % 5 == 0
        for _ in range(len(text) // 12 + 1 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["blorgh", "zquax", "Vrumpf"])
        rows.append((i, " ".join(text), "en", "s", int(bad)))
        if i % 4:
            marks.append((i, 1, int(bad)))
    rows += [(1000, "", None, None, 0), (1001, None, None, None, 0), (None, "blorgh you zquax", "x", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label int")
    return docs, spark.createDataFrame([*marks, (3, None, None), (None, 1, 1), (77_777, 1, 1)], "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(spark, corpus):
    docs, labels, rows = corpus
    got = tox.held_out(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[4] for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id is not None]
    assert np.mean([a == b for a, b in held]) > 0.97
    flipped = labels.withColumn("toxic", tox.F.when(tox.crc_mod("doc_id", 3) == 1, 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    again = tox.held_out(docs.repartition(5).drop("lang"), flipped).collect()
    key = lambda r: (str(r.doc_id), round(r.score, 3))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_without_labels_or_rows(spark, corpus):
    docs, labels, rows = corpus
    none = tox.held_out(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert tox.held_out(docs.limit(0), labels).collect() == []
