"""Co-training: features by hand, pseudo-labels between views, held-out accuracy, odd inputs."""

import random

import numpy as np
import pytest

from kerbline.llm import cotrain_quality as cq


def test_shape_counts_trigrams(monkeypatch):
    texts = ["", None, "Ab 1.\nc|%é", "abc abc\nabc abc\n", "x"]
    kinds = {"A": 3, "b": 2, " ": 0, "1": 4, ".": 5, "\n": 1, "c": 2, "|": 8, "%": 9, "é": 2}
    got = cq.shape(texts)
    line = [kinds[c] for c in texts[2]]
    want = np.zeros(11 ** 3)
    for a, b, c in zip(line, line[1:], line[2:]):
        want[(a * 11 + b) * 11 + c] += 1
    assert np.allclose(got[2, cq._STATS:] ** 2, want / len(line), atol=1e-6)
    assert not got[:2].any() and not got[4, cq._STATS:].any()
    assert got[3, 0] == pytest.approx(3 / 4) and got[3, 4] == pytest.approx(1 / 2)
    monkeypatch.setattr(cq, "_ROWS", 1)
    assert np.array_equal(cq.shape(texts), got)


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    n, pool = 120, 600
    y, hidden = rng.integers(0, 2, n), rng.integers(0, 2, pool)

    def seen(labels, strength):
        return (labels[:, None] * strength + rng.normal(size=(len(labels), 12))).astype(np.float32)

    xs, more = (seen(y, 2.0), seen(y, 2.0)), (seen(hidden, 2.0), seen(hidden, 2.0))
    apart = np.arange(n) % 4 == 0
    taught = cq.cotrain(xs, y, np.ones(n), apart, more)
    alone = cq.cotrain(xs, y, np.ones(n), apart, more, rounds=0)
    truth = rng.integers(0, 2, 2000)
    fresh = seen(truth, 2.0), seen(truth, 2.0)
    right = [[np.mean((v.odds(x) > 0) == truth) for v, x in zip(views, fresh)] for views in (alone, taught)]
    assert min(right[1]) > 0.95 and min(right[1]) >= min(right[0]) - 0.01
    # A view of noise is never sure and teaches nothing.
    noise = rng.normal(size=(n, 12)).astype(np.float32), rng.normal(size=(pool, 12)).astype(np.float32)
    _, blind = cq.cotrain((xs[0], noise[0]), y, np.ones(n), apart, (more[0], noise[1]))
    assert np.abs(blind.odds(noise[1])).max() < 4


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioultnrs", k=rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randint(10, 120))
        bad = i % 5 == 0
        text = [w + "%$" for w in text] if bad and i % 2 else [text[0]] * len(text) if bad else text
        rows.append((i, " ".join(text).capitalize() + ".", "en", "good" if not bad or i % 4 else "bad", len(text), int(not bad)))
        if i % 3:
            marks.append((i, int(not bad), 0))
    rows += [(600, None, None, None, None, 1), (601, "", None, None, 0, 1), (None, "no id at all here", "en", None, -5, 1), (*rows[7],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    return docs, spark.createDataFrame([*marks, (4, None, 1), (None, 1, 1), (77_777, 0, 1)], "doc_id long, quality int, toxic int"), rows


def test_scores(spark, corpus):
    docs, labels, rows = corpus
    got = cq.rated(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[5] for r in rows}
    assert np.mean([r.accepted == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 600]) > 0.98
    assert all(0 <= v <= 1 for r in got for v in (r.score, r.content_score, r.metadata_score))
    kept = cq.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.accepted)
    assert cq.accepted(docs.limit(0), labels).count() == 0
    assert {r.score for r in cq.rated(docs, labels.limit(0)).collect()} == {0.5}
    assert cq.rated(docs, labels.filter("quality = 1")).filter("NOT accepted").count() == 0
