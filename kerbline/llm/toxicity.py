"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, runs of blanks become one, and n-grams of code points (blanks at words'
ends included) are hashed. A feature's value is its rate in the text times the log of the
ratio of its smoothed rates in toxic and other texts; a logistic regression on the features
that separate best gives the score.

The model is fitted on at most ``TOXIC`` toxic and ``OTHER`` other labelled texts, those with
the least hash of their id; every text is scored whole. Only texts go into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import crc_mod, pieces, stored

#: Most labelled texts of either kind that the model is fitted on.
TOXIC, OTHER = 3000, 6000
SIZES = (4, 5, 6)
BITS = 18
FEATURES = 2048
#: Rates are per 1000 places, of at least this many, and at most this high.
SHORT, HIGH = 200, 20.0
PENALTY = 1e-5
STEPS = 500
THRESHOLD = 0.7
_PART = 1 << 20


@dataclass
class Model:
    place: np.ndarray  # by n-gram hash: its feature, or -1
    weight: np.ndarray  # by feature, the ratio included
    bias: float


def normal(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def gram_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram hash) of all n-grams of normalised texts, in parts of bounded size."""
    rows: list[tuple[int, str, int]] = []
    size, longest = 0, max(SIZES) - 1
    for k, text in enumerate(texts):
        for a in range(0, len(text), _PART):
            rows.append((k, text[a:a + _PART + longest], min(_PART, len(text) - a)))
            size += rows[-1][2]
            if size >= _PART:
                yield from _hashed(rows)
                rows, size = [], 0
    if rows:
        yield from _hashed(rows)


def _hashed(rows: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    code = np.frombuffer("".join(t for _, t, _ in rows).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for _, t, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = at < np.repeat([n for _, _, n in rows], sizes)  # later places belong to the next part of the text
    number = np.array([k for k, _, _ in rows])
    mixed = code * np.uint32(0x9E3779B1)
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + mixed[k:m + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside = (row[:m] == row[n - 1:]) & own[:m]
        yield number[row[:m][inside]], (h[inside] >> np.uint32(32 - BITS)).astype(np.int64)


def rates(texts: list[str | None], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, rate) of the features in each text; without ``place`` all hashes are features."""
    lines = list(map(normal, texts))
    keys = [np.zeros(0, np.int64)]
    for k, h in gram_hashes(lines):
        if place is not None:
            h = place[h]
            k, h = k[h >= 0], h[h >= 0].astype(np.int64)
        keys.append((k << BITS) + h)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    number = key >> BITS
    length = np.maximum(np.array([len(x) for x in lines] or [0]), SHORT)
    return number, key & ((1 << BITS) - 1), np.minimum(count * 1000.0 / length[number], HIGH)


def sampled(labels: DataFrame, doc_id: str, label: str, toxic: int, other: int) -> DataFrame:
    """At most so many labelled ids of either kind: those with the least hash."""
    some = [labels.filter(F.col(label) == value).select(doc_id, F.lit(value).alias("label")).dropDuplicates([doc_id])
            .orderBy(F.xxhash64(doc_id), doc_id).limit(most) for value, most in ((1, toxic), (0, other))]
    return some[0].union(some[1])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per hash: summed rates in toxic and in other texts and squared rates, in millionths."""
    sums = np.zeros((3, 1 << BITS))
    for batch in pieces(batches, "text", 4 << 20):
        number, feature, rate = rates(batch.column(0).to_pylist())
        toxic = np.array(batch.column(1).to_pylist())[number] == 1
        sums[0] += np.bincount(feature[toxic], rate[toxic], 1 << BITS)
        sums[1] += np.bincount(feature[~toxic], rate[~toxic], 1 << BITS)
        sums[2] += np.bincount(feature, rate ** 2, 1 << BITS)
    seen = np.flatnonzero(sums[2])
    yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(np.rint(s[seen] * 1e6).astype(np.int64)) for s in sums)],
                                     names=["feature", "toxic", "other", "squares"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        toxic: int = TOXIC, other: int = OTHER) -> Model:
    """Model from the labelled documents. Without texts of both kinds it knows the base rate only.

    The sampled ids are few enough to be sent to every task, so the texts of other documents
    are not moved. Per-feature sums are made in the cluster; the regression's input is
    bounded by the sample and the number of features.
    """
    ids = sampled(labels, doc_id, label, toxic, other)
    some = stored(docs.join(F.broadcast(ids), doc_id).select(F.col(text).alias("text"), "label"), "labelled")
    n = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    nothing = Model(np.full(1 << BITS, -1, np.int16), np.zeros(1), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n1 or not n0:
        return nothing
    sums = some.select("text", "label").mapInArrow(_sums, "feature long, toxic long, other long, squares long").groupBy("feature").agg(
        *(F.sum(c).alias(c) for c in ("toxic", "other", "squares"))).toPandas()
    in_toxic, in_other, squares = (sums[c].to_numpy() / 1e6 for c in ("toxic", "other", "squares"))
    ratio = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_other + 0.5) / (n0 + 1))
    mean = (in_toxic + in_other) / (n1 + n0)
    spread = np.sqrt((squares / (n1 + n0) - mean ** 2 + 1e-3) * (1 / n1 + 1 / n0))
    worth = np.abs(in_toxic / n1 - in_other / n0) / spread * np.sqrt(np.abs(ratio))
    feature = sums["feature"].to_numpy()
    best = np.lexsort((feature, -worth))[:FEATURES]
    place = nothing.place.copy()
    place[feature[best]] = np.arange(len(best))
    ratio = ratio[best]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            number, where, rate = rates(batch.column(0).to_pylist(), place)
            cuts = np.searchsorted(number, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (where.astype(np.int32), rate.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["label", "feature", "rate"])

    # Rows in an order of their own, so that the regression does not depend on where they were read.
    rows = sorted(((r[0], r[1], r[2]) for r in some.select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        chosen, "label int, feature array<int>, rate array<float>").collect()), key=lambda r: (r[0], r[1], r[2]))
    x = np.zeros((len(rows), len(best) + 1), np.float32)
    x[:, -1] = 1
    y = np.array([r[0] for r in rows], np.float32)
    for i, (_, where, rate) in enumerate(rows):
        x[i, where] = rate * ratio[where].astype(np.float32)
    scale = float(np.sqrt((x[:, :-1] ** 2).sum(1).mean())) or 1.0
    x[:, :-1] /= scale
    weight = regression(x, y)
    return Model(place, weight[:-1] * ratio / scale, float(weight[-1]))


def regression(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with a ridge penalty by accelerated gradient steps; the last column is the bias."""
    share = np.full(len(x), 1 / len(x), np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        top = x.T @ (share * (x @ top))
        size = float(np.linalg.norm(top))
        top /= size
    step = 1 / (0.25 * size + penalty)
    free = np.append(np.ones(x.shape[1] - 1, np.float32), 0)
    now = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        miss = share * (1 / (1 + np.exp(-(x @ ahead))) - y)
        after = (ahead - step * (x.T @ miss + penalty * free * ahead)).astype(np.float32)
        ahead = (after + k / (k + 3) * (after - now)).astype(np.float32)
        now = after
    return now.astype(np.float64)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    number, feature, rate = rates(texts, model.place)
    total = model.bias + np.bincount(number, model.weight[feature] * rate, len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1) and ``predicted``; a NULL text is scored as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 2 << 20):
            values = scores(batch.column(len(keep)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = [*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType(fields))


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a third of the ids is never learnt from.

    Labels of unknown value and of unknown documents are passed over; an empty table of
    labels gives every document the same score. Repeated rows are scored alike.
    """
    learn = labels.filter(crc_mod("doc_id", 3) != 1)
    model = fit(docs.select("doc_id", "text"), learn)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
