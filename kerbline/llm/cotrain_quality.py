"""Quality by co-training two classifiers, one of text content and one of page metadata.

The content view sees the shape of the text (which kinds of characters follow each other)
and how it repeats itself; the metadata view sees source, language and length. Both learn
from the labelled documents. Then, for some rounds, documents without a label that one view
is sure of are taught to the other with that label. How sure a view is, is calibrated on
labelled documents kept apart, so a view without a signal teaches nothing. A document's
score joins the calibrated log odds of both views.

The models are fitted on at most ``LABELLED`` labelled documents of either kind and ``POOL``
without a label, those with the least hash of their id. All documents are scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pieces, stored
from kerbline.llm.toxicity import regression

LABELLED, POOL = 2000, 2000
ROUNDS = 3
#: A view teaches what it is this sure of, at most so many documents of a kind per round, at half a label's weight.
SURE, TAUGHT, TRUST = 0.98, 200, 0.5
#: Of the labelled documents one in so many is kept apart for calibration.
APART = 4
THRESHOLD = 0.5
PENALTY = 1e-4

#: Kinds of characters, by a character each: blank, line end, small and capital letter, digit, the rest as named.
BLANK, LINE, SMALL, CAPITAL, DIGIT, STOP, COMMA, SENTENCE, BAR, SYMBOL, OTHER = range(11)
_KINDS = 11
_STATS = 8
SHAPE = _KINDS ** 3 + _STATS
_SOURCES, _LANGS, _LENGTHS = 64, 16, 40
META = _SOURCES + _LANGS + _LENGTHS
_PART, _ROWS = 1 << 20, 500


@cache
def _kinds() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = CAPITAL if x.isupper() else SMALL
        elif x.isspace():
            table[c] = LINE if x in "\n\r" else BLANK
        elif x.isdigit():
            table[c] = DIGIT
        elif c < 128:
            table[c] = STOP if x == "." else COMMA if x == "," else SENTENCE if x in "!?;:'\"" else BAR if x == "|" else SYMBOL
    return table


def _repeats(text: str) -> np.ndarray:
    """How a stretch of text repeats itself."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return np.array([same / max(1, n), np.log1p(len(counts)) / np.log1p(max(1, n)), max(counts.values(), default=0) / (n + 20),
                     min(len(text) / max(1, n), 40) / 10, 1 - len(set(lines)) / max(1, len(lines)),
                     float(n == 0), np.log1p(n) / 10, np.log1p(len(lines)) / 10], np.float32)


def shape(texts: list[str | None]) -> np.ndarray:
    """Content features, a row per text (NULL: empty): rates of kind trigrams under a root, and repetition."""
    out = np.zeros((len(texts), SHAPE), np.float32)
    parts = [(k, t[a:a + _PART]) for k, t in enumerate(texts) if t for a in range(0, len(t), _PART)]
    size = np.zeros(len(texts))
    for i in range(0, len(parts), _ROWS):
        some = parts[i:i + _ROWS]
        lengths = np.array([len(t) for _, t in some])
        kind = _kinds()[np.frombuffer("".join(t for _, t in some).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        row = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
        gram = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * _KINDS ** 3 + gram[inside], minlength=len(some) * _KINDS ** 3)
        owner = np.array([k for k, _ in some])
        np.add.at(out[:, _STATS:], owner, counts.reshape(len(some), -1).astype(np.float32))
        for (k, t), n in zip(some, lengths):
            out[k, :_STATS] += _repeats(t) * n
            size[k] += n
    full = np.maximum(size, 1)[:, None].astype(np.float32)
    out[:, _STATS:] = np.sqrt(out[:, _STATS:] / full)
    out[:, :_STATS] /= full
    return out


def page(sources: list, langs: list, lengths: list) -> np.ndarray:
    """Metadata features, a row per document; NULL is a value of its own."""
    out = np.zeros((len(sources), META), np.float32)
    for k, (s, g, n) in enumerate(zip(sources, langs, lengths)):
        out[k, zlib.crc32(repr(s).encode()) % _SOURCES] = 1
        out[k, _SOURCES + zlib.crc32(repr(g).encode()) % _LANGS] = 1
        out[k, _SOURCES + _LANGS + (0 if n is None else min(max(int(n), 0).bit_length() + 1, _LENGTHS - 1))] = 1
    return out


@dataclass
class View:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weight[:-1] + self.weight[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


@dataclass
class Model:
    views: tuple[View, View] | None
    prior: float  # log odds of a good document


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _view(x: np.ndarray, y: np.ndarray, w: np.ndarray, apart: tuple[np.ndarray, np.ndarray, np.ndarray]) -> View:
    mean = np.average(x, axis=0, weights=w).astype(np.float32)
    spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w) + 1e-4).astype(np.float32)
    scaled = np.column_stack([(x - mean) / spread, np.ones(len(x), np.float32)]).astype(np.float32)
    view = View(mean, spread, regression(scaled, y.astype(np.float32), PENALTY, 300, w))
    # Log odds on documents kept apart: the slope that makes them fit, held near 0 where they are noise.
    ax, ay, aw = apart
    raw = np.clip(view.raw(ax) / 10, -10, 10).astype(np.float32)
    fit = regression(np.column_stack([raw, np.ones(len(raw), np.float32)]).astype(np.float32), ay.astype(np.float32), 1e-3, 2000, aw)
    view.slope, view.shift = float(max(0.0, fit[0])) / 10, float(fit[1])
    return view


def cotrain(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, w: np.ndarray, apart: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
            rounds: int = ROUNDS) -> tuple[View, View]:
    """Two calibrated views from labelled rows (weights ``w``; ``apart`` marks the calibration rows) and a pool."""
    held = tuple((x[apart], y[apart], w[apart]) for x in xs)
    train = [(x[~apart], y[~apart], w[~apart]) for x in xs]
    views = tuple(_view(*t, h) for t, h in zip(train, held))
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    for _ in range(rounds):
        taught = False
        for teacher, pupil in ((0, 1), (1, 0)):
            p = _sigmoid(views[teacher].odds(pool[teacher]))
            for label, sure in ((1, p), (0, 1 - p)):
                rows = np.flatnonzero(free[pupil] & (sure >= SURE))
                rows = rows[np.argsort(-sure[rows], kind="stable")][:TAUGHT]
                if len(rows):
                    taught = True
                    free[pupil][rows] = False
                    x, ly, lw = train[pupil]
                    train[pupil] = (np.concatenate([x, pool[pupil][rows]]), np.append(ly, np.full(len(rows), label)),
                                    np.append(lw, np.full(len(rows), TRUST)))
        if not taught:
            break
        views = tuple(_view(*t, h) for t, h in zip(train, held))
    return views


def joined(model: Model, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of a good document: by both views, by content, by metadata."""
    if model.views is None:
        return (np.full(len(x), _sigmoid(np.float64(model.prior))),) * 3
    a, b = model.views[0].odds(x), model.views[1].odds(m)
    return _sigmoid(a + b - model.prior), _sigmoid(a), _sigmoid(b)


_INPUT = ("doc_id", "text", "source", "lang", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Model from labelled and unlabelled documents; without labels of both kinds it knows the base rate only.

    Ids are sampled from narrow tables first and are few enough to be sent to every task, so
    other documents' texts stay where they are. What comes to the driver is bounded by the
    sample and the number of features.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(None, prior)
    hashed = F.xxhash64("doc_id")
    ids = [known.filter(F.col("label") == v).dropDuplicates(["doc_id"]).orderBy(hashed, "doc_id").limit(labelled) for v in (1, 0)]
    free = docs.select("doc_id").filter("doc_id IS NOT NULL").join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    ids.append(free.orderBy(hashed, "doc_id").limit(pool).select("doc_id", F.lit(-1).alias("label")))
    some = docs.select(*_INPUT).join(F.broadcast(ids[0].union(ids[1]).union(ids[2])), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _PART):
            ids, texts, sources, langs, lengths, marks = (c.to_pylist() for c in batch.columns)
            x, m = shape(texts), page(sources, langs, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, m))],
                names=["doc_id", "label", "x", "m"])

    rows = stored(some.select(*_INPUT, "label").mapInArrow(features, "doc_id long, label int, x binary, m binary"), "features").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    y = np.array([r["label"] for r in rows], int)
    x, m = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.float32).reshape(len(rows), n) for c, n in (("x", SHAPE), ("m", META)))
    apart = np.array([zlib.crc32(str(r["doc_id"]).encode()) % APART == 0 for r in rows], bool)
    del rows  # the arrays hold what is needed
    mine, seen = y >= 0, Counter(y.tolist())
    if any(not ((y == v) & part).any() for v in (0, 1) for part in (apart, ~apart)):
        return Model(None, prior)
    # Classes are sampled alike; weights give them back their shares among the labels.
    w = np.where(y == 1, n1 / seen[1], n0 / seen[0])[mine]
    w = w / w.mean()
    return Model(cotrain((x[mine], m[mine]), y[mine], w, apart[mine], (x[~mine], m[~mine])), prior)


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """All columns and ``score``, ``content_score``, ``metadata_score`` (0 to 1, higher is better), named with ``prefix``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]
    names = [prefix + c for c in ("score", "content_score", "metadata_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _PART):
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                texts, sources, langs, lengths = (part.column(k).to_pylist() for k in at)
                values = joined(sent.value, shape(texts), page(sources, langs, lengths))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v.astype(np.float64)) for v in values)],
                                                 names=[*part.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, content_score, metadata_score, accepted for every document.

    NULL texts are scored as empty ones; NULL source, language and length are values of
    their own. Labels other than 0 and 1 and of unknown documents are passed over. Repeated
    rows are scored alike.
    """
    docs = docs.select(*_INPUT)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", "score", "content_score", "metadata_score", (F.col("score") >= THRESHOLD).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns as they are."""
    mark = "__kerbline_"
    return score(docs, fit(docs, labels), mark).filter(F.col(f"{mark}score") >= THRESHOLD).select(*docs.columns)
