"""Hard negatives by a secondary-sort shuffle of packed pair scores.

Anchors and rows are dealt as blocks; a task scores one block of anchors against one block of
rows as a matrix product. Of each block only the pairs that can still matter go on: its first
positives of each anchor, then, with the anchors' positives known, the first negatives of each
positive's window. Pairs travel as packed keys (anchor, descending score, positive before
negative, id) through ``repartitionAndSortWithinPartitions``. One iterator reads a partition
in this order: a positive opens a window, negatives that fall into open windows are given
out, and nothing of an anchor is held but its few windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import stored

POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's.
WINDOW = (50, 95)
#: Components a row block should have, and anchors of an anchor block.
COMPONENTS, ANCHORS = 1 << 19, 2048
#: Anchors scored at a time.
_STEP = 128
#: Stands for no score; below every score, and its negative is a LONG too.
_LEAST = np.iinfo(np.int64).min + 1
_SIGN = 1 << 63
#: anchor id, anchor row, descending score, 0 of a positive or 1, id, row.
_KEY = struct.Struct(">QQQBQQ")


def window(score: int, low: int = WINDOW[0], high: int = WINDOW[1]) -> tuple[int, int]:
    """Least and most score s with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer components as floats, or as Python integers where their products could exceed what floats hold."""
    lengths = np.diff(vectors.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    flat = np.clip(flat, np.finfo(np.float64).min, np.finfo(np.float64).max)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond a LONG end at its limits."""
    width = anchors.shape[1]
    bound = max(1, width) * (np.abs(anchors).max(initial=0) + 1) * (np.abs(rows).max(initial=0) + 1)
    if bound < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(anchors) @ whole(rows).T, -(2**63) + 2, 2**63 - 1).astype(np.int64) if width else np.zeros((len(anchors), len(rows)), np.int64)


class _Block:
    """Rows of one side of a block pair, ordered by id and row."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.table = table
        self.id, self.row, self.label = (table.column(x).to_numpy() for x in ("vec_id", "row", "label"))
        self.vectors = _matrix(table.column("vector").combine_chunks(), width)


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in tables for c in t.column("vector").chunks), default=0)


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values; equal values go by the smaller column."""
    return np.argsort(-values, axis=1, kind="stable")[:, :k]


def _first_positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """The block's first ``most`` same-label rows of each anchor."""
    width = _width(anchors, rows)
    a, b = _Block(anchors, width), _Block(rows, width)
    out: list[list[np.ndarray]] = []
    for label in np.intersect1d(a.label, b.label):
        left, right = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        for at in range(0, len(left), _STEP):
            own = left[at:at + _STEP]
            s = scores(a.vectors[own], b.vectors[right])
            s[a.row[own][:, None] == b.row[right][None, :]] = _LEAST
            i = np.repeat(np.arange(len(own)), min(most, len(right)))
            j = _top(s, most).ravel()
            keep = s[i, j] > _LEAST
            i, j = i[keep], j[keep]
            out.append([a.id[own][i], a.row[own][i], s[i, j], b.id[right][j], b.row[right][j]])
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table(dict(zip(["anchor_id", "anchor_row", "score", "id", "row"], cols)))


def _first_negatives(anchors: pa.Table, rows: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """The block's first ``most`` other-label rows in the window of each positive of each anchor."""
    width = _width(anchors, rows)
    a, b = _Block(anchors, width), _Block(rows, width)
    found = a.table.column("found").to_pylist()
    n = len(b.id)
    ai, bj, sc = [], [], []
    for at in range(0, len(a.id), _STEP):
        own = np.arange(at, min(at + _STEP, len(a.id)))
        s = scores(a.vectors[own], b.vectors)
        s[a.label[own][:, None] == b.label[None, :]] = _LEAST
        packable = bool(np.abs(np.where(s == _LEAST, 0, s)).max(initial=0) < (1 << 62) // max(n, 1))
        if packable:  # score and place in one integer: sorted, equal scores end with the smallest id
            keys = np.where(s == _LEAST, _LEAST, s * n + (n - 1 - np.arange(n))[None, :])
            keys.sort(axis=1)
        for i, x in enumerate(own.tolist()):
            if not packable:
                order = np.lexsort((-np.arange(n), s[i]))
                ranked = s[i][order]
            taken: set[int] = set()
            for score in found[x]:
                least, greatest = window(score, low, high)
                if packable:
                    to = int(np.searchsorted(keys[i], greatest * n + (n - 1), side="right"))
                    got = [int(k) for k in keys[i][max(0, to - most):to][::-1] if k >= least * n and k != _LEAST]
                    taken.update(n - 1 - k % n for k in got)
                else:
                    to = int(np.searchsorted(ranked, greatest, side="right"))
                    taken.update(int(j) for j in order[max(0, to - most):to] if s[i][j] >= least and s[i][j] != _LEAST)
            for j in taken:
                ai.append(x)
                bj.append(j)
                sc.append(int(s[i][j]))
    i, j = np.array(ai, np.int64), np.array(bj, np.int64)
    return pa.table({"anchor_id": a.id[i], "anchor_row": a.row[i], "score": np.array(sc, np.int64), "id": b.id[j], "row": b.row[j]})


_PAIR = "anchor_id long, anchor_row long, score long, id long, row long"


def _block_pairs(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, work) -> DataFrame:
    """``work`` on every block of anchors and block of rows. Blocks are dealt by row number."""

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = anchors.withColumn("ab", block(anchor_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = rows.withColumn("rb", block(row_blocks)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(work, _PAIR)


def packed(anchor_id: int, anchor_row: int, score: int, negative: bool, vec_id: int, row: int) -> bytes:
    """A key whose bytes order as (anchor, descending score, positives first, id)."""
    return _KEY.pack(anchor_id + _SIGN, anchor_row + _SIGN, _SIGN - 1 - score, negative, vec_id + _SIGN, row + _SIGN)


def negatives_of(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES,
                 low: int = WINDOW[0], high: int = WINDOW[1]) -> Iterator[tuple[int, ...]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) of sorted keys."""
    anchor, opened, windows = None, 0, []  # a window: positive, its score, bounds, negatives given out
    for key in keys:
        a, a_row, s, negative, vec_id, _ = _KEY.unpack(key)
        if (a, a_row) != anchor:
            anchor, opened, windows = (a, a_row), 0, []
        score = _SIGN - 1 - s
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([vec_id - _SIGN, score, *window(score, low, high), 0])
            continue
        for w in windows:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield a - _SIGN, w[0], w[4], vec_id - _SIGN, w[1], score
        windows = [w for w in windows if score >= w[2] and w[4] < negatives]


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, vec_id, label, vector of the rows that take part."""
    whole = f"`{vec_id}` IS NOT NULL AND `{label}` IS NOT NULL AND `{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < CAST('Infinity' AS DOUBLE) AND NOT isnan(x))"
    return table.filter(whole).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
                                      F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))


def mine(rows: DataFrame, anchors: Column | str, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = WINDOW[0], high: int = WINDOW[1]) -> DataFrame:
    """Hard negatives of the ``rows`` (``row``, ``vec_id``, ``label``, ``vector``) that ``anchors`` picks.

    ``rows`` is a stored table from ``usable``: a row with a NULL id, label, vector or
    component, or with a non-finite one, takes no part. Components become ``floor(256 * x)``
    and scores are exact integers; missing components of shorter vectors count as zero.
    Higher scores come first, ties by id, then by place in the table. Rows that repeat an id
    are rows of their own, and an anchor is never its own positive. Anchors without a
    positive, and positives whose window is empty, have no rows in the result.
    """
    spark = rows.sparkSession
    queries = stored(rows.filter(anchors), "anchors")
    components, n = rows.agg(F.sum(F.size("vector") + 1), F.count(F.lit(1))).first()
    row_blocks = max(1, -(-(components or 0) // COMPONENTS))
    anchor_blocks = max(1, -(-queries.count() // ANCHORS))

    near = _block_pairs(rows, queries, row_blocks, anchor_blocks, lambda a, b: _first_positives(a, b, positives))
    ranked = near.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id, anchor_row ORDER BY score DESC, id, row) AS place")
    first = stored(ranked.filter(F.col("place") <= positives).drop("place"), "positives")
    windows = first.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list("score")).alias("found"))
    opened = stored(queries.join(windows, "row"), "windows")
    others = _block_pairs(rows, opened, row_blocks, anchor_blocks, lambda a, b: _first_negatives(a, b, negatives, low, high))

    both = first.withColumn("negative", F.lit(False)).unionByName(others.withColumn("negative", F.lit(True)))
    keys = both.rdd.map(lambda r: (packed(r.anchor_id, r.anchor_row, r.score, r.negative, r.id, r.row), None))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    mined = dealt.mapPartitions(lambda pairs: negatives_of((k for k, _ in pairs), positives, negatives, low, high))
    return spark.createDataFrame(
        mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(table: DataFrame, every: int = 50, shifted: int = 7, labels: int = 10,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    Where the id is divisible by ``shifted``, the label first becomes the next one of
    ``labels``. Other columns are not read; an empty table gives no rows.
    """
    rows = usable(table, vec_id, vector, label).withColumn(
        "label", F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine(stored(rows, "vectors"), F.col("vec_id") % every == 0)
