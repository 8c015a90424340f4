"""Shards of near-equal size by sampled splitters.

Records are put in one order (hash of the text, id, row), so that equal texts are neighbours
and no key is hot. A sample of keys, drawn with a chance in proportion to size, gives
quantile boundaries that cut the order into many more ranges than shards; ranges found to be
overfull are sampled again and subdivided. Exact sizes of all ranges then say where each one
begins in the whole order, so tasks place the records of their ranges into shards by exact
running sizes: the sample decides how work is dealt, not what the result is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import stored

SHARDS = 24
#: Bytes that a record adds to those of its text.
OVERHEAD = 8
#: Rows a range should have, most ranges of the first cut, and sampled keys per range.
ROWS, RANGES, SAMPLES = 20_000, 1024, 32
#: Times the intended size from which a range is overfull.
OVERFULL = 2

_ROW, _TEXT, _ID = "__kerbline_row", "__kerbline_text", "__kerbline_id"


def text_order(text: str) -> Column:
    """The first 60 bits of the text's SHA-256; NULL counts as empty."""
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _id_order(docs: DataFrame, doc_id: str) -> Column:
    whole = isinstance(docs.schema[doc_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    value = F.col(doc_id).cast("long") if whole else F.xxhash64(doc_id)
    return F.coalesce(value, F.lit(-(1 << 63)))


def packed(*columns: np.ndarray) -> np.ndarray:
    """Rows of signed 64-bit columns as byte strings that compare as the rows do."""
    biased = np.stack([np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in columns], axis=-1)
    return np.ascontiguousarray(biased.astype(">u8")).view(f"S{8 * len(columns)}").reshape(-1)


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def with_range(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Add ``range``: how many of the sorted ``bounds`` are at or before the row's key."""
    if not len(bounds):
        return keys.withColumn("range", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.searchsorted(bounds, packed(*_numpy(batch, _TEXT, _ID, _ROW)), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "range"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("range", T.IntegerType())]))


def _sample(keys: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each drawn with chance ``size * share``, and the size each one stands for."""
    drawn = F.pmod(F.xxhash64(_TEXT, _ID, _ROW, F.lit("splitter")), F.lit(1 << 40)) / float(1 << 40)
    rows = keys.filter(drawn < F.col("size") * share).select(_TEXT, _ID, _ROW, "size").toPandas()
    marks = packed(rows[_TEXT], rows[_ID], rows[_ROW])
    order = np.argsort(marks, kind="stable")
    return marks[order], np.maximum(rows["size"].to_numpy(float), 1 / share)[order]


def cuts(marks: np.ndarray, weights: np.ndarray, target: float) -> np.ndarray:
    """Of the sorted sample, the keys at which the running weight passes a multiple of ``target``."""
    before = np.floor((np.cumsum(weights) - weights) / target)
    return marks[1:][before[1:] > before[:-1]]


def _totals(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Size, and size without the largest record, by range."""
    rows = ranged.groupBy("range").agg(F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    return {r["range"]: (r["size"], r["size"] - r["most"]) for r in rows}


def splitters(keys: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, dict[int, int]]:
    """Boundaries of about ``ranges`` ranges of the stored ``keys``, and every range's exact size.

    Sampled keys that come to the driver are some ``SAMPLES`` for each range that is being
    cut. A range is cut again, with twice the density each time, while it holds over
    ``OVERFULL`` times the intended size besides its largest record.
    """
    target, share = total / ranges, SAMPLES * ranges / total
    marks, weights = _sample(keys, share)
    bounds = np.unique(cuts(marks, weights, target))
    while True:
        ranged = with_range(keys, bounds)
        sizes = _totals(ranged)
        over = sorted(k for k, (_, rest) in sizes.items() if rest > OVERFULL * target)
        if not over:
            return bounds, {k: size for k, (size, _) in sizes.items()}
        share *= 2
        marks, weights = _sample(ranged.filter(F.col("range").isin(over)), share)
        home = np.searchsorted(bounds, marks, side="right")
        more = [cuts(marks[home == k], weights[home == k], target) for k in over]
        bounds = np.unique(np.concatenate([bounds, *more]))


def _placing(start: dict[int, int], total: int, shards: int):
    """Shard and rank, within its range and shard, of rows sorted by range and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, rank = (None, None), 0, 0  # range and shard of the row before, size and rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rng, size = _numpy(batch, "range", "size")
            rng, size = rng.astype(np.int64), size.astype(np.int64)
            before = np.cumsum(size) - size
            new = np.concatenate([[last[0] != rng[0]], rng[1:] != rng[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(rng)), 0))
            base = np.array([start[k] for k in rng[first[new]].tolist()], np.int64) if new.any() else np.zeros(0, np.int64)
            offset = np.empty(len(rng), np.int64)
            offset[new] = base - before[new]
            if not new[0]:
                offset[0] = at
            offset = offset[first] + before
            shard = np.minimum(((2 * offset + size) * shards) // (2 * total), shards - 1).astype(np.int32)
            turn = new | np.concatenate([[last[1] != shard[0]], shard[1:] != shard[:-1]])
            begin = np.maximum.accumulate(np.where(turn, np.arange(len(rng)), -1))
            local = np.where(begin < 0, rank + np.arange(len(rng)), np.arange(len(rng)) - np.maximum(begin, 0))
            last, at, rank = (rng[-1], shard[-1]), int(offset[-1] + size[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(local)], names=[*batch.schema.names, "shard", "local"])

    return run


def placed(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Columns of the stored ``keys``, with ``shard`` and ``slot``.

    ``keys`` has the order's columns and ``size``. A record goes where the middle of its
    bytes lies in the whole order, so shards differ by at most one record's size.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return keys.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    bounds, sizes = splitters(keys, total, min(RANGES, max(shards, -(-rows // ROWS))))
    start, at = {}, 0
    for k in sorted(sizes):
        start[k], at = at, at + sizes[k]
    dealt = with_range(keys, bounds).repartition("range").sortWithinPartitions("range", _TEXT, _ID, _ROW)
    schema = T.StructType([*dealt.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("local", T.LongType())])
    ranked = stored(dealt.mapInArrow(_placing(start, total, shards), schema), "placed")
    # A row per range and shard: as many as there are boundaries, whatever the number of records.
    starts = ranked.groupBy("shard", "range").count().selectExpr(
        "shard", "range", "sum(count) OVER (PARTITION BY shard ORDER BY range) - count AS start")
    return ranked.join(F.broadcast(starts), ["shard", "range"]).withColumn("slot", F.col("start") + F.col("local")).select(*keys.columns, "shard", "slot")


def _keys(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return [text_order(text).alias(_TEXT), _id_order(docs, doc_id).alias(_ID), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32")]


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, checksum, shard and slot, under the law ``bytes``.

    A document's size is the UTF-8 bytes of its text (NULL: none) plus ``OVERHEAD``; shard
    sizes differ by at most one document's. Equal texts are neighbours, so they share a shard
    unless a boundary falls between them. Slots count from 0 in each shard without a gap.
    Ties go by id (NULL first); rows equal in both are interchangeable. Results do not
    depend on the sample or on how rows are spread. An empty table gives no rows; with fewer
    documents than shards some shards are empty. Other columns are not read.
    """
    keys = docs.select(F.col(doc_id).alias("doc_id"), *_keys(docs, doc_id, text)).withColumn(_ROW, F.monotonically_increasing_id())
    return placed(stored(keys, "keys"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 512 << 20) -> DataFrame:
    """Write all columns of the documents as Parquet by shard; returns what was written.

    Files lie under ``shard=k`` (``__shard=k`` where there is a column ``shard``) and each
    holds one stretch of slots, which the added column ``__slot`` numbers. ``file_bytes`` is
    about the text in a file; texts move in one shuffle, dealt by shard and stretch.
    """
    numbered = stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    where = placed(stored(numbered.select(_ROW, *_keys(numbered, doc_id, text)), "keys"), shards)
    total = where.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    stretch = max(1, int(file_bytes * total[1] / max(1, total[0])))
    out = numbered.join(where.select(_ROW, F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), _ROW).drop(_ROW)
    parts = out.repartition("__shard", F.floor(F.col("__slot") / stretch)).sortWithinPartitions("__shard", "__slot")
    name = "__shard" if "shard" in docs.columns else "shard"
    parts.withColumnRenamed("__shard", name).write.option("maxRecordsPerFile", stretch).partitionBy(name).parquet(folder)
    return docs.sparkSession.read.parquet(folder)
