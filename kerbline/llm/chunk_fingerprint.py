"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks cut points; cutting is normalised, with a stricter
mark before the usual chunk length and a looser one after it. An insertion moves cuts only
near it, so the digests of the other chunks stay. A fingerprint is the set of chunk digests,
each with its length; how much of one text another contains is the share of the first one's
length whose digests the second has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pieces, text_bytes

#: Chunk lengths in bytes.
LEAST, USUAL, MOST = 16, 64, 256
_WINDOW = 32
#: Marks: the gear hash is below this. One place in 128 before the usual length, one in 32 after it.
_STRICT, _LOOSE = np.uint32(1 << 25), np.uint32(1 << 27)


def _gear() -> np.ndarray:
    """One pseudo-random word for each byte, by the SplitMix64 rule."""
    out, x, mask = [], 20260901, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        out.append((z ^ z >> 31) >> 32)
    return np.array(out, np.uint32)


GEAR = _gear()


def _marks(texts: list[bytes]) -> list[tuple[list[int], list[bool]]]:
    """Marked places of each text and whether they are strict. Every text follows blank bytes."""
    blank = b"\0" * _WINDOW
    line = np.frombuffer(b"".join(x for t in texts for x in (blank, t)), np.uint8)
    h = GEAR[line]
    for k in (1, 2, 4, 8, 16):  # h[i] covers 1, 2, 4 ... bytes that end at i
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero(h < _LOOSE)
    strict = (h[places] < _STRICT).tolist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + _WINDOW)
    starts = ends - sizes
    a, b = np.searchsorted(places, starts).tolist(), np.searchsorted(places, ends).tolist()
    places = places.tolist()
    return [([p - s for p in places[i:j]], strict[i:j]) for i, j, s in zip(a, b, starts.tolist())]


def _cuts(places: list[int], strict: list[bool], n: int) -> list[int]:
    """Ends of the chunks of a text of n bytes."""
    out, start, k, last = [], 0, 0, len(places)
    while n - start > LEAST:
        low, usual, cut = start + LEAST, start + USUAL, min(start + MOST, n)
        while k < last and places[k] < low:
            k += 1
        while k < last and places[k] < cut:
            if strict[k] or places[k] >= usual:
                cut = places[k] + 1
                break
            k += 1
        out.append(cut)
        start = cut
    if start < n:
        out.append(n)
    return out


def chunks(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest (48 bits) and length of the distinct chunks of each UTF-8 text."""
    digest, out = xxhash.xxh64_intdigest, []
    for text, (places, strict) in zip(texts, _marks(texts)):
        a, found = 0, {}
        for b in _cuts(places, strict, len(text)):
            found[digest(text[a:b]) >> 16] = b - a
            a = b
        out.append(found)
    return out


def as_text(found: dict[int, int]) -> str:
    return " ".join(f"{d:012x}:{n}" for d, n in sorted(found.items()))


def contained(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length whose chunks b has; an empty a is contained in an empty b only."""
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def _from_text(line: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, _, n in (x.partition(":") for x in (line or "").split())}


def containment(a: str | Column, b: str | Column) -> Column:
    """Share of the first fingerprint's length that the second has, for two fingerprint columns."""
    share = F.udf(lambda x, y: contained(_from_text(x), _from_text(y)), "double")
    return share(a, b)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text (NULL: empty). One pass, no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            marks = [as_text(x) for x in chunks(text_bytes(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'CAST({x} AS BIGINT)' for x in values)})"


def _rank(bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the id: a search in two levels of the list."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    whole = f"size(filter({_longs([p[-1] for p in parts])}, x -> x < doc_id))"
    return F.expr(
        f"least({len(bounds)}, {whole} * {step} + "
        f"COALESCE(size(filter(get(array({', '.join(map(_longs, parts))}), {whole}), x -> x < doc_id)), 0))")


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, halo, doc_id, text) in order to results; each row waits for the next one."""
    wait: tuple | None = None  # doc_id, text, chunks
    first: tuple | None = None

    def results(rows: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
        edited = []
        for (_, text, _), (_, after, _) in zip(rows, nexts):
            k = len(text) // 3
            edited.append((text[:len(text) - k] + after[:k]).encode())
        marks = chunks(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array([as_text(r[2]) for r in rows]),
            pa.array(list(map(as_text, marks))), pa.array([contained(r[2], m) for r, m in zip(rows, marks)], pa.float64()),
            pa.array([contained(r[2], x[2]) for r, x in zip(rows, nexts)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in pieces(batches, "text", 4 << 20):
        halo, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        raw = text_bytes(batch.column(3))
        rows, nexts = [], []
        for outside, doc_id, text, marks in zip(halo, ids, raw, chunks(raw)):
            row = (doc_id, text.decode(), marks)
            if wait is not None:
                rows.append(wait)
                nexts.append(row)
            # Of the rows sent from the next range the first is enough.
            wait = None if outside else row
            first = first or row
        if rows:
            yield results(rows, nexts)
    if wait is not None:  # one range holds all rows
        yield results([wait], [first])


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next one by descending doc_id.

    The edited text is the document with its last third (floor of its code points over 3)
    replaced by as many code points, or all, from the start of the next document; after the
    last document comes the first. Ids are put in ``buckets`` ranges (default: the shuffle
    partitions) at bounds taken from the ids themselves. A range's first document is also
    sent to the range before it, and the very first one to the last range; so texts are
    shuffled once and no document's neighbour is missing. NULL ids come last. Rows of one id
    are ordered by their text; of equal rows any is the first. A NULL text is empty. A
    single row is its own next. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / buckets for k in range(1, buckets)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 20 * buckets)).alias("bounds"), F.max("doc_id").alias("top")).first()
    bounds = sorted({x for x in found["bounds"] or [] if x < found["top"]}) if buckets > 1 else []
    place = lambda halo, bucket: F.struct(F.lit(halo).alias("halo"), bucket.alias("bucket"))
    last = F.lit(len(bounds))
    if bounds:
        # Ids fall along the buckets; the bound below which a bucket's ids end is the first id of the next.
        rows = rows.withColumn("own", F.when(F.col("doc_id").isNull(), last).otherwise(last - _rank(bounds)))
        places = [place(False, F.col("own")), F.when(F.col("doc_id") == found["top"], place(True, last)),
                  F.when(F.expr(f"doc_id = get({_longs(bounds)}, {len(bounds)} - own)"), place(True, F.col("own") - 1))]
    else:
        places = [place(False, last)]
    return (
        rows.withColumn("place", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())))
        .select(F.col("place.bucket").alias("bucket"), F.col("place.halo").alias("halo"), "doc_id", "text")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
        .mapInArrow(_pairs, OUT)
    )
