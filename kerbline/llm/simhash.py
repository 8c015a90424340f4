"""SimHash near-duplicates: fingerprints, tiled exact comparison, linked classes.

Fingerprints of all documents are compared exactly, in tiles of numpy arrays by exclusive-or
and bit counts. Two fingerprints within ``radius`` bits agree on at least ``blocks - radius``
of ``blocks`` bit blocks, so tiles are laid out by the value of each such choice of blocks;
inside a layout cell, fingerprints are ordered by population count and tile pairs whose
counts differ beyond the radius are skipped. Cells with many fingerprints are cut into
several tiles that are dealt as tile pairs, so no cell is one task's work. A tile pair hands
on a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pieces, stored, text_bytes
from kerbline.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Most fingerprints of a tile.
TILE = 4096
#: Most bytes of a text, and hashes of a batch, that are taken apart at a time.
_PART = 1 << 20
_HASHES = 1 << 18


def _word_runs(text: bytes, width: int) -> Iterator[list[bytes]]:
    """Words of a text in bounded runs; each repeats the ``width - 1`` words before it."""
    if len(text) <= _PART:
        yield text.lower().split()
        return
    held: list[bytes] = []
    tail, fresh = b"", True
    for at in range(0, len(text), _PART):
        part = tail + text[at:at + _PART].lower()
        words, tail = part.split(), b""
        if at + _PART < len(text) and words and not part[-1:].isspace():
            tail = words.pop()
        held += words
        fresh = fresh or bool(words)
        if len(held) >= width and fresh:
            yield held
            held, fresh = held[len(held) - width + 1:], False
    if fresh:  # fewer words than a shingle in all
        yield held


def _hashes(words: list[bytes], width: int, seed: int) -> list[int]:
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:1 - width].tolist() if width > 1 else (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[i:j], seed) for i, j in zip(starts, ends[width - 1:].tolist())]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits by position (bit 0 first) of each run of hashes that begins at ``starts``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def simhash(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts; a bit is set if set in over half the shingle hashes."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(counts, owners, _bit_counts(np.concatenate(held), starts))
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for words in filter(None, _word_runs(text, width)):
            got = np.array(_hashes(words, width, seed), np.uint64)
            totals[i] += len(got)
            held.append(got)
            owners.append(i)
            size += len(got)
            if size >= _HASHES:
                flush()
    flush()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a signed LONG. NULL and blank texts have fingerprint zero."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            marks = simhash(text_bytes(batch.column(at)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least reachable index of each of ``n`` nodes under the links (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs within ``radius`` bits between two tiles, or within one.

    Both arrays are ordered by population count; blocks too far apart in it are skipped.
    """
    nodes = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    lefts, rights = np.bitwise_count(left).astype(int), np.bitwise_count(other).astype(int)
    us, vs = [], []
    for i in range(0, len(left), step):
        for j in range(i if right is None else 0, len(other), step):
            a, b = left[i:i + step], other[j:j + step]
            if rights[j] - lefts[min(i + step, len(left)) - 1] > radius:
                break
            if lefts[i] - rights[min(j + step, len(other)) - 1] > radius:
                continue
            u, v = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if not len(u):
                continue
            root = forest(u, v + len(a), len(a) + len(b)) if right is not None or i != j else forest(u, v, len(a))
            own = np.flatnonzero(root != np.arange(len(root)))
            place = np.concatenate([np.arange(i, i + len(a)), np.arange(j, j + len(b)) + shift])
            us.append(place[own])
            vs.append(place[root[own]])
    if not us:
        return nodes[:0], nodes[:0]
    root = forest(np.concatenate(us), np.concatenate(vs), len(nodes))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the tile pairs in rows sorted by (cell, lo, hi, side, population count)."""
    carry: list[np.ndarray] | None = None

    def groups(columns: list[np.ndarray], last: bool):
        cell, lo, hi, side, fp = columns
        new = (np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if b == len(cell) and not last:
                return [x[a:] for x in columns]
            if b - a > 1:
                marks, cut = fp[a:b].view(np.uint64), int(np.searchsorted(side[a:b], 1))
                if lo[a] == hi[a]:
                    found.append(tile_links(marks, None, radius))
                elif 0 < cut < b - a:
                    found.append(tile_links(marks[:cut], marks[cut:], radius))
        return None

    names = ["cell", "lo", "hi", "side", "fp"]
    for batch in batches:
        if not batch.num_rows:
            continue
        found: list[tuple[np.ndarray, np.ndarray]] = []
        now = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
        now = now if carry is None else [np.concatenate([x, y]) for x, y in zip(carry, now)]
        carry = groups(now, False)
        yield from _as_batches(found)
    if carry is not None:
        found = []
        groups(carry, True)
        yield from _as_batches(found)


def _as_batches(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])


def _cells(n: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """Bit blocks and the choices of them that lay out tiles, finer for more fingerprints.

    Any two fingerprints within the radius share at least one choice, whatever the layout;
    it only decides how many unrelated fingerprints share a cell.
    """
    free = 1
    while free < 4 and n > 1 << (64 * free // (radius + free) + 9):
        free += 1
    return radius + free, list(combinations(range(radius + free), free))


def links(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): forest links between distinct fingerprints at ``radius`` or fewer differing bits.

    ``marks`` is a stored table with the distinct LONG column ``fp``.
    """
    blocks, choices = _cells(marks.count(), radius)
    edge = [64 * k // blocks for k in range(blocks + 1)]

    def cell(index: int, choice: tuple[int, ...]) -> str:
        value = f"{index}L"
        for k in choice:
            width = edge[k + 1] - edge[k]
            value = f"(shiftleft({value}, {width}) | (shiftright(fp, {edge[k]}) & {(1 << width) - 1}L))"
        return value

    spread = marks.select(
        F.expr(f"explode(array({', '.join(cell(i, c) for i, c in enumerate(choices))}))").alias("cell"),
        "fp", F.expr("CAST(bit_count(fp) AS INT)").alias("pop"),
    )
    tiles = (
        spread.groupBy("cell", "pop").count()
        .groupBy("cell").agg(
            F.sum("count").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("count") / tile).cast("int").alias("k")))).alias("tiles"),
        ).filter(F.col("n") > tile).select("cell", "tiles")
    )
    tiles = stored(tiles, "tiles")
    pairs = (
        spread.join(tiles, "cell", "left")
        .withColumn("own", F.expr("IF(tiles IS NULL, 0, shiftleft(pop, 20) + CAST(pmod(xxhash64(fp), tiles[pop]) AS INT))"))
        .withColumn("other", F.explode(F.expr(
            f"IF(tiles IS NULL, array(0), flatten(transform(filter(map_keys(tiles), q -> abs(q - pop) <= {radius}), "
            "q -> transform(sequence(0, tiles[q] - 1), j -> shiftleft(q, 20) + j))))")))
        .select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                F.expr("CAST(own > other AS INT)").alias("side"), "pop", "fp")
    )
    dealt = pairs.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "side", "pop", "fp")
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def classes(marks: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, component_id): the least id reachable from each fingerprint of the stored ``marks``.

    ``marks`` has the columns ``doc_id`` and ``fp``. NULL ids never become a component's id
    unless it has no other.
    """
    least = stored(marks.groupBy("fp").agg(F.min(doc_id).alias("least")), "marks")
    roots = components(links(least.select("fp"), radius, tile))
    placed = stored(
        least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "least"), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component id.

    Words are cut at ASCII blanks after A-Z are lower-cased; a text of fewer than ``width``
    words is one shingle, one without words has fingerprint zero and is linked like any
    other. Documents whose fingerprints differ in at most ``radius`` bits are linked.
    Repeated rows give repeated rows; an empty table gives none. Other columns are not read.
    """
    marks = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = stored(with_fingerprint(marks, width=width).select("doc_id", "fp"), "fingerprints")
    return marks.join(classes(marks, radius=radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents without near-copies: of each linked class the row with the least id stays.

    Of several rows with that id one stays; NULL ids come last. All columns are returned as
    they are. Rows are numbered when they are stored with their fingerprints, so repeated
    rows can be told apart.
    """
    mark, row = "__kerbline_fp", "__kerbline_row"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = stored(with_fingerprint(numbered, text, mark), "marked")
    marks = stored(kept.select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("fp"), F.col(row).alias("row")), "fingerprints")
    # Null ids order last: a struct compares its fields in turn.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    least = stored(marks.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "marks")
    roots = components(links(least.select("fp"), radius))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    winners = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    # Always by a shuffle: most rows stay, so their ids outgrow any broadcast, and the plan is the same at every size.
    return kept.join(stored(winners, "winners").hint("merge"), row, "left_semi").drop(row, mark)
