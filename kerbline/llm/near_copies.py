"""Near-copies by SimHash and the exact Jaccard similarity of their sets of word shingles.

Every set has a SimHash fingerprint. Fingerprints of all documents are compared by ``simhash.links``,
exactly in exclusive-or tiles; those linked within ``BITS`` bits are a family, in which the sets
themselves decide. A bound on bits misses pairs, as two sets of ``SIMILAR`` differ in ten of 64 bits
on average; an exact search for the rest follows, so that none is lost.

In it shingles are put in one order for all documents, those frequent in a sample last. Of two sets
with at least ``SIMILAR`` in common, the first fifth (and one) of either shares a shingle, so
similar documents meet where these prefixes do and no pair is lost, whatever the order.
Documents that meet are gathered in stars, and nearly all pairs that meet lie within one.
A family or star is compared as tiles: a task takes its texts, counts the overlaps of all pairs exactly by a
matrix product and hands on a spanning forest of the similar ones, so a large family of
copies never becomes rows of pairs. What meets across stars and is not linked by then is
gathered anew by classes of sizes, at the shingle that most of it shares, and compared as tiles again; at last
every shingle still open is a star of its own, so that each pair that meets and can be similar is compared somewhere.

Most documents that meet share a common line and little else. Before texts travel, small parity vectors of the
sets are compared in the same tiles: they differ in no more places than the sets do, so whom they rule out is not similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import discard, pieces, shuffles_go, stored, text_bytes
from kerbline.llm.components import components
from kerbline.llm.simhash import _HASHES, SEED, _bit_counts, _hashes, _word_runs, forest
from kerbline.llm.simhash import links as fingerprint_links

WIDTH = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Most differing bits of two fingerprints of a family.
BITS = 6
#: Documents of the sample for the order, occurrences in it from which a shingle comes last, and most of these.
SAMPLE, OFTEN, MOST = 20_000, 2, 200_000
#: Times that nodes move to the star that prevails around them, and that open nodes are gathered anew.
ROUNDS, REGATHERED = 2, 2
#: Most nodes and shingles of a tile, and cells of a block of its incidence matrix.
TILE, MARKS, _CELLS = 1024, 1 << 20, 1 << 22


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes; a text of fewer than ``width`` words is one shingle, a blank one has none."""
    runs = [np.array(_hashes(words, width, SEED), np.uint64) for words in filter(None, _word_runs(text, width))]
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: a bit is 1 if set in over half the hashes; equal sets have equal ones, an empty one zero."""
    counts = np.zeros((len(sets), 64), np.int64)
    for i, x in enumerate(sets):
        for at in range(0, len(x), _HASHES):
            counts[i] += _bit_counts(x[at:at + _HASHES], np.zeros(1, np.int64))[0]
    n = np.array([len(x) for x in sets], np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def parity(marks: np.ndarray) -> bytes:
    """Bits of hash buckets, whether each holds an odd number; as many as the set has hashes, or more: a power of two."""
    size = 1 << max(6, (len(marks) - 1).bit_length())
    return np.packbits(np.bincount((marks & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def prefix(marks: np.ndarray, often: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first shingles in the order common to all documents; ``often`` is sorted."""
    if not len(marks):
        return marks
    rank = np.zeros(len(marks), np.int64)
    if len(often):
        place = np.minimum(np.searchsorted(often, marks), len(often) - 1)
        rank = np.where(often[place] == marks, weight[place], 0)
    above, below = SIMILAR
    size = len(marks) - -(-above * len(marks) // below) + 1
    return marks[np.lexsort((marks, rank))[:size]]


def _sample(kept: DataFrame, text: str, row: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in a sample of bounded size, sorted, and how often."""
    share = SAMPLE / max(1, kept.count())
    some = kept.filter(F.pmod(F.xxhash64(row), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            for x in text_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x).view(np.int64))], names=["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST).toArrow()
    marks = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(marks)
    return marks[order], found.column("count").to_numpy()[order]


def _prefixes(kept: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """id, row, digest of the shingle set, its fingerprint, its parities, its size and its prefix for every document."""
    sent = kept.sparkSession.sparkContext.broadcast(_sample(kept, text, row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, weight = sent.value
        for batch in pieces(batches, "text"):
            sets = [shingles(x) for x in text_bytes(batch.column(2))]
            first = [prefix(x, often, weight).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                 pa.array(fingerprints(sets).view(np.int64)), pa.array([parity(x) for x in sets], pa.binary()),
                 pa.array([len(x) for x in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                names=["doc_id", "row", "digest", "fp", "parity", "n", "prefix"])

    fields = [T.StructField("doc_id", kept.schema[doc_id].dataType), T.StructField("row", T.LongType()), T.StructField("digest", T.BinaryType()),
              T.StructField("fp", T.LongType()), T.StructField("parity", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    rows = kept.select(F.col(doc_id).alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType(fields))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of rows (h, node, n, p) sorted by (h, node), those whose h is shared, with the first node of it.

    The rows of the range's first h and its last row are given out in any case and marked as
    ``edge``: the ranges before and behind may hold more of their h.
    """
    names = ["h", "node", "n", "p"]
    last: list[np.ndarray] | None = None  # the row before, which is held back
    hub, due, opening = 0, False, None  # the first node of its h, whether that is shared, and the range's first h

    def out(rows: list[np.ndarray], hubs: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (*rows, hubs, edge))], names=[*names, "hub", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
        opening = now[0][0] if opening is None else opening
        if last is not None:
            now = [np.concatenate([x, y]) for x, y in zip(last, now)]
        new = np.concatenate([[True], now[0][1:] != now[0][:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        hubs = now[1][begin]
        meets = np.concatenate([~new[1:], [False]]) | ~new
        if last is not None:
            hubs[begin == 0] = hub
            meets[0] |= due
        edge = now[0] == opening
        last, hub, due = [x[-1:].copy() for x in now], hubs[-1], bool(meets[-1])
        give = meets | edge
        give[-1] = False
        if give.any():
            yield out([x[give] for x in now], hubs[give], edge[give])
    if last is not None:
        yield out(last, np.array([hub]), np.array([True]))


def meetings(entries: DataFrame, label: str = "meetings") -> DataFrame:
    """Stored (h, node, n, p, hub) of the ``entries`` (h, node, n, p) whose h several nodes share; the hub is its least node.

    Entries are dealt in ranges of (h, node), so that a shingle of very many documents is
    many tasks' work. Only an h at the edge of a range can go on in another one; there are
    two of these a range at most, for which hubs are put right.
    """
    local = stored(entries.repartitionByRange("h", "node").sortWithinPartitions("h", "node").mapInArrow(
        _meetings, "h long, node long, n long, p long, hub long, edge boolean"), label)
    edges = local.filter("edge").select("h").distinct()
    whole = local.join(F.broadcast(edges), "h").groupBy("h").agg(F.min("hub").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = stored(whole, label)
    return local.drop("edge").join(F.broadcast(whole), "h", "left").filter("rows IS NULL OR rows > 1").selectExpr(
        "h", "node", "n", "p", "coalesce(first, hub) AS hub")


def families(sets: DataFrame, bits: int | None = None) -> DataFrame:
    """Stored (node, star, n) of the stored ``sets`` (node, fp, n): the least fingerprint linked with a node's at ``bits`` or fewer."""
    marks = stored(sets.select("fp").distinct(), "marks")
    roots = components(fingerprint_links(marks, BITS if bits is None else bits))
    placed = sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stored(placed.select("node", F.coalesce("root", "fp").alias("star"), "n"), "families")


def _elected(votes: DataFrame) -> DataFrame:
    """Stored (node, star, n): the star with most of a node's ``votes`` (node, star, n, shared), the least of equals."""
    best = votes.groupBy("node").agg(F.max(F.struct("shared", F.negative("star").alias("star"))).alias("x"), F.first("n").alias("n"))
    return stored(best.selectExpr("node", "-x.star AS star", "n"), "stars")


def star_of(met: DataFrame) -> DataFrame:
    """Each node's star: the hub with which it shares most shingles."""
    return _elected(met.groupBy("node", F.col("hub").alias("star")).agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")))


def moved(met: DataFrame, stars: DataFrame) -> DataFrame:
    """Stars after each node has gone to the star that prevails among its shingles.

    A hub lacks some shingles of its family, whose other members then meet at another hub;
    this brings them together, so that few pairs are left between stars.
    """
    placed = met.select("h", "node", "n").join(stars.select("node", "star"), "node")
    prevails = placed.groupBy("h", "star").count().groupBy("h").agg(F.max(F.struct("count", F.negative("star").alias("star"))).alias("x"))
    prevails = stored(prevails.selectExpr("h", "-x.star AS star"), "prevails")
    votes = placed.drop("star").join(prevails, "h")
    elected = _elected(votes.groupBy("node", "star").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")))
    discard(prevails)
    return elected


def set_links(sets: list[np.ndarray], cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the similar pairs of ``sets`` (distinct hashes each), as indices.

    With ``cut``, only pairs of one set before and one at or behind it. Overlaps are counted exactly,
    by products of the incidence matrix in blocks of columns; hashes of one set only have none.
    """
    n = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.zeros((len(sets), len(sets)), np.int32)
    columns = int(shared.sum())
    width = max(1, _CELLS // len(sets))
    for at in range(0, columns, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), min(width, columns - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        overlap += (part @ part.T).astype(np.int32)
    above, below = SIMILAR
    close = (below + above) * overlap.astype(np.int64) >= above * (n[:, None] + n[None, :])
    u, v = np.nonzero(np.triu(close, 1))
    if cut is not None:
        across = (u < cut) & (v >= cut)
        u, v = u[across], v[across]
    root = forest(u, v, len(sets))
    own = np.flatnonzero(root != np.arange(len(sets)))
    return own, root[own]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the tile pairs in rows (star, lo, hi, side, node, text) sorted by the first five."""
    held: list[tuple[int, int, bytes]] = []
    now: tuple[int, int, int] | None = None

    def links() -> Iterator[pa.RecordBatch]:
        cut = sum(side == 0 for side, _, _ in held) if now[1] != now[2] else None
        if len(held) > 1 and (cut is None or 0 < cut < len(held)):
            u, v = set_links([shingles(x) for _, _, x in held], cut)
            nodes = np.array([node for _, node, _ in held], np.int64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["a", "b"])

    for batch in batches:
        for piece in pieces([batch], "text"):
            keys = zip(*(piece.column(k).to_pylist() for k in range(5)), text_bytes(piece.column(5)))
            for star, lo, hi, side, node, text in keys:
                if now != (star, lo, hi):
                    if held:
                        yield from links()
                    held, now = [], (star, lo, hi)
                held.append((side, node, text))
    if held:
        yield from links()


def may_link(bits: list[bytes], n: np.ndarray, root: np.ndarray, cut: int | None = None) -> np.ndarray:
    """Whether each set may be similar to one of another root, by its parities ``bits`` and size; false only if it is to none.

    With ``cut``, pairs of one set before and one at or behind it. A hash in one set of two turns one
    bit, so sets differ at least where the parities do; longer ones are folded to the length of shorter ones.
    Those of sizes that can be similar are as long or twice as long.
    """
    length = np.array([len(x) for x in bits])
    found = np.zeros(len(bits), bool)
    above, below = SIMILAR
    for size in np.unique(length):
        own, other = np.flatnonzero(length == size), np.flatnonzero((length == size) | (length == 2 * size))
        left = np.stack([np.frombuffer(bits[i], np.uint64) for i in own])
        right = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, size // 8)) for i in other])
        step = max(1, _CELLS // right.size)
        for at in range(0, len(own), step):
            rows = own[at:at + step]
            apart = np.bitwise_count(left[at:at + step, None] ^ right[None]).sum(axis=2, dtype=np.int64)
            apart = np.maximum(apart, np.abs(n[rows][:, None] - n[other][None]))
            close = (below + above) * apart <= (below - above) * (n[rows][:, None] + n[other][None])
            close &= root[rows][:, None] != root[other][None]
            if cut is not None:
                close &= (rows < cut)[:, None] != (other < cut)[None]
            found[rows[close.any(axis=1)]] = True
            found[other[close.any(axis=0)]] = True
    return found


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, star, n) that may be linked in the tile pairs in rows (star, lo, hi, side, node, n, root, parity) sorted by the first five."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    for (star, lo, hi), tile in groupby(rows, key=lambda row: row[:3]):
        side, node, n, root, bits = [*zip(*tile)][3:]
        sizes = np.array(n, np.int64)
        found = np.flatnonzero(may_link(bits, sizes, np.array(root, np.int64), None if lo == hi else side.count(0)))
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(node, np.int64)[found]), pa.array(np.full(len(found), star, np.int64)), pa.array(sizes[found])], names=["node", "star", "n"])


def _dealt(stars: DataFrame) -> DataFrame:
    """Stored (node, star, lo, hi, side, n): the nodes of stars of several, in the tile pairs of their stars.

    A star of many nodes or shingles is cut into tiles.
    """
    sizes = stars.groupBy("star").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m")).filter("c > 1").selectExpr(
        "star", f"CAST(greatest(ceil(c / {TILE}), ceil(m / {MARKS})) AS INT) AS k")
    dealt = stars.join(stored(sizes, "sizes"), "star").withColumn("own", F.expr("CAST(pmod(xxhash64(node), k) AS INT)")).withColumn(
        "other", F.explode(F.expr("sequence(0, k - 1)")))
    return stored(dealt.select("node", "star", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                               F.expr("CAST(own > other AS INT)").alias("side"), "n"), "dealt")


def promising(stars: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The stored ``stars`` (node, star, n) whose parities allow a link with a node of another root in their star.

    ``sets`` is a stored table (node, parity), ``roots`` (node, root) has what is linked by now. All pairs of
    the others in their stars are linked or not similar, so they count as compared.
    """
    rows = _dealt(stars).join(sets.select("node", "parity"), "node")
    rows = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tiles = rows.select("star", "lo", "hi", "side", "node", "n", "root", "parity").repartition("star", "lo", "hi").sortWithinPartitions(
        "star", "lo", "hi", "side", "node")
    return stored(tiles.mapInArrow(_hopeful, "node long, star long, n long").distinct(), "promising")


def star_links(kept: DataFrame, stars: DataFrame, text: str, row: str) -> DataFrame:
    """Stored links (a, b): a spanning forest, by tile pair, of all similar pairs of nodes of one star.

    ``stars`` is a stored table (node, star, n); only texts of stars with several nodes travel. Where these
    are few, their list is small enough for Spark to broadcast, so that the other texts are not shuffled to find them.
    """
    texts = kept.select(F.col(row).alias("node"), F.col(text).alias("text")).join(_dealt(stars), "node").select("star", "lo", "hi", "side", "node", "text")
    tiles = texts.repartition("star", "lo", "hi").sortWithinPartitions("star", "lo", "hi", "side", "node")
    return stored(tiles.mapInArrow(_tiles, "a long, b long"), "links")


def _undecided(stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``stars`` (node, star, n) that hold several roots and several families of ``nodes`` (node, root, family)."""
    ends = stars.join(nodes, "node").groupBy("star").agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("root", "family")])
    open_ = stored(ends.filter("min_root <> max_root AND min_family <> max_family").select("star"), "undecided")
    return stored(stars.join(open_, "star").select("node", "star", "n"), "stars")


def by_size(met: DataFrame) -> DataFrame:
    """The entries (h, node, n) of ``met``, each h cut in two neighbouring classes of sizes at a time.

    Sizes of similar sets differ by a factor of 1.25 at most, thus by one class of 1.26 at most, and meet
    in one of both. Should keys collide, more is compared.
    """
    classes = F.expr(f"floor(ln(n) / ln({SIMILAR[1] / SIMILAR[0] + 0.01}))")
    return met.withColumn("size", F.explode(F.array(classes, classes + 1))).select(F.xxhash64("h", "size").alias("h"), "node", "n")


def _alike(left: DataFrame) -> DataFrame:
    """Stars (node, star, n) of all open shingles; those of the same nodes, by their hashes, are one."""
    marks = stored(left.groupBy("h").agg(F.bit_xor(F.xxhash64("node")).alias("star")), "alike")
    return stored(left.select("h", "node", "n").join(marks, "h").select("node", "star", "n").distinct(), "stars")


def unsettled(entries: DataFrame, nodes: DataFrame, layouts: list[str]) -> DataFrame:
    """Stored ``entries`` (h, node, n) of open shingles, with the columns of ``nodes`` (node, root, *layouts).

    Two nodes are settled if they have one root, thus are linked, or one star in any of the
    layouts, thus were compared. A shingle all of whose nodes share one of these is not open.
    """
    keys = ["root", *layouts]
    placed = stored(entries.join(nodes, "node"), "placed")
    ends = placed.groupBy("h").agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in keys])
    open_ = stored(ends.filter(" AND ".join(f"min_{x} <> max_{x}" for x in keys)).select("h"), "open")
    left = stored(placed.join(open_, "h"), "left")
    discard(placed)
    return left


def regathered(left: DataFrame) -> DataFrame:
    """Stored stars (node, star, n): of each node's open shingles that of most nodes, the least of equals.

    All nodes of the largest shingle choose it, so that it is not open afterwards.
    """
    sizes = stored(left.groupBy("h").count(), "sizes")
    best = left.join(sizes, "h").groupBy("node").agg(F.max(F.struct("count", F.negative("h").alias("h"))).alias("x"), F.first("n").alias("n"))
    return stored(best.selectExpr("node", "-x.h AS star", "n"), "stars")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the classes by earlier ``roots`` and further ``links``."""
    return components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored ``nodes`` with the root of each, itself where it is not linked."""
    return stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")


def _winners(kept: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """Stored ``row`` of the one document that stays of each class."""
    marks = stored(_prefixes(kept, doc_id, text, row), "prefixes")
    # Null ids order last: a struct compares its fields in turn.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    sets = stored(marks.groupBy("digest").agg(F.min(order).alias("first"), *[F.first(x).alias(x) for x in ("fp", "parity", "n")]).select(
        "first", F.col("first.row").alias("node"), "fp", "parity", "n"), "sets")

    def compared(stars: DataFrame, roots: DataFrame | None) -> DataFrame:
        return _joined(roots, star_links(kept, promising(stars, sets, roots), text, row))

    # Equal sets are one node from here on.
    kin = families(sets)
    roots = compared(kin, None)

    entries = marks.join(sets.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi").select(
        F.explode("prefix").alias("h"), F.col("row").alias("node"), "n", F.size("prefix").cast("long").alias("p"))
    gathered = meetings(entries)
    met = stored(gathered, "met")
    discard(gathered)
    discard(marks)
    stars = star_of(met)
    for _ in range(ROUNDS):
        stars = moved(met, stars)
    nodes = stars.select("node", "star").join(kin.select("node", F.col("star").alias("family")), "node")
    roots = compared(_undecided(stars, _rooted(nodes, roots).drop("star")), roots)

    layouts = ["family", "star"]
    left = unsettled(by_size(met), _rooted(nodes, roots), layouts)
    discard(met)
    for k in range(REGATHERED):
        if left.isEmpty():
            break
        stars = regathered(left)
        roots = compared(stars, roots)
        nodes = left.select("node", *layouts).distinct().join(stars.select("node", F.col("star").alias(f"star_{k}")), "node")
        layouts = [*layouts, f"star_{k}"]
        left = unsettled(left.select("h", "node", "n"), _rooted(nodes, roots), layouts)
    if not left.isEmpty():
        roots = compared(_alike(left), roots)
    classes = sets.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    winners = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return stored(winners, "winners")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-copies: of each linked class the row with the least id stays.

    Documents are linked whose sets of ``WIDTH``-word shingles have a Jaccard similarity of
    ``SIMILAR`` or more, at first those of one SimHash family, then what shares a prefix; words are cut and lower-cased as in ``simhash``, and texts without
    words are equal. Of several rows with the least id one stays; NULL ids come last. All
    columns are returned as they are.
    """
    row = "__kerbline_row"
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with shuffles_go(docs.sparkSession):
        winners = _winners(kept, doc_id, text, row)
    # Always by a shuffle: most rows stay, so their ids outgrow any broadcast, and the plan is the same at every size.
    return kept.join(winners.hint("merge"), row, "left_semi").drop(row)
