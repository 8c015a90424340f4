"""Tries of conversation prefixes as double arrays, one per prefix shard.

A turn is a 16-byte digest of its role and text. A conversation's turns are cut into levels
of ``LEVEL`` turns, and a piece goes to a shard by the prefix before it and its first turn;
prefixes with very many pieces are spread over several shards. A shard numbers its turns
densely, packs its trie into BASE and CHECK arrays and traverses them with all its pieces at
once. What shards share (upper nodes, spread prefixes) is merged by a digest of the path.
Sums over subtrees go through the same arrays, from the bottom up: every merged node's value
is handed to one shard that holds it, shards hand on sums by node, and these are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import discard, stored

#: Turns of a level, and turns a shard should have.
LEVEL, SHARD = 64, 100_000
#: Digest that stands for the empty prefix.
ROOT = bytes(16)
#: Places tried, near the first gap and over the whole array each, to fit the children of a node in; bytes of ids in a row.
_FITS, _PIECE = 64, 1 << 20

_PARTS = ("kind int, shard int, slot int, key binary, parent binary, root binary, depth long, conv_id long, n_convs long, chars long, "
          "base binary, check binary, slots binary, starts binary, keys binary")
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
_NODE, _END, _TRIE = 0, 1, 2


def path_key(root: bytes, path: bytes, level: int = LEVEL) -> bytes:
    """Digest of the prefix that ``path`` (digests of up to ``level`` turns) makes of the prefix ``root``."""
    full = len(path) == 16 * level
    return hashlib.blake2b(root + (b"+" + hashlib.blake2b(path, digest_size=16).digest() if full else path), digest_size=16).digest()


def fitted(owner: np.ndarray, symbol: np.ndarray, n: int, reserved: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASE of ``n`` owners and the place BASE[owner] + symbol of each (owner, symbol), no two places equal.

    Owners with several symbols are fitted first, the others fill the gaps; places below
    ``reserved`` stay free. A base may be negative.
    """
    order = np.lexsort((symbol, owner))
    owners, first, counts = np.unique(owner[order], return_index=True, return_counts=True)
    span = int(symbol.max(initial=0)) + 1
    used = np.zeros(2 * (n + len(owner)) + span + reserved, bool)
    used[:reserved] = True
    base = np.zeros(n, np.int64)
    low = top = reserved
    for k in np.argsort(-counts, kind="stable").tolist():
        if counts[k] == 1:
            break
        own = symbol[order[first[k]:first[k] + counts[k]]]
        shape = own - own[0]
        while used[low]:
            low += 1
        if top + int(shape[-1]) >= len(used):
            used = np.concatenate([used, np.zeros(int(shape[-1]) + len(used), bool)])
        places = np.unique(np.concatenate([np.arange(low, min(low + _FITS, top)), np.linspace(low, max(low, top), _FITS).astype(np.int64)]))
        fits = places[~used[places[:, None] + shape].any(axis=1)]  # the last one, behind all that is used, always does
        place = int(fits[0])
        used[place + shape] = True
        top = max(top, int(place + shape[-1]) + 1)
        base[owners[k]] = place - own[0]
    single = counts == 1
    free = np.flatnonzero(~used)[:int(single.sum())]
    if len(free) < single.sum():
        free = np.concatenate([free, len(used) + np.arange(single.sum() - len(free))])
    base[owners[single]] = free - symbol[order[first[single]]]
    return base, base[owner] + symbol


def pack(parent: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie, and every node's slot.

    Node 0 is the root; node k > 0 is the child of ``parent[k]`` by ``symbol[k]``, and parents
    come first. A child's slot is BASE[its parent's slot] + symbol, and CHECK of it is the
    parent's slot; free slots have -1 there.
    """
    n = len(parent)
    base_of, places = fitted(parent[1:], symbol[1:], n, reserved=1)
    slot = np.concatenate([[0], places])
    size = int(slot.max()) + 1
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent[1:]]
    return base, check, slot


def renumbered(symbol: np.ndarray) -> np.ndarray:
    """New number of each dense id, in the order of the first nodes that have it: most children of a node are then neighbours."""
    seen, first = np.unique(symbol[1:], return_index=True)
    out = np.zeros(int(symbol[1:].max(initial=-1)) + 1, np.int64)
    out[seen[np.argsort(first)]] = np.arange(len(seen))
    return out


def step(base: np.ndarray, check: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Slots reached from the slots ``state`` by ``symbol``, -1 where there is no such child."""
    after = base[state].astype(np.int64) + symbol
    inside = (after >= 0) & (after < len(check))
    return np.where(inside & (check[np.where(inside, after, 0)] == state), after, -1)


def _bytes16(column: pa.Array) -> np.ndarray:
    """Values of 16 bytes each as an (n, 16) array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = dict(x.split() for x in _PARTS.split(", "))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[x], types[kinds[x]]) if x in columns else pa.nulls(n, types[kinds[x]]) for x in _NAMES], names=_NAMES)


def _trie(shard: int, table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Nodes, ends and arrays of the trie over a shard's pieces (conv_id, level, root, ts, ns, last)."""
    table = table.combine_chunks()
    conv, level = table.column("conv_id").to_numpy(), table.column("level").to_numpy()
    ts = table.column("ts").combine_chunks()
    offsets = ts.offsets.to_numpy()
    lengths = np.diff(offsets)
    raw = _bytes16(ts.flatten())
    starts = np.cumsum(lengths) - lengths
    chars = table.column("ns").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    roots = _bytes16(table.column("root"))
    _, at, turn = np.unique(np.ascontiguousarray(raw).view("S16").ravel(), return_index=True, return_inverse=True)
    _, origin = np.unique(np.ascontiguousarray(roots).view("S16").ravel(), return_inverse=True)
    dense = len(at)

    # Nodes by depth: 0 is above all prefixes, depth 1 the prefixes themselves, then the turns.
    parent, symbol, sample, depth = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1]
    state, count = np.zeros(len(conv), np.int64), 1
    for j in range(int(lengths.max()) + 1):
        rows = np.arange(len(conv)) if j == 0 else np.flatnonzero(lengths >= j)
        by = dense + origin if j == 0 else turn[starts[rows] + j - 1]
        pair, index, inverse = np.unique(state[rows] * (dense + len(conv)) + by, return_index=True, return_inverse=True)
        parent.append(state[rows][index])
        symbol.append(by[index])
        sample.append(rows[index])
        state[rows] = count + inverse
        count += len(pair)
        depth.append(count)
    parent, symbol, sample = (np.concatenate(x) for x in (parent, symbol, sample))
    turn_of = symbol
    dense_id = renumbered(symbol)
    symbol, turn, origin = dense_id[symbol], dense_id[turn], dense_id[dense + origin]
    symbol[0] = 0
    base, check, slot = pack(parent, symbol)

    size = len(check)
    n_convs, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    here = step(base, check, np.zeros(len(conv), np.int64), origin)
    for j in range(int(lengths.max())):
        rows = np.flatnonzero(lengths > j)
        here[rows] = step(base, check, here[rows], turn[starts[rows] + j])
        np.add.at(n_convs, here[rows], 1)
        np.minimum.at(least, here[rows], conv[rows])

    keys: list[bytes] = [b""] * count
    depths = np.zeros(count, np.int64)
    for j, (a, b) in enumerate(zip(depth[1:], depth[2:])):
        depths[a:b] = level[sample[a:b]] * width + j
        for k, row in zip(range(a, b), sample[a:b].tolist()):
            root = roots[row].tobytes()
            keys[k] = path_key(root, raw[starts[row]:starts[row] + j].tobytes(), width) if j else root
    own = np.arange(depth[2], count)
    if len(own):
        yield _rows(kind=np.full(len(own), _NODE, np.int32), shard=np.full(len(own), shard, np.int32), slot=slot[own].astype(np.int32),
                    key=keys[depth[2]:], parent=[keys[k] for k in parent[own].tolist()], root=[roots[k].tobytes() for k in sample[own].tolist()],
                    depth=depths[own], conv_id=least[slot[own]], n_convs=n_convs[slot[own]], chars=chars[at[turn_of[own]]])
    of_slot = np.zeros(size, np.int64)
    of_slot[slot] = np.arange(count)
    ends = np.flatnonzero(table.column("last").to_numpy(zero_copy_only=False))
    if len(ends):
        yield _rows(kind=np.full(len(ends), _END, np.int32), key=[keys[k] for k in of_slot[here[ends]].tolist()], conv_id=conv[ends])
    yield _rows(kind=np.array([_TRIE], np.int32), shard=np.array([shard], np.int32), base=[base.tobytes()], check=[check.tobytes()],
                slots=[slot[own].astype(np.int32).tobytes()], starts=[(np.array(depth[2:]) - depth[2]).astype(np.int32).tobytes()],
                keys=[b"".join(keys[depth[2]:])])


def _tries(width: int):
    """Tries of the pieces in rows sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if held and now != shard[a]:
                    yield from _trie(now, pa.Table.from_batches(held), width)
                    held = []
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _trie(now, pa.Table.from_batches(held), width)

    return run


def _subtrees(trie: pa.Table, weights: pa.Table) -> pa.Table:
    """(key, n_leaves, saved): what a shard's trie adds to the subtree sums of its nodes."""
    row = trie.to_pylist()[0]
    check, slots, starts = (np.frombuffer(row[x], np.int32) for x in ("check", "slots", "starts"))
    keys = np.frombuffer(row["keys"], np.uint8).reshape(-1, 16)
    sums = []
    for name in ("leaves", "saved"):
        total = np.zeros(len(check), np.int64)
        total[weights.column("slot").to_numpy()] = weights.column(name).to_numpy()
        for a, b in reversed(list(zip(starts, starts[1:]))):
            np.add.at(total, check[slots[a:b]], total[slots[a:b]])
        sums.append(total[slots])
    some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
    return pa.table({"key": pa.array([keys[k].tobytes() for k in some.tolist()], pa.binary()), "n_leaves": sums[0][some], "saved_tokens": sums[1][some]})


def _chained(width: int):
    """Prefix digests of the levels of long conversations, in rows (conv_id, level, g) sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root = None, ROOT
        for batch in batches:
            out = []
            for conv, g in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if conv != now:
                    now, root = conv, ROOT
                out.append(root)
                root = hashlib.blake2b(root + b"+" + g, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["conv_id", "level", "root"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each level's turns, for ``path_key``."""
    for batch in batches:
        ts = batch.column(batch.schema.get_field_index("ts")).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([hashlib.blake2b(b"".join(x), digest_size=16).digest() for x in ts], pa.binary())],
            names=["conv_id", "level", "g"])


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of each key, in pieces, of rows (key, conv_id) sorted by both."""
    key, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                                          names=["key", "first", "text"])

    for batch in batches:
        done = []
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or size >= _PIECE):
                done.append(piece())
                ids, size = [], 0
            key = k
            ids.append(i)
            size += 20
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield piece()


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, of pieces sorted by key and first id."""
    key, now = None, None
    for batch in batches:
        keys, out = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                now.update(b"," + text.encode())
                continue
            if now is not None:
                keys.append(key)
                out.append(now.hexdigest())
            key, now = k, hashlib.sha256(text.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out)], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([now.hexdigest()])], names=["key", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id).

    Ids are put in order and joined in ranges of (key, id), so a key with very many ids is
    many tasks' work; only the running digest over the joined pieces is one stream by key.
    """
    texts = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_texts, "key binary, first long, text string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_id_hashes, "key binary, ends_sha256 string")


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t, n): place, digest and code points of every turn, in ranges of the whole order.

    ``turns`` has conv_id, turn, role, text. A conversation may lie in several ranges; places
    go on from the range before, so it is never one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.concatenate([[last is None or last != conv[0]], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            local = np.where(begin < 0, rank + np.arange(len(conv)), np.arange(len(conv)) - np.maximum(begin, 0))
            last, rank = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "local"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.expr("unhex(left(sha2(concat(char_length(role), ':', role, text), 256), 32))").alias("t"),
        F.char_length("text").cast("long").alias("n"), F.spark_partition_id().alias("part"))
    local = stored(ordered.mapInArrow(run, "conv_id long, t binary, n long, part int, local long"), "turns")
    # Only conversations that begin in an earlier range: a few for each range.
    starts = local.groupBy("conv_id", "part").count().selectExpr(
        "conv_id", "part", "sum(count) OVER (PARTITION BY conv_id ORDER BY part) - count AS start").filter("start > 0")
    return local.join(F.broadcast(starts), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("start", F.lit(0))).alias("pos"), "t", "n")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, t, n) of every rebuilt conversation, and (conv_id, length).

    A conversation begins with the first h turns of the one whose id is the next lower
    multiple of ``group`` (none if that is absent) and goes on with its own after its first
    h; h is the checksum of its decimal id modulo ``most``.
    """
    placed = stored(positions(turns), "positions")
    counts = stored(placed.groupBy("conv_id").count(), "counts")
    heads = stored(placed.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)), "heads")
    held = heads.groupBy(F.col("conv_id").alias("head")).agg(F.count(F.lit(1)).alias("k"))
    ids = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("head"),
                        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), "count")
    plan = ids.join(held, "head", "left").select("conv_id", "head", "h", F.least("h", F.coalesce("k", F.lit(0))).alias("taken"), "count").withColumn(
        "length", F.col("taken") + F.greatest(F.lit(0), F.col("count") - F.col("h")))
    plan = stored(plan, "plan")
    own = placed.join(plan.select("conv_id", "h", "taken", "length"), "conv_id").filter("pos >= h").selectExpr("conv_id", "pos - h + taken AS pos", "t", "n", "length")
    lent = plan.filter("taken > 0").join(heads.withColumnRenamed("conv_id", "head"), "head").filter("pos < taken").select("conv_id", "pos", "t", "n", "length")
    return own.unionByName(lent), plan.select("conv_id", "length")


def trie_nodes(turns: DataFrame, lengths: DataFrame, width: int = LEVEL, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie of conversations ``turns`` (conv_id, pos, t, n, length).

    ``lengths`` (conv_id, length) is a stored table with all conversations, those without a
    turn too. See ``conversation_trie`` for the result.
    """
    root_conv, n_convs = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    pieces = turns.groupBy("conv_id", F.expr(f"CAST(pos DIV {width} AS INT)").alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t", "n"))).alias("x"), F.first("length").alias("length"))
    pieces = stored(pieces.selectExpr("conv_id", "level", "x.t AS ts", "x.n AS ns", "length", f"level = (length - 1) DIV {width} AS last"), "pieces")
    deep = pieces.filter(F.col("length") > width).select("conv_id", "level", "ts").mapInArrow(_digests, "conv_id long, level int, g binary")
    chains = stored(deep.repartition("conv_id").sortWithinPartitions("conv_id", "level").mapInArrow(
        _chained(width), "conv_id long, level int, root binary").filter("level > 0"), "chains")
    placed = pieces.join(chains, ["conv_id", "level"], "left").withColumn("root", F.coalesce("root", F.lit(ROOT))).withColumn("first", F.col("ts")[0])
    placed = stored(placed, "placed")
    sizes = placed.groupBy("root", "first").agg(F.sum(F.size("ts")).alias("n"))
    total = pieces.agg(F.coalesce(F.sum(F.size("ts")), F.lit(0))).first()[0]
    spread = stored(sizes.filter(F.col("n") > shard // 2).select("root", "first", F.ceil(F.col("n") / (shard / 2)).alias("k")), "spread")
    shards = max(1, -(-total // shard))
    dealt = placed.join(spread, ["root", "first"], "left").withColumn("shard", F.expr(
        f"CAST(pmod(xxhash64(root, first, pmod(xxhash64(conv_id), coalesce(k, 1))), {shards}) AS INT)"))
    dealt = dealt.select("shard", "conv_id", "level", "root", "ts", "ns", "last").repartition("shard").sortWithinPartitions("shard")
    parts = stored(dealt.mapInArrow(_tries(width), _PARTS), "tries")

    merged = parts.filter(F.col("kind") == _NODE).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("parent").alias("parent"), F.first("root").alias("root"),
        F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min(F.struct("shard", "slot")).alias("owner"))
    merged = stored(merged, "merged")
    children = merged.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).selectExpr(
        "*", "IF(n_children = 0, 1L, 0L) AS leaves", "(n_convs - 1) * chars AS saved"), "nodes")

    # Sums below a level's last turns: of every prefix once, at the least conversation that goes on there, then
    # towards each conversation's beginning, then over the conversations that share a prefix.
    once = nodes.filter(F.col("root") != F.lit(ROOT)).groupBy("root").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("conv_id").alias("conv_id"))
    passed = chains.join(once, ["root", "conv_id"], "left").selectExpr(
        "root AS key", *[f"sum(coalesce({x}, 0)) OVER (PARTITION BY conv_id ORDER BY level DESC) AS {x}" for x in ("leaves", "saved")])
    below = passed.groupBy("key").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    weights = nodes.join(below, "key", "left").selectExpr(
        "owner.shard AS shard", "owner.slot AS slot", "leaves + coalesce(more_leaves, 0) AS leaves", "saved + coalesce(more_saved, 0) AS saved")
    tries = parts.filter(F.col("kind") == _TRIE).select("shard", "check", "slots", "starts", "keys")
    sums = tries.groupBy("shard").cogroup(weights.groupBy("shard")).applyInArrow(_subtrees, "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = parts.filter(F.col("kind") == _END).select("key", "conv_id").union(lengths.filter("length = 0").select(F.lit(ROOT), "conv_id"))
    hashes = stored(ends_hashes(ends), "ends")
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = stored(nodes.join(sums, "key").join(hashes, "key", "left").select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")), "full")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = full.filter("depth = 1").withColumn("parent_conv_id", F.lit(root_conv)).select(columns)
    rest = full.filter("depth > 1").join(above, "parent").select(columns)
    root = full.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    none = hashes.filter(F.col("key") == F.lit(ROOT)).agg(F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(b""), 256)).alias("ends_sha256")).first()[0]
    root = root.select(F.lit(root_conv).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                       F.lit(n_convs).alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(none).alias("ends_sha256"))
    for done in (pieces, placed, merged):
        discard(done)
    return root.filter(F.lit(n_convs > 0)).unionByName(top).unionByName(rest)


def conversation_trie(conversations: DataFrame, width: int = LEVEL, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, from the textless root.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Turns go by ``turn`` (NULL first), ties by role and
    text; NULL role or text counts as empty; repeated rows are turns of their own. Rows
    without a conversation id belong to none and are left out. An empty table has no node;
    where no conversation has a turn the root is the one leaf. Other columns are not read.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows, lengths = rebuilt(turns)
    return trie_nodes(rows, lengths, width, shard)
