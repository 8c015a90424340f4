"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words (A-Z lower-cased; a word is a run of digits,
letters a-z and characters beyond ASCII). The automaton of all items is streamed over each
document and tracks, word by word, the longest match that ends there. Where it is a window
long, the words of the window are hit; an item shorter than a window is one window.

The automaton, not the documents, is sent to the tasks. It is built in blocks of at most
``BLOCK`` item words; a benchmark of several blocks is one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pieces, stored, text_bytes

WINDOW = 13
#: A document is contaminated from one hit word in so many.
COVERAGE = 20
#: Item words of one automaton; each takes some 150 bytes in a task.
BLOCK = 200_000
_PART = 4 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]

#: Byte by byte: A-Z to a-z, ASCII that is in no word to a blank.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Automaton:
    """Suffix automaton of word sequences with, by state, the windows that end in it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        self.width = max(1, len(self.ids))
        size, link, out = [0], [-1], [{}]

        def state(length: int, suffix: int, edges: dict[int, int]) -> int:
            size.append(length)
            link.append(suffix)
            out.append(edges)
            return len(size) - 1

        def split(v: int, t: int) -> int:
            """State of the extension of v by t that is no longer than v's own extension."""
            q = out[v][t]
            if size[q] == size[v] + 1:
                return q
            copy = state(size[v] + 1, link[q], dict(out[q]))
            link[q] = copy
            while v != -1 and out[v].get(t) == q:
                out[v][t] = copy
                v = link[v]
            return copy

        for tokens in coded:
            last = 0
            for t in tokens:
                if t in out[last]:
                    last = split(last, t)
                    continue
                v, last_new = last, state(size[last] + 1, 0, {})
                while v != -1 and t not in out[v]:
                    out[v][t] = last_new
                    v = link[v]
                if v != -1:
                    link[last_new] = split(v, t)
                last = last_new

        self.size, self.link = size, link
        self.step = {v * self.width + t: q for v, edges in enumerate(out) for t, q in edges.items()}
        # By state: the suffix of it that holds the last ``window`` words, and items by that state.
        order = sorted(range(len(size)), key=size.__getitem__)
        self.holder = [-1] * len(size)
        for v in order[1:]:
            self.holder[v] = v if size[v] >= window > size[link[v]] else self.holder[link[v]]
        self.owners: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, tokens in enumerate(coded):
            v = 0
            for i, t in enumerate(tokens):
                v = self.step[v * self.width + t]
                if i + 1 >= window:
                    self.owners.setdefault(self.holder[v], set()).add(k)
            if 0 < len(tokens) < window:
                whole.setdefault(v, []).append((len(tokens), k))
        # Short items that end wherever a state ends: its own and those of its suffixes.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in order[1:]:
            if ends := whole.get(v, []) + self.short.get(link[v], []):
                self.short[v] = ends
        self.least = min([window, *(len(tokens) for tokens in coded if tokens)])

    def stream(self, parts: Iterator[list[bytes]]) -> tuple[int, list[list[int]], set[int]]:
        """Words of a text, its hit spans (first and last word, merged), and the items found."""
        n, v, length = 0, 0, 0
        spans: list[list[int]] = []
        found: set[int] = set()
        step, width, window, link, size = self.step, self.width, self.window, self.link, self.size

        def hit(first: int, last: int) -> None:
            while spans and first <= spans[-1][1] + 1:
                first = min(first, spans.pop()[0])
            spans.append([first, last])

        for words in parts:
            get = self.ids.get
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            # Runs of item words; those too short for any window are passed over unless a part's end cuts them.
            for a, b in _runs(ids):
                if a or not n:
                    v = length = 0
                if b - a < self.least and a and b < len(ids):
                    continue
                for i, t in enumerate(ids[a:b].tolist(), n + a):
                    while (q := step.get(v * width + t)) is None and v:
                        v = link[v]
                        length = size[v]
                    if q is None:
                        length = 0
                        continue
                    v, length = q, length + 1
                    if length >= window:
                        hit(i - window + 1, i)
                        found |= self.owners[self.holder[v]]
                    for m, k in self.short.get(v, ()):
                        if m <= length:
                            hit(i - m + 1, i)
                            found.add(k)
            if len(ids) and ids[-1] < 0:
                v = length = 0
            n += len(ids)
        return n, spans, found


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of non-negative values."""
    known = np.concatenate([[False], ids >= 0, [False]])
    cuts = np.flatnonzero(known[1:] != known[:-1])
    return list(zip(cuts[::2].tolist(), cuts[1::2].tolist()))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Normalised words of a UTF-8 text, in parts of bounded size."""
    if len(text) <= _PART:
        yield text.translate(NORMAL).split()
        return
    tail = b""
    for at in range(0, len(text), _PART):
        part = tail + text[at:at + _PART].translate(NORMAL)
        words, tail = part.split(), b""
        if at + _PART < len(text) and words and not part.endswith(b" "):
            tail = words.pop()
        yield words


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block: int) -> Iterator[Automaton]:
    """Automata over at most ``block`` item words each (or one item), in item order."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).orderBy(1, 2)
    for name, raw in rows.toLocalIterator():
        words = [w for part in words_of(bytes(raw or b"")) for w in part]
        if held and size + len(words) > block:
            yield Automaton(held, window)
            held, size = [], 0
        if words:
            held.append((name or "", words))
            size += len(words)
    if held:
        yield Automaton(held, window)


def _search(docs: DataFrame, automaton, text: str, keep: list[str]) -> DataFrame:
    at = docs.columns.index(text)
    kept = [docs.columns.index(c) for c in keep]
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for batch in pieces(batches, text):
            got = [machine.stream(words_of(x)) for x in text_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array([n for n, _, _ in got], pa.int64()),
                 pa.array([[{"first": a, "last": b} for a, b in spans] for _, spans, _ in got], spans_type),
                 pa.array([[machine.names[k] for k in sorted(found)] for _, _, found in got], pa.list_(pa.string()))],
                names=[*keep, "__n_words", "__spans", "__items"])

    fields = [docs.schema[k] for k in kept] + [T.StructField("__" + f.name, f.dataType) for f in _FOUND]
    return docs.mapInArrow(run, T.StructType(fields))


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
           keep: list[str] | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` and what was found in each document.

    ``__n_words``, ``__spans`` (first and last word of each hit stretch) and ``__items`` (ids
    of the items with a window in it, as strings). A NULL or wordless text has no hits, an
    item without words has no window, and without any item nothing is found.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    sent = [spark.sparkContext.broadcast(a) for a in blocks(benchmark, item_id, item_text, window, block)]
    if len(sent) <= 1:
        return _search(docs, sent[0] if sent else spark.sparkContext.broadcast(Automaton([], window)), text, keep)
    row = "__row"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    some = [_search(numbered.select(row, text), a, text, [row]) for a in sent]
    every = some[0]
    for more in some[1:]:
        every = every.union(more)
    merged = F.udf(_merged, _SPANS)
    # One row per document and block; the lists are what the blocks found in one text.
    found = every.groupBy(row).agg(F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__spans")).alias("__spans"),
                                   F.flatten(F.collect_list("__items")).alias("__items")).withColumn("__spans", merged("__spans"))
    return numbered.select(row, *keep).join(found, row).drop(row)


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], coverage: int = COVERAGE, **names) -> DataFrame:
    """``keep`` with n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    found = search(docs, benchmark, keep=keep, **names)
    return found.select(
        *keep, F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (coverage * n_hit >= F.col("__n_words"))).alias("contaminated"))


def _without(text: bytes, spans: list) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    plain = text.translate(NORMAL)
    filled = np.concatenate([[False], np.frombuffer(plain, np.uint8) != 32, [False]])
    cuts = np.flatnonzero(filled[1:] != filled[:-1])
    out, at = [], 0
    for s in spans:
        out.append(text[at:cuts[2 * s["first"]]])
        at = int(cuts[2 * s["last"] + 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: int = COVERAGE,
                  longest: int | None = None, cut: bool = False, **names) -> DataFrame:
    """Documents without benchmark passages; columns as in ``docs``.

    A document is over the limit if hit words make up one in ``coverage`` of its words or,
    where ``longest`` is given, if a hit stretch is over ``longest`` words. Such a document
    goes, or with ``cut`` loses its hit stretches and stays. Others stay as they are.
    """
    found = search(docs, benchmark, text=text, **names)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    over = (n_hit > 0) & (coverage * n_hit >= F.col("__n_words"))
    if longest is not None:
        over = over | F.exists("__spans", lambda s: s["last"] - s["first"] + 1 > longest)
    if not cut:
        return found.filter(~over).select(*docs.columns)
    remove = F.udf(lambda t, spans: None if t is None else _without(t.encode(), spans).decode(), "string")
    return found.withColumn(text, F.coalesce(remove(F.when(over, F.col(text)), "__spans"), text)).select(*docs.columns)
