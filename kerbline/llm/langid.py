"""Language identification by cross-parsing entropy.

A text is parsed against a reference text of each language into phrases, each the longest
stretch from where the last one ended that occurs in the reference. The phrases' number,
times the bits that name a place in the reference, over the text's length estimates the
cross entropy; the language with the least wins. A suffix automaton of the reference finds
phrases without looking back: where no step leads on, a phrase ends and the next begins at
the root. An automaton is built by one task for each language and kept as sparse arrays of
steps (``prefix_trie.pack``), whose size follows the reference and not the alphabet; numpy walks
all stretches of a batch of texts in lockstep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import crc_mod, pieces, stored
from kerbline.llm.prefix_trie import fitted

#: Letters of reference text per language, and the longest stretch of one text that goes into it.
REFERENCE, LONGEST = 40_000, 10_000
#: Texts are parsed in stretches of so many letters, the first phrase of each beginning with it.
STRETCH = 512
#: Characters that are turned into symbols at a time.
PART = 1 << 20
UNKNOWN = "und"
_ARRAYS = ("base", "check", "target", "first")


@cache
def _alpha() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Language:
    """Automaton of a reference, whose last state has no step.

    A step by symbol c from state s is at ``base[s] + c`` where ``check`` there is s; that place is
    inside the arrays for every state and symbol.
    """

    name: str
    bits: float  # per phrase
    base: np.ndarray
    check: np.ndarray
    target: np.ndarray
    first: np.ndarray  # by symbol: the root's step, or the last state

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after ``symbol``, and where no step led on, so that a phrase ended in front of it."""
        at = self.base.take(state)
        at += symbol
        ended = self.check.take(at) != state
        return np.where(ended, self.first.take(symbol), self.target.take(at)), ended


@dataclass
class Model:
    letters: np.ndarray  # sorted code points of all references; a letter's symbol is its place + 2
    languages: list[Language]

    @property
    def names(self) -> list[str]:
        return [x.name for x in self.languages]


def numbered(code: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Symbols of letters: 0, which matches nothing, for one that no reference has."""
    if not len(letters):
        return np.zeros(len(code), np.int32)
    at = np.minimum(np.searchsorted(letters, code), len(letters) - 1)
    return np.where(letters[at] == code, at + 2, 0).astype(np.int32)


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts with runs of non-letters as one blank, sizes, and whether there is a letter."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lower), np.int64, len(texts)))
    letter = _alpha()[code]
    line = np.ones(len(code), np.int32)
    line[letter] = numbered(code[letter], letters)
    keep = letter.copy()
    if len(code):
        keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first blank after a letter
    sizes = np.bincount(owner[keep], minlength=len(texts))
    return line[keep], sizes, np.bincount(owner[letter], minlength=len(texts)) > 0


def automaton(line: list[int]) -> list[dict[int, int]]:
    """Steps of the suffix automaton of a sequence; state 0 is the root."""
    size, link, out, last = [0], [-1], [{}], 0
    for t in line:
        new, v = len(size), last
        size.append(size[last] + 1)
        link.append(0)
        out.append({})
        while v != -1 and t not in out[v]:
            out[v][t] = new
            v = link[v]
        if v != -1:
            q = out[v][t]
            if size[q] == size[v] + 1:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[v] + 1)
                link.append(link[q])
                out.append(dict(out[q]))
                while v != -1 and out[v].get(t) == q:
                    out[v][t] = copy
                    v = link[v]
                link[q] = link[new] = copy
        last = new
    return out


def letters_of(texts: list[str]) -> np.ndarray:
    """Sorted code points of the letters in lower-cased texts."""
    code = np.unique(np.frombuffer("".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    return code[_alpha()[code]]


def learnt(name: str, texts: list[str], letters: np.ndarray) -> Language:
    """A language's automaton from its reference texts."""
    line = symbols([f"{t} " for t in texts], letters)[0]
    out = automaton(line[line > 0].tolist())
    owner = np.repeat(np.arange(len(out)), [len(x) for x in out])
    symbol = np.array([c for x in out for c in x], np.int64)
    target = np.array([q for x in out for q in x.values()], np.int64)
    base, places = fitted(owner, symbol, len(out) + 1)
    shift, span = max(0, -int(base.min(initial=0))), len(letters) + 2
    base, places = base + shift, places + shift
    size = max(int(places.max(initial=0)), int(base.max(initial=0)) + span) + 1
    check, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    check[places], to[places] = owner, target
    first = np.full(span, len(out), np.int32)
    for c, q in out[0].items():
        first[c] = q
    return Language(name, log2(max(2, len(line))), base.astype(np.int32), check, to, first)


def build(references: dict[str, list[str]]) -> Model:
    """Model from the texts of each language, in one process."""
    letters = letters_of([t for texts in references.values() for t in texts])
    return Model(letters, [learnt(name, references[name], letters) for name in sorted(references)])


def phrases(line: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of each symbol sequence (laid end to end) against each language."""
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + number * STRETCH
    length = np.minimum(np.repeat(sizes, parts) - number * STRETCH, STRETCH)
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    langs = len(model.languages)
    state = np.zeros((langs, len(order)), np.int32)
    count = np.zeros((langs, len(order)), np.int32)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))
        symbol = line[begin[:n] + t]
        for k, language in enumerate(model.languages):
            state[k, :n], ended = language.step(state[k, :n], symbol)
            count[k, :n] += ended | (t == 0)  # a phrase begins with each stretch
    return np.stack([np.bincount(owner, c, len(sizes)) for c in count], axis=1) if langs else np.zeros((len(sizes), 0))


def _cut(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Texts in parts of ``PART`` characters at most; the owner of each part."""
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PART):
            yield k, text[at:at + PART]


def identify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is how much longer the next best parse is (0 to 1).

    Texts are taken in parts of ``PART`` characters, at whose ends a phrase ends too: memory
    does not grow with the length of a text beyond the text itself.
    """
    cost, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
    held: list[tuple[int, str]] = []

    def add() -> None:
        owner = np.array([k for k, _ in held], np.int64)
        line, sizes, found = symbols([x for _, x in held], model.letters)
        np.add.at(cost, owner, phrases(line, sizes, model) * np.array([x.bits for x in model.languages]))
        np.logical_or.at(letters, owner, found)

    size = 0
    for k, part in _cut([t or "" for t in texts]):
        if held and size + len(part) > PART:
            add()
            held, size = [], 0
        held.append((k, part))
        size += len(part)
    if held:
        add()
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = np.argmin(cost, axis=1)
    low = np.sort(cost, axis=1)
    score = np.ones(len(texts)) if cost.shape[1] == 1 else 1 - low[:, 0] / np.maximum(low[:, 1], 1e-9)
    return [model.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", letters: int = REFERENCE) -> DataFrame:
    """(lang, h, text): for each language stretches of texts with about twice ``letters`` characters, picked by the hash of their id.

    A text of over ``LONGEST`` characters gives one stretch of it, whose place the hash decides, so
    a language with only long texts is learnt as any other; of every language at least one
    text is taken. Rows without an id are not learnt from, and an id that is repeated gives
    one row: what is taken is bounded by the number of languages, however ids are spread.
    """
    size = F.least(F.length("text"), F.lit(LONGEST))
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h")).filter(
        F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & F.col(doc_id).isNotNull())
    # Stored, its size is known: a few languages are broadcast, any number is not.
    share = rows.groupBy("lang").agg((F.lit(2.0 * letters) / F.sum(size)).alias("share"), F.min(F.pmod("h", F.lit(1 << 30))).alias("least"))
    share = stored(share, "shares")
    place = F.pmod("h", F.lit(1 << 30))
    some = rows.join(share, "lang").filter((place < F.least(F.col("share"), F.lit(1.0)) * (1 << 30)) | (place == F.col("least")))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - LONGEST + 1)) + 1
    stretch = F.substring(F.col("text"), start, F.lit(LONGEST))
    return stored(some.withColumn("text", stretch).groupBy("lang", "h").agg(F.min("text").alias("text")), "references")


def _chosen(rows: list[tuple[int, str]], letters: int) -> list[str]:
    """Texts in the order of their hashes, until they have ``letters`` characters."""
    out, size = [], 0
    for _, said in sorted(rows):
        if size >= letters:
            break
        out.append(said)
        size += len(said)
    return out


def train(picked: DataFrame, letters: int = REFERENCE) -> Model:
    """Model from stored ``references``; each language's automaton is built in a task.

    What comes to the driver and is broadcast are the letters in use and, for each language,
    some arrays of a few times ``letters`` numbers (about 2 MB).
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(letters_of(batch.column(0).to_pylist()).astype(np.int64))], names=["c"])

    codes = picked.select("text").mapInArrow(found, "c long").distinct().toPandas()["c"]
    known = np.sort(codes.to_numpy()).astype(np.uint32)

    def one(table: pa.Table) -> pa.Table:
        name = table.column("lang")[0].as_py()
        x = learnt(name, _chosen(list(zip(table.column("h").to_pylist(), table.column("text").to_pylist())), letters), known)
        return pa.table({"lang": [name], "bits": [x.bits], **{k: pa.array([getattr(x, k).tobytes()], pa.binary()) for k in _ARRAYS}})

    rows = picked.groupBy("lang").applyInArrow(one, "lang string, bits double, " + ", ".join(f"{k} binary" for k in _ARRAYS)).toArrow().to_pylist()
    return Model(known, [Language(r["lang"], r["bits"], *(np.frombuffer(r[k], np.int32) for k in _ARRAYS))
                         for r in sorted(rows, key=lambda r: r["lang"])])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``; ``und`` for a text without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 4 << 20):
            names, score = identify(batch.column(len(keep)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(score)], names=[*keep, "lang_pred", "score"])

    fields = [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType(fields))


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; a quarter of the ids is never learnt from.

    Languages are those of the documents learnt from; ties go to the first by name. Without
    any, every text is ``und``. Repeated rows are predicted alike, and so are rows without an id.
    """
    model = train(references(docs.filter(crc_mod("doc_id", 4) != 2)))
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
