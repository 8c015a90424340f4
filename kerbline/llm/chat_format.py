"""Chat formatting by columnar byte assembly, and reading formatted chats back.

A turn is a header, the text and a trailer. The strings below that mark turns are broken up
inside texts by a backslash after their first character, and backslashes are doubled, so no
text contains a mark and every text can be read back. Batches are put together in numpy:
segment lengths give offsets, offsets give the place of every byte, and headers, texts and
trailers are copied into one buffer that becomes the Arrow column.

Only texts of the assistant are under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import text_bytes

#: Header and trailer by role; any other role is named in its header.
TURNS = {
    b"system": (b"<<SYS>>\n", b"\n<</SYS>>\n"),
    b"user": (b"[INST] ", b" [/INST]"),
    b"assistant": (b"<s>", b"</s>"),
}
OTHER = (b"<<ROLE:", b">>\n", b"<</ROLE>>")
#: What marks turns and must not be in a text.
CONTROL = (b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>", b"<<ROLE:", b"<</ROLE>>")
#: Bytes of formatted text that a task puts together at once; a longer conversation comes in pieces of whole turns.
PIECE = 4 << 20

_UNSAFE = re.compile(rb"\\|" + b"|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(rb"\\(\\?)")


def escape(text: bytes) -> bytes:
    return _UNSAFE.sub(lambda m: b"\\\\" if m[0] == b"\\" else m[0][:1] + b"\\" + m[0][1:], text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", text) if b"\\" in text else text


def marks(role: bytes) -> tuple[bytes, bytes]:
    """Header and trailer of a role's turns."""
    if role in TURNS:
        return TURNS[role]
    return OTHER[0] + escape(role).replace(b">", b">\\") + OTHER[1], OTHER[2]


def assemble(roles: list[bytes], texts: list[bytes], firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and their loss spans (byte offsets) from rows of turns.

    ``firsts`` are the rows at which conversations begin.
    """
    kinds: dict[bytes, int] = {}
    kind = np.fromiter((kinds.setdefault(r, len(kinds)) for r in roles), np.int64, len(roles))
    fixed = [x for r in kinds for x in marks(r)]
    escaped = [escape(t) for t in texts]
    source = np.frombuffer(b"".join([*fixed, *escaped]), np.uint8)
    fixed_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, fixed), np.int64, len(fixed)))])
    sizes = np.fromiter(map(len, escaped), np.int64, len(escaped))
    # Three segments a turn: where each starts in the source and how long it is.
    start, length = np.empty((len(roles), 3), np.int64), np.empty((len(roles), 3), np.int64)
    start[:, 0], start[:, 2] = fixed_at[2 * kind], fixed_at[2 * kind + 1]
    length[:, 0], length[:, 2] = np.diff(fixed_at)[2 * kind], np.diff(fixed_at)[2 * kind + 1]
    start[:, 1], length[:, 1] = fixed_at[-1] + np.cumsum(sizes) - sizes, sizes
    start, length = start.ravel(), length.ravel()
    offset = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(offset[-1]) + np.repeat(start - offset[:-1], length)
    data = pa.allocate_buffer(int(offset[-1]))
    np.take(source, place, out=np.frombuffer(data, np.uint8))
    bounds = np.append(offset[3 * firsts], offset[-1]).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds), data)
    spoken = np.flatnonzero(kind == kinds.get(b"assistant", -1))
    owner = np.searchsorted(firsts, spoken, side="right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(offset[3 * spoken + k] - bounds[owner]) for k in (1, 2)], names=["start", "end"])
    ends = np.searchsorted(owner, np.arange(len(firsts) + 1)).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(ends), spans)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation."""
    at = 0
    heads = {head: (role, tail) for role, (head, tail) in TURNS.items()}
    while at < len(formatted):
        for head, (role, tail) in heads.items():
            if formatted.startswith(head, at):
                at += len(head)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn at byte {at}")
            end = formatted.index(OTHER[1], at)
            role, tail = unescape(formatted[at + len(OTHER[0]):end]), OTHER[2]
            at = end + len(OTHER[1])
        # Blanks around the mark in a trailer are the template's; the mark itself is in no text.
        end = formatted.index(tail, at)
        yield role, unescape(formatted[at:end])
        at = end + len(tail)


FORMATTED = T.StructType([
    T.StructField("piece", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _format(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    roles: list[bytes] = []
    texts: list[bytes] = []
    piece, size, held = 0, 0, None

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal ids, roles, texts, piece, size
        firsts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        # The last conversation may go on; it is held back unless it fills a piece by itself.
        upto = len(ids) if last or len(firsts) == 1 else firsts[-1]
        firsts = [k for k in firsts if k < upto]
        if firsts:
            formatted, loss = assemble(roles[:upto], texts[:upto], np.array(firsts, np.int64))
            numbers = [piece, *[0] * (len(firsts) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in firsts], pa.int64()), pa.array(numbers, pa.int64()), formatted, loss], names=names)
        piece = numbers[-1] + 1 if firsts and upto == len(ids) else 0
        ids, roles, texts = ids[upto:], roles[upto:], texts[upto:]
        size = sum(map(len, texts))

    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), text_bytes(batch.column(2))):
            if piece and ids == [] and conv != held:
                piece = 0
            ids.append(conv)
            roles.append(role)
            texts.append(text)
            held = conv
            size += len(text) + 32
            if size >= PIECE:
                yield from flush(False)
    if ids:
        yield from flush(True)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, piece, formatted, loss) for every conversation, its turns in order.

    ``loss`` has byte offsets into the UTF-8 of ``formatted``. A conversation of over
    ``PIECE`` bytes comes in numbered pieces of whole turns, in order in one partition, so
    that no task holds it whole; all others are one piece, number 0. NULL roles and texts
    are empty, rows of a NULL conversation are one conversation, and turns of equal number
    are ordered by role and text. Other columns are not read.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), *FORMATTED.fields])
    return ordered.mapInArrow(lambda batches: _format(batches, schema.names), schema)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def chars(text: bytes) -> int:
        return len(text.decode())

    def rows() -> pa.RecordBatch:
        columns = zip(*[(c, n, t.hexdigest(), lc, ls.hexdigest(), fc) for c, n, t, lc, ls, fc in done])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for conv, piece, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                 text_bytes(batch.column(2)), batch.column(3).to_pylist()):
            if now is None or not piece:
                if now is not None:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                now[1] += 1
                now[2].update(b"%b\n%b\n" % (role, text))
            for s in spans:
                text = unescape(formatted[s["start"]:s["end"]])
                now[3] += chars(text)
                now[4].update(text)
            now[5] += chars(formatted)
        if len(done) >= 10_000:
            yield rows()
            done = []
    if now is not None:
        done.append(now)
    if done:
        yield rows()


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of formatted chats, as counts and digests per conversation.

    Reads pieces in the order ``format_chats`` gives them, without a shuffle.
    """
    return formatted.select("conv_id", "piece", "formatted", "loss").mapInArrow(_summary, SUMMARY)
