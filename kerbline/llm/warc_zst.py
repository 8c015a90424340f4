"""Dictionary-compressed WARC archives.

Each archive file begins with a skippable frame that holds a Zstandard dictionary built from
records of that archive; every record is a frame of its own, compressed with it. Equal
payloads are stored once: one record is the response, the others are revisits of it.
Archives are written by tasks into a shared folder, each attempt of a task under names of its
own. The table that ``write`` returns has the names of the attempts that succeeded, and only
these archives are read: what a lost attempt left behind is not part of the result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import pieces, shared_dir, stored

#: The frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records (before compression) in an archive.
ARCHIVE = 32 << 20
#: Dictionary size, and bytes of records that it is built from, spread over the archive.
DICTIONARY, SAMPLE = 64 << 10, 4 << 20
LEVEL = 6
_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:kerbline:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # Blanks and control characters of an address would end its header line.
    target = quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
             f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive; too few give their plain content."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE))
    some = [r[:128 << 10] for r in records[::step]]
    try:
        # Fixed segment and match lengths: no search for the best ones, and the same result every time.
        return zstandard.train_dictionary(DICTIONARY, some, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[:DICTIONARY] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """A whole archive file."""
    words = dictionary(records)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(held)), held, *map(press.compress, records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
    press = zstandard.ZstdDecompressor(dict_data=words)
    with io.BufferedReader(press.stream_reader(io.BytesIO(memoryview(data)[8 + size:]), read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("no record where one should begin")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name.lower()] = value
            block = stream.read(int(headers["content-length"]))
            stream.read(4)
            yield headers, block


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder on any file system that Arrow reaches."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file under its final name at once."""
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/.{name}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, f"{path}/{name}")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", size: int = ARCHIVE) -> DataFrame:
    """Write a record per page into archives below ``folder``; returns (archive, records, bytes).

    Of pages with equal payloads the one with the least page_id is the response and the
    others revisit it; rows that repeat that id are responses too, a NULL id is a response
    only if it has no other. A NULL html is an empty payload. An empty table gives no file.
    Digests are compared in the cluster; payloads stay where they are read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    least = stored(rows.groupBy(F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.length(F.encode("html", "UTF-8")).alias("n"))
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "payloads")
    known = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).join(least.select("sha1", "first"), "sha1", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, held, total = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, total
            name = f"part-{task}-{count:04d}.warc.zst"
            data = archive(held)
            _put(folder, name, data)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())],
                                             names=["archive", "records", "bytes"])
            count, held, total = count + 1, [], 0
            return row

        for batch in pieces(batches, "html"):
            for page, address, text, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(record(page, address, text.encode(), first, first is not None and page != first))
                total += len(held[-1])
                if total >= size:
                    yield flush()
        if held:
            yield flush()

    return known.select("page_id", "url", "html", "first").mapInArrow(run, "archive string, records long, bytes long")


_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _archived(data: bytes) -> pa.RecordBatch:
    """The rows of an archive."""
    rows = []
    for headers, block in records_of(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = headers["warc-payload-digest"].removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response" and digest(payload) != told:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        rows.append((_page_id(headers["warc-record-id"]), length if kind == "revisit" else len(payload), told, kind,
                     _page_id(headers["warc-refers-to"]) if kind == "revisit" else None))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _ROWS.split(", ")])


def read(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the ``archives`` below ``folder``.

    ``archives`` is the stored result of ``write``; only its names travel. The digest of a
    response is taken from its payload and must be the one in its header; a revisit has its
    payload's digest and length in its headers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(f"{path}/{name}") as held:
                    data = held.read()
                yield _archived(data)

    return archives.select("archive").repartition("archive").mapInArrow(run, _ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(stored(write(pages, folder), "archives"), folder)
