"""WARC archives: exact round trip, one frame per record, revisits."""

import base64
import hashlib
import random
import struct

import pytest
import zstandard

from kerbline.llm import warc_zst as wz


def page(rng, n):
    return "<p>" + "</p><p class='x'>".join(f"word{rng.randrange(500)} é" for _ in range(n)) + "</p>"


@pytest.mark.parametrize("n", [1, 3, 400])
def test_archive_layout(n):
    rng = random.Random(n)
    texts = [page(rng, rng.randrange(60)).encode() for _ in range(n)]
    records = [wz.record(i, f"http://x/{i}", t, None, False) for i, t in enumerate(texts)]
    data = wz.archive(records)
    assert data == wz.archive(records)
    got = list(wz.records_of(data))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == texts
    assert [int(h["content-length"]) for h, _ in got] == [len(b) for _, b in got]
    # Leading skippable frame with the dictionary, then a frame for each record.
    magic, size = struct.unpack_from("<II", data)
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
    assert magic == 0x184D2A5D
    rest, frames = data[8 + size:], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert frames == records
    if n == 400:
        plain = sum(len(zstandard.ZstdCompressor(level=wz.LEVEL).compress(r)) for r in records)
        assert len(data) < plain


def want(rows):
    out, by = [], {}
    for page_id, _, html in rows:
        by.setdefault(html or "", []).append(page_id)
    for page_id, _, html in rows:
        ids = [i for i in by[html or ""] if i is not None]
        first, raw = min(ids, default=None), (html or "").encode()
        response = first is None or page_id == first
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [page(rng, rng.randrange(80)) for _ in range(40)] + ["", None, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "x" * 300_000]
    rows = [(i, f"http://h.example/{i}?q= a\r\nX: y", rng.choice(texts)) for i in range(300)]
    rows += [(None, None, "only here"), (None, "u", rows[5][2]), rows[7], rows[7], (-4, "é", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")
    got = wz.round_trip(pages.repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows)
    assert wz.round_trip(pages.limit(0)).collect() == []


def test_small_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, "a" * 100) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    files = wz.write(pages, f"file://{tmp_path}/a", size=2000).collect()
    assert sum(f.records for f in files) == 20 and len(files) > 2
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(f.archive for f in files)


def test_archives_of_a_lost_attempt_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"page {i}") for i in range(30)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    lost = wz.stored(wz.write(pages.coalesce(1), folder, size=600), "archives")  # cut into more archives than the next attempt
    kept = wz.stored(wz.write(pages.coalesce(1), folder), "archives")
    assert lost.count() > kept.count() == 1
    assert len(list((tmp_path / "a").glob("*.warc.zst"))) == lost.count() + 1  # no name is used twice
    got = sorted(r.page_id for r in wz.read(kept, folder).collect())
    assert got == list(range(30)) == sorted(r.page_id for r in wz.read(lost, folder).collect())
