"""Shards: the law, brute force, and independence of the sample."""

import zlib

import numpy as np
import pytest

from kerbline.llm import sharding as sh


def slow(spark, rows, shards):
    """(id, size, checksum, shard, slot) by one sort of everything."""
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", sh.text_order("text").alias("a")).collect()
    keyed.sort(key=lambda r: (r.a, r.doc_id is not None, r.doc_id or 0))
    sizes = [len((r.text or "").encode()) + 8 for r in keyed]
    out, at, slots = [], 0, {}
    for r, size in zip(keyed, sizes):
        k = min(shards - 1, (2 * at + size) * shards // (2 * sum(sizes)))
        out.append((r.doc_id, size, zlib.crc32((r.text or "").encode()), k, slots.get(k, 0)))
        slots[k] = slots.get(k, 0) + 1
        at += size
    return sorted(out, key=str)


def made(n=600):
    rng = np.random.default_rng(5)
    rows = [(int(i), "x" * int(rng.integers(0, 400))) for i in range(n)]
    rows += [(int(i) + n, "the same line") for i in range(n // 2)]  # a third of all rows
    rows += [(None, "no id"), (None, "no id"), (7, None), (7, ""), (3, "é" * 5000), (3, "é" * 5000)]
    return rows


def got(frame):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in frame.collect()), key=str)


@pytest.mark.parametrize("rows, samples, overfull", [(20_000, 32, 2), (40, 2, 2), (10, 1, 1.1)])
def test_placement_is_exact_whatever_the_sample(spark, monkeypatch, rows, samples, overfull):
    monkeypatch.setattr(sh, "ROWS", rows)
    monkeypatch.setattr(sh, "SAMPLES", samples)
    monkeypatch.setattr(sh, "OVERFULL", overfull)
    data = made()
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for parts in (1, 7):
        assert got(sh.assign(frame.repartition(parts), 5)) == slow(spark, data, 5)


def test_law_and_columns(spark):
    data = made()
    out = sh.assign(spark.createDataFrame([(*r, 1, "s") for r in data], "doc_id long, text string, shard int, slot string"), 5)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(5)]
    assert len(rows) == len(data) and max(sizes) - min(sizes) <= max(r.size for r in rows)
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert sh.assign(empty).count() == 0
    few = sh.assign(spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.size, r.slot) for r in few) == [("a", 8, 0), ("b", 9, 0)]


def test_overfull_ranges_are_subdivided(spark):
    keys = sh.stored(spark.createDataFrame(made(), "doc_id long, text string").selectExpr(
        "1L AS __kerbline_text", "coalesce(doc_id, -1L) AS __kerbline_id", "octet_length(coalesce(text, '')) + 8L AS size", "monotonically_increasing_id() AS __kerbline_row"), "keys")
    total = keys.agg({"size": "sum"}).first()[0]
    bounds, sizes = sh.splitters(keys, total, 20)
    assert sum(sizes.values()) == total and list(bounds) == sorted(set(bounds))
    largest = keys.agg({"size": "max"}).first()[0]
    assert max(sizes.values()) <= sh.OVERFULL * total / 20 + largest


def test_packed_keys_order_as_rows():
    x = np.random.default_rng(0).integers(-2**63, 2**63, (3000, 3))
    x[:100, 0], x[:50, 1], x[::7, 2] = 5, 0, 0
    order = np.argsort(sh.packed(*x.T), kind="stable")
    assert [tuple(r) for r in x[order].tolist()] == sorted(map(tuple, x.tolist()))


def test_written_shards_read_in_slot_order(spark, tmp_path):
    data = [(i, "x" * (i % 50)) for i in range(300)] + [(None, None), (7, "é")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id long, text string, extra int")
    back = sh.write(docs, str(tmp_path / "out"), 4, file_bytes=1000)
    assert sorted(map(str, back.select("doc_id", "text", "extra").collect())) == sorted(map(str, docs.collect()))
    want = got(sh.assign(docs, 4))
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r.shard, r["__slot"]) for r in back.collect()]
    assert sorted(rows, key=str) == want
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) > 4
    for file in files:  # a file is one stretch of slots
        slots = spark.read.parquet(str(file)).toPandas()["__slot"].tolist()
        assert slots == list(range(slots[0], slots[0] + len(slots)))
