"""Stored tables, batch cutting and the id remainder."""

import os
import time
import zlib

import pyarrow as pa
import pytest

from kerbline.llm import common


def test_stored_tables_are_discarded(spark):
    kept = common.stored(spark.range(5), "t")
    assert kept.count() == 5 and kept.dtypes == spark.range(5).dtypes
    folder = common.shared_dir(spark)
    (name,) = {os.path.dirname(f.removeprefix("file://")) for f in kept.inputFiles()}
    assert name.startswith(folder) and os.path.isdir(name)
    common.discard(kept)
    assert not os.path.exists(name)
    none = common.stored(spark.range(0), "t")
    assert none.count() == 0
    common.discard(spark.range(1))


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "checkpoint_dir", lambda s, fallback: f"file://{tmp_path}")
    kept = common.stored(spark.range(3), "t")
    assert all(f.startswith(f"file://{tmp_path}/") for f in kept.inputFiles()) and kept.count() == 3
    common.discard_all(spark)
    assert not os.path.exists(common.shared_dir(spark).removeprefix("file://"))


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for top in manager.localDirsString() for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO, None)
    with common.shuffles_go(spark):
        kept = common.stored(spark.range(1000).groupBy("id").count(), "t")
    assert kept.count() == 1000 and spark.conf.get(common.SHUFFLES_GO, None) == setting
    for _ in range(100):
        # The count above is a query outside; the sum of its parts is one file.
        left = shuffle_files(spark) - before
        if len({x.split("_")[1] for x in left}) <= 1:
            break
        time.sleep(0.1)
    assert len({x.split("_")[1] for x in left}) <= 1
    with pytest.raises(ValueError), common.shuffles_go(spark):
        raise ValueError
    assert spark.conf.get(common.SHUFFLES_GO, None) == setting


def test_pieces_keep_every_row():
    texts = ["", None, "a" * 100, "b" * 300, "", "é" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    for limit in (1, 50, 250, 10_000):
        cut = list(common.pieces([batch, batch.slice(0, 0)], limit=limit))
        assert [x for b in cut for x in b.column(1).to_pylist()] == texts
        assert all(b.num_rows for b in cut)
    assert len(list(common.pieces([batch], limit=250))) > 1
    assert common.text_bytes(batch.column(1))[1:3] == [b"", b"a" * 100]


def test_remainders(spark):
    rows = spark.createDataFrame([(i,) for i in (-1, 0, 7, 12345678901)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", common.crc_mod("doc_id", 3)).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 for i in got}
