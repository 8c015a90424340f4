"""What the training-data operators share: stored intermediate tables, row keys, batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.session import checkpoint_dir

#: Words are runs of characters other than these six ASCII blanks. ``bytes.split()`` without
#: arguments cuts at exactly these, so byte-level code and the SQL pattern agree.
WORD = r"[^\x20\x09-\x0D]+"
#: Setting by which a query's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors all see, one per application.

    ``spark.checkpoint.dir`` where the session has it. Otherwise the warehouse, which a
    cluster shares too; a temporary folder only where one machine is the whole cluster.
    """
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    fallback = tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{checkpoint_dir(spark, fallback).rstrip('/')}/kerbline-llm/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, work is done once.

    Unlike a checkpoint the plan runs once, files are columnar and their size is known to
    the planner, which so broadcasts small tables by itself and no large one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later plan reads."""
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/kerbline-llm/" in path:
            _delete(df.sparkSession, path)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted when it ends, not when the driver next collects its garbage.

    For steps that store what they make, so that no shuffle is read by a later query. Should one
    be, Spark computes it anew. What is returned unread from inside runs under the session's own setting.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def discard_all(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    _delete(spark, shared_dir(spark))


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    as_text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that one holds about ``limit`` bytes of text (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; NULL gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
