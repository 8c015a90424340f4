"""Provenance and table writers on plain Parquet tables.

Parquet tables have no row-level MERGE and cannot be overwritten while they are read,
so incremental tables are published as versions: write ``name__v<k+1>``, then point
the view ``name`` at it. Readers always see one complete version.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

#: The layer namespaces, in build order.
LAYERS = ("raw", "clean", "mart", "bi_visualization", "validation", "dq_visualization")


class EmptyBatchError(ValueError):
    """Raised before a write when a load would replace good data by nothing."""


def with_provenance(
    df: DataFrame, source_system: str, batch_id: str, ingested_at: Column | None = None
) -> DataFrame:
    """Stamp where a row came from, when it was loaded and with which batch."""
    return df.withColumns({
        "source_system": F.lit(source_system),
        "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
        "batch_id": F.lit(batch_id),
    })


def records_frame(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """Explicit-schema DataFrame from a handful of records (no inference)."""
    return spark.createDataFrame(rows, schema)


def ensure_schemas(spark: SparkSession, layers: Sequence[str] = LAYERS, prefix: str = "") -> list[str]:
    """Create the layer namespaces if absent; returns their names."""
    names = [f"{prefix}{layer}" for layer in layers]
    for name in names:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")
    return names


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> DataFrame:
    """Create an empty Parquet table with this schema (and its column comments) if absent."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], schema).write.format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def ensure_table_like(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create an empty table with the schema of a query if absent."""
    return ensure_table(df.sparkSession, name, df.schema, path)


def write_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Replace a table and its schema by this DataFrame, and return it as stored.

    ``partition_by`` lets readers prune batches; ``bucket_by=(n, key)`` lays rows out so
    that later joins and upserts on ``key`` need no shuffle of this table. ``path`` puts
    the data outside the warehouse folder.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        buckets, key = bucket_by
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _observed(df: DataFrame, name: str, time_col: str | None) -> tuple[DataFrame, Observation]:
    seen = Observation(f"load:{name}")
    metrics = [F.count(F.lit(1)).alias("rows_loaded")]
    if time_col:
        metrics += [F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time")]
    return df.observe(seen, *metrics), seen


def write_table_reporting(
    df: DataFrame, name: str, time_col: str | None = None, **layout
) -> dict[str, object]:
    """Write and report rows and time range from the same pass (no second scan)."""
    watched, seen = _observed(df, name, time_col)
    write_table(watched, name, **layout)
    return dict(seen.get)


def publish_reporting(df: DataFrame, name: str, time_col: str | None = None, **layout) -> dict[str, object]:
    """The same for a new version of a table: readers keep the old one until the write is complete."""
    watched, seen = _observed(df, name, time_col)
    publish_version(watched, name, **layout)
    return dict(seen.get)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a session view."""
    df.createOrReplaceTempView(name)
    return df


def create_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Create or replace a stored view over stored tables."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def _versions(spark: SparkSession, name: str) -> list[int]:
    schema, _, table = name.rpartition(".")
    listed = spark.catalog.listTables(schema or None, f"{table}__v*")
    hits = (re.fullmatch(rf"{re.escape(table)}__v(\d+)", t.name) for t in listed)
    return sorted(int(h.group(1)) for h in hits if h)


def publish_version(
    df: DataFrame, name: str, keep: int = 2, bucket_by: tuple[int, str] | None = None, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Store ``df`` as the next version of ``name`` and switch readers over to it.

    ``df`` may read the current version. The switch is one catalog update after the
    write has committed, so a job that dies half way leaves the old version in place.
    """
    spark = df.sparkSession
    held = _versions(spark, name)
    number = (held[-1] if held else 0) + 1
    write_table(df, f"{name}__v{number}", partition_by, bucket_by)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}__v{number}")
    for old in held:
        if old <= number - keep:
            spark.sql(f"DROP TABLE IF EXISTS {name}__v{old}")
    return spark.table(name)


def append_new(
    batch: DataFrame, name: str, key: str, partition: str, span: tuple[str, str] | None = None
) -> DataFrame:
    """Append the batch rows whose key the table lacks; held rows are never rewritten.

    The table is created, partitioned, on first use. ``partition`` is the batch column
    that is also part of the key, so only partitions in the range of the batch are read
    to look for held keys. ``span``, where the caller knows it, is that range; otherwise the
    batch is computed once for it and once more to be written. Running a batch again
    appends nothing.
    """
    spark = batch.sparkSession
    if not spark.catalog.tableExists(name):
        batch.limit(0).write.format("parquet").partitionBy(partition).saveAsTable(name)
    held = spark.table(name)
    low, high = span or batch.agg(F.min(partition), F.max(partition)).first()
    in_range = held.filter(F.col(partition).between(F.lit(low), F.lit(high)))
    fresh = batch.join(in_range.select(key), key, "left_anti").select(*held.columns)
    fresh.write.mode("append").format("parquet").partitionBy(partition).saveAsTable(name)
    return spark.table(name)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replace_partition(rows: DataFrame, name: str, partition: dict[str, str]) -> DataFrame:
    """Store ``rows`` as one partition of a table, in place of what it held; nothing else is read or rewritten.

    ``rows`` has the partition columns too. The table is created on first use.
    """
    spark = rows.sparkSession
    if not spark.catalog.tableExists(name):
        rows.limit(0).write.format("parquet").partitionBy(*partition).saveAsTable(name)
    columns = [c for c in spark.table(name).columns if c not in partition]
    staged = f"_staged_{uuid.uuid4().hex}"
    rows.select(*columns).createTempView(staged)
    where = ", ".join(f"`{c}` = {sql_text(v)}" for c, v in partition.items())
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({where}) SELECT {', '.join(f'`{c}`' for c in columns)} FROM {staged}")
    spark.catalog.dropTempView(staged)
    return spark.table(name)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Abort the load when a batch is empty; looks at one row only."""
    if df.isEmpty():
        raise EmptyBatchError(message)
    return df


def load_report(df: DataFrame, by: Sequence[str] = ("batch_id",), time_col: str | None = None) -> DataFrame:
    """Row count (and time range) per batch, in one aggregation."""
    metrics = [F.count(F.lit(1)).alias("rows_loaded")]
    if time_col:
        metrics += [F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time")]
    return df.groupBy(*by).agg(*metrics)


def preview(df: DataFrame, order_by: Sequence[str | Column], n: int = 20) -> DataFrame:
    """The first ``n`` rows in a given order (a top-n, never a global sort)."""
    return df.orderBy(*order_by).limit(n)
