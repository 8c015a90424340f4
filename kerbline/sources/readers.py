"""Batch readers: Parquet batches, lookup files by extension, hourly JSON documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_parquet_batches(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """One DataFrame per named Parquet batch (a file, a folder or a glob)."""
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def read_lookup(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Lookup file by extension: JSON lines, Parquet, and CSV for everything else.

    Pass ``schema`` to skip CSV/JSON type inference, which costs a pass over the file.
    """
    kind = PurePosixPath(path).suffix.lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == ".parquet":
        return reader.parquet(path)
    if kind == ".json":
        return reader.json(path)
    return reader.csv(path, header=True, inferSchema=schema is None)


#: An hourly weather document: scalars of the place and parallel arrays, one slot per hour.
HOURLY_FIELDS = ("time", "temperature_2m", "precipitation", "rain", "snowfall", "weather_code", "wind_speed_10m")
WEATHER_DOCUMENT = (
    "latitude double, longitude double, timezone string, elevation double, "
    "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>, "
    "rain: array<double>, snowfall: array<double>, weather_code: array<bigint>, wind_speed_10m: array<double>>"
)


def read_weather_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather documents, one per file, with a fixed schema (no inference pass)."""
    return spark.read.schema(WEATHER_DOCUMENT).json(path, multiLine=True)


def explode_parallel_arrays(
    df: DataFrame, struct_col: str, fields: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """One row per array slot, the ``carry`` columns repeated on each.

    Arrays of unequal length are padded with NULL to the longest one. A generator, not
    a join: no shuffle, and a document is spread over rows inside its own task.
    """
    zipped = F.arrays_zip(*[F.col(f"{struct_col}.{f}").alias(f) for f in fields])
    return df.select(*carry, F.inline(zipped).alias(*fields))


def weather_observations(documents: DataFrame, time_format: str | None = None) -> DataFrame:
    """Hourly documents to one row per hour with a typed observation time."""
    rows = explode_parallel_arrays(
        documents, "hourly", HOURLY_FIELDS, ("latitude", "longitude", "timezone", "elevation")
    )
    return rows.select(
        parse_local_time("time", time_format).alias("observation_time"),
        *[f for f in HOURLY_FIELDS if f != "time"],
        "latitude", "longitude", "timezone", "elevation",
    )


def parse_local_time(column: str, time_format: str | None = None) -> Column:
    """Wall-clock text to TIMESTAMP_NTZ; malformed text becomes NULL, not an error."""
    text = F.col(column)
    if time_format:
        return F.try_to_timestamp(text, F.lit(time_format)).cast("timestamp_ntz")
    return text.try_cast("timestamp_ntz")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML pages, one row per file: ``page_id`` (the file), ``html``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html")
    )
