"""Deduplication and set difference with duplicates kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def union_by_name(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``, which should be total.

    ``row_number() = 1`` next to the window lets Spark keep one row per key and map
    task before the shuffle, so a key that owns a third of the input is no hot spot.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def keep_unless(df: DataFrame, *rules: str) -> DataFrame:
    """Rows for which no rule is TRUE (a NULL outcome keeps the row).

    Equals the multiset difference "all rows minus rows hit by a rule" without its
    full-row shuffle, because the rules depend on the row alone. Rule by rule, so that
    each simple one can be checked against file statistics.
    """
    return df.filter(" AND ".join(f"(NOT ({rule}) OR ({rule}) IS NULL)" for rule in rules))
