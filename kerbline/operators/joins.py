"""Joins to a lookup side of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Rows and bytes up to which a lookup side may be copied to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: A key is hot from this share of the facts; at most as many keys can be.
HOT_SHARE = 1 / 200


def within_rows(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most so many rows and bytes. One job that stops at the row bound."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), size).first()
    return found["n"] <= max_rows and (found["size"] or 0) <= max_bytes


def _hot_hashes(facts: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that own a large share of the facts; a bounded list."""
    per_key = facts.groupBy(F.xxhash64(*keys).alias("h")).count()
    total = per_key.agg(F.sum("count").alias("n")).scalar()
    return [r["h"] for r in per_key.filter(F.col("count") > total * HOT_SHARE).select("h").collect()]


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = 64,
    small: bool | None = None,
) -> DataFrame:
    """Join row-level facts to a lookup, keeping hot keys from landing in one task.

    The lookup is broadcast only when it was found to be within the bounds; ``small`` is the
    answer where the caller knows it. Beyond that, facts of a hot key (measured) draw one of
    ``salts`` and only the lookup rows of hot keys are present under each of them.
    """
    if within_rows(lookup, max_rows) if small is None else small:
        return facts.join(F.broadcast(lookup), list(keys), how)
    hot = _hot_hashes(facts, keys)
    if not hot:
        return facts.join(lookup, list(keys), how)
    is_hot = F.xxhash64(*keys).isin(hot)
    salted_facts = facts.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")).otherwise(0)
    )
    every = F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(0))
    return salted_facts.join(lookup.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how).drop("_salt")
