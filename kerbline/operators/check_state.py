"""Check results that merge: the counts behind each check, stored by batch.

A batch is scanned once when it arrives and leaves one row per check. The result of a table
is the sum over its batches, so a new or reloaded batch costs its own scan only, and how
its failure rate compares with earlier batches is a check of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.numeric import as_column, rounded
from kerbline.operators.quality import RESULT_COLUMNS, WARN_ON_ANY, Check, Policy
from kerbline.sources.tables import replace_partition, sql_text

#: Standard deviations of the difference of two rates from which a batch counts as drifted.
DRIFT = 4.0


def _cases(checks: Sequence[Check], of) -> str:
    return "CASE place " + " ".join(f"WHEN {i} THEN {of(check)}" for i, check in enumerate(checks)) + " END"


def check_counts(df: DataFrame, checks: Sequence[Check], dataset: str, batch: str) -> DataFrame:
    """(dataset, batch_id, place, column, data_quality_check, failed_rows, total_rows) of one batch, from one scan.

    Only for checks whose counts add up over batches: row rules (``quality.passes``, ``fails``)
    with the batch's rows as their total. Others are refused by name, as is a rule that
    compares with figures of the table it runs on; hand in its bounds as constants.
    """
    odd = [c.column for c in checks if c.total is not None or "count_if" not in str(c.failed)]
    if odd:
        raise ValueError(f"counts of these checks do not add up over batches: {', '.join(odd)}")
    counted = df.agg(F.expr("count(1) AS _rows"), *[as_column(c.failed).alias(f"_failed_{i}") for i, c in enumerate(checks)])
    rows = ", ".join(
        f"struct({i} AS place, {sql_text(c.column)} AS `column`, {sql_text(c.dimension)} AS data_quality_check, "
        f"_failed_{i} AS failed_rows, _rows AS total_rows)" for i, c in enumerate(checks))
    return counted.selectExpr(f"inline(array({rows}))").select(F.lit(dataset).alias("dataset"), F.lit(batch).alias("batch_id"), "*")


def merged_results(states: DataFrame, checks: Sequence[Check], empty_percentage: float | None = None) -> DataFrame:
    """Result rows, as ``run_checks`` over all batches together gives them."""
    totals = states.groupBy("place", "column", "data_quality_check").agg(F.sum("failed_rows").alias("failed_rows"), F.sum("total_rows").alias("total_rows"))
    share = rounded("try_divide(failed_rows * 100.0D, total_rows)")
    if empty_percentage is not None:
        share = f"coalesce({share}, {empty_percentage}D)"
    return totals.withColumns({
        "percentage": F.expr(share), "status": F.expr(_cases(checks, lambda c: c.policy.sql("failed_rows", "total_rows"))),
    }).select(*RESULT_COLUMNS)


def drift(states: DataFrame, batch: str, limit: float = DRIFT, policy: Policy = WARN_ON_ANY) -> DataFrame:
    """A check per check: whether the batch fails at another rate than the batches before it (by ``batch_id``).

    The difference of the two rates is held against ``limit`` standard deviations of it under one
    common rate. ``failed_rows`` is 1 for a drifted check; without earlier rows none is.
    """
    sides = states.filter(F.col("batch_id") <= batch).groupBy("place", "column", "data_quality_check").agg(*[
        F.expr(f"coalesce(sum({c}) FILTER (WHERE batch_id {op} {sql_text(batch)}), 0) AS {name}")
        for c, op, name in (("failed_rows", "=", "f1"), ("total_rows", "=", "n1"), ("failed_rows", "<", "f0"), ("total_rows", "<", "n0"))])
    rate = "((f0 + f1) / (n0 + n1))"
    moved = (f"n0 > 0 AND n1 > 0 AND abs(f1 / n1 - f0 / n0) > {limit}D * sqrt({rate} * (1 - {rate}) * (1 / n1 + 1 / n0))")
    return sides.withColumn("failed_rows", F.expr(f"IF({moved}, 1L, 0L)")).selectExpr(
        "`column`", "concat(data_quality_check, ' drift') AS data_quality_check", "failed_rows", "1L AS total_rows",
        "failed_rows * 100.0D AS percentage", f"{policy.sql('failed_rows', '1L')} AS status")


def check_batch(df: DataFrame, checks: Sequence[Check], dataset: str, batch: str, store: str) -> DataFrame:
    """Count one batch's checks into the table ``store``, in place of what that batch left there; returns the data set's rows."""
    counts = check_counts(df, checks, dataset, batch).coalesce(1)
    return replace_partition(counts, store, {"dataset": dataset, "batch_id": batch}).filter(F.col("dataset") == dataset)
