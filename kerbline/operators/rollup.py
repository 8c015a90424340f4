"""Rollups over data-quality result rows (tens of rows, one per check)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.operators.quality import RESULT_COLUMNS

#: One vocabulary: capitalised dimensions, and PASS/FAIL for the longer spellings that
#: older result tables hold.
_SHAPE = (
    "`column`", "initcap(data_quality_check) AS data_quality_check", "failed_rows", "total_rows", "percentage",
    "CASE upper(status) WHEN 'PASSED' THEN 'PASS' WHEN 'FAILED' THEN 'FAIL' ELSE upper(status) END AS status",
)


def unify(results: Mapping[str, DataFrame]) -> DataFrame:
    """Result tables as one with a ``dataset`` label, in one vocabulary, so that rollups
    do not split one group in two. Columns match whatever their case."""
    shaped = [
        df.selectExpr(f"'{dataset}' AS dataset", *_SHAPE).toDF("dataset", *RESULT_COLUMNS)
        for dataset, df in results.items()
    ]
    return reduce(DataFrame.unionByName, shaped)


def unified_query(stored: Mapping[str, str]) -> str:
    """SQL text of :func:`unify` over stored result tables, for a stored view."""
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, {', '.join(_SHAPE)} FROM {table}" for dataset, table in stored.items()
    )


def severity_rank() -> Column:
    return F.when(F.col("status") == "FAIL", 1).when(F.col("status") == "WARN", 2).otherwise(3)


def order_by_severity(dq: DataFrame) -> DataFrame:
    """FAIL, then WARN, then PASS; within each by column and dimension."""
    return dq.orderBy(severity_rank(), "column", "data_quality_check")


def status_totals(dq: DataFrame) -> DataFrame:
    """One row: passed, warned, failed and all checks."""
    return dq.agg(
        F.count_if(F.col("status") == "PASS").alias("pass_checks"),
        F.count_if(F.col("status") == "WARN").alias("warn_checks"),
        F.count_if(F.col("status") == "FAIL").alias("fail_checks"),
        F.count(F.lit(1)).alias("total_checks"),
    )


def by_dataset_status(dq: DataFrame) -> DataFrame:
    return dq.groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("check_count")).orderBy("dataset", "status")


def by_status(dq: DataFrame) -> DataFrame:
    return dq.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def by_dimension(dq: DataFrame) -> DataFrame:
    return (
        dq.groupBy("data_quality_check").agg(F.count(F.lit(1)).alias("check_count"))
        .orderBy(F.desc("check_count"), "data_quality_check")
    )


def issues(dq: DataFrame, datasets: Sequence[str] | None = None, statuses: Sequence[str] | None = None) -> DataFrame:
    """Failed and warned checks, worst first; optionally only some datasets or statuses."""
    found = dq.filter(F.col("status").isin("FAIL", "WARN"))
    if datasets is not None:
        found = found.filter(F.col("dataset").isin(*datasets))
    if statuses is not None:
        found = found.filter(F.col("status").isin(*statuses))
    return found.orderBy(severity_rank(), F.desc("percentage"), "dataset", "column", "data_quality_check")
