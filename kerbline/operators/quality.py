"""Data-quality engine: many checks over a table in one aggregation.

A check counts failing rows; a policy turns counts into PASS, WARN or FAIL. All row
checks over one table share a single scan, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.numeric import as_column, rounded

#: Shape of every result row.
RESULT_COLUMNS = ("column", "data_quality_check", "failed_rows", "total_rows", "percentage", "status")


# --- status policies ------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """How failed and total counts become a status.

    ``severity``: any failure gives ``level``. ``percent``: WARN under ``limit`` percent,
    FAIL from there. ``placeholder``: FAIL over ``limit`` percent, WARN for any.
    ``tolerated``: PASS up to ``limit`` rows, WARN beyond.
    """

    kind: str
    level: str = "FAIL"
    limit: float = 5.0

    def sql(self, failed: str, total: str) -> str:
        share = f"try_divide({failed} * 100.0D, {total})"
        if self.kind == "severity":
            return f"CASE WHEN {failed} = 0 THEN 'PASS' ELSE '{self.level}' END"
        if self.kind == "percent":
            return f"CASE WHEN {failed} = 0 THEN 'PASS' WHEN {share} < {self.limit}D THEN 'WARN' ELSE 'FAIL' END"
        if self.kind == "placeholder":
            return f"CASE WHEN {share} > {self.limit}D THEN 'FAIL' WHEN {failed} > 0 THEN 'WARN' ELSE 'PASS' END"
        if self.kind == "tolerated":
            return f"CASE WHEN {failed} <= {self.limit}D THEN 'PASS' ELSE 'WARN' END"
        raise ValueError(f"unknown status policy: {self.kind}")


FAIL_ON_ANY = Policy("severity", level="FAIL")
WARN_ON_ANY = Policy("severity", level="WARN")
BY_PERCENT = Policy("percent")
PLACEHOLDER = Policy("placeholder")


def tolerated(rows: int) -> Policy:
    return Policy("tolerated", limit=rows)


def status(failed: str, total: str, policy: Policy) -> Column:
    """Status column from two SQL expressions."""
    return F.expr(policy.sql(failed, total))


# --- checks ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A named check. ``failed`` is an aggregate over the table it runs on (Column or SQL
    text); ``total`` defaults to the row count of that table."""

    column: str
    dimension: str
    failed: Column | str
    policy: Policy
    total: Column | str | None = None


def passes(column: str, dimension: str, rule: Column | str, policy: Policy) -> Check:
    """Row rule that good rows meet. A NULL outcome is not a failure."""
    failed = f"count_if(NOT ({rule}))" if isinstance(rule, str) else F.count_if(~rule)
    return Check(column, dimension, failed, policy)


def fails(column: str, dimension: str, rule: Column | str, policy: Policy) -> Check:
    """Row rule that bad rows meet. A NULL outcome is not a failure."""
    failed = f"count_if({rule})" if isinstance(rule, str) else F.count_if(rule)
    return Check(column, dimension, failed, policy)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run_checks(
    df: DataFrame, checks: Sequence[Check], total: Column | None = None, empty_percentage: float | None = None
) -> DataFrame:
    """Evaluate all checks in one pass and return one result row per check.

    ``total`` replaces the denominator of every check that has none of its own, for
    instance the row count of another layer as a scalar subquery. ``empty_percentage``
    is reported when the denominator is zero (default NULL).
    """
    metrics = [F.expr("count(1) AS _rows")]
    rows = []
    for i, check in enumerate(checks):
        failed, whole = f"bigint(_failed_{i})", "_rows"
        metrics.append(as_column(check.failed).alias(f"_failed_{i}"))
        if check.total is not None:
            metrics.append(as_column(check.total).alias(f"_total_{i}"))
            whole = f"bigint(_total_{i})"
        share = rounded(f"try_divide({failed} * 100.0D, {whole})")
        if empty_percentage is not None:
            share = f"coalesce({share}, {empty_percentage}D)"
        rows.append(
            f"struct({_quoted(check.column)} AS `column`, {_quoted(check.dimension)} AS data_quality_check, "
            f"{failed} AS failed_rows, {whole} AS total_rows, {share} AS percentage, "
            f"{check.policy.sql(failed, whole)} AS status)"
        )
    counted = df.agg(*metrics)
    if total is not None:
        counted = counted.withColumn("_rows", total.cast("long"))
    return counted.selectExpr(f"inline(array({', '.join(rows)}))")


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``rows``, ``distinct_keys``, ``null_keys``, ``repeated_keys``.

    NULL keys count as rows but not as distinct keys, like COUNT(DISTINCT). Keys are
    combined map-side, so copies of one key do not travel.
    """
    has_null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    per_key = df.groupBy(*keys).agg(F.expr("count(1) AS _n"))
    return per_key.agg(
        F.expr("coalesce(sum(_n), 0) AS rows"),
        F.expr(f"count_if(NOT ({has_null})) AS distinct_keys"),
        F.expr(f"coalesce(sum(_n) FILTER (WHERE {has_null}), 0) AS null_keys"),
        F.expr("count_if(_n > 1) AS repeated_keys"),
    )


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row: equal for rows that compare equal (0.0 and -0.0 do), and for no others."""
    return F.sha2(F.to_json(F.struct(*[
        (F.col(f"`{f.name}`") + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema
    ])), 256)


def duplicate_rows(df: DataFrame, policy: Policy = FAIL_ON_ANY, empty_percentage: float | None = 0.0) -> DataFrame:
    """Whole-row duplicates: rows minus distinct rows.

    One scan; a digest per row is counted, first within each task, so copies of one row do not
    travel and full rows never do.
    """
    per_row = df.select(row_digest(df).alias("_h")).groupBy("_h").agg(F.expr("count(1) AS _n"))
    return run_checks(
        per_row, [Check("ALL_COLUMNS", "Uniqueness", "coalesce(sum(_n - 1), 0)", policy, "coalesce(sum(_n), 0)")], empty_percentage=empty_percentage
    )


#: Ranges into which a range that holds a rank is split, and how often: a binade of doubles
#: (2**52 values) comes down to a few values.
_SPLIT, _ROUNDS = 1 << 16, 3


def order_statistics(df: DataFrame, columns: str | Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, q) per numeric column: the exact values at rank ceil(share * n) of its non-NULL values.

    Values of all columns are counted in one scan. Ranks are then closed in on: by power of
    two, then by splitting the one range that holds the rank into equal parts, of which the
    counts are summed. No task puts more than ``_SPLIT`` ranges in order, however many values
    there are; splitting is monotone in the value, so rounding moves no rank. A column
    without values has no row. NaN comes last.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in names)
    counts = df.selectExpr(f"stack({len(names)}, {stacked}) AS (_c, _v)").filter("_v IS NOT NULL").groupBy("_c", "_v").agg(F.expr("count(1) AS _n"))
    ranks = ", ".join(f"struct({i} AS i, greatest(1, CAST(ceil({share}D * _all) AS BIGINT)) AS rank)" for i, share in enumerate(shares))
    # A rank's state: the values it lies between, and its rank among them.
    power = ("CASE WHEN isnan(_v) THEN 3000 WHEN _v = 0 THEN 0 "
             "ELSE CAST(signum(_v) * (1100 + floor(least(log2(abs(_v)), 1025D))) AS INT) END")
    first = counts.groupBy("_c", F.expr(power).alias("_k")).agg(F.expr("sum(_n) AS _m"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
    first = first.withColumn("_all", F.expr("sum(_m) OVER (PARTITION BY _c)")).withColumn("_r", F.expr(f"explode(array({ranks}))"))
    state = _holding(first.selectExpr("_c", "_r.i AS i", "_r.rank AS rank", "_k", "_m", "_lo", "_hi"))
    for _ in range(_ROUNDS):
        part = f"IF(_to > _from, CAST(floor((_v - _from) / (_to - _from) * {_SPLIT}D) AS INT), 0)"
        inside = counts.join(F.broadcast(state), "_c").filter("_v BETWEEN _from AND _to").groupBy("_c", "i", "rank", F.expr(part).alias("_k")).agg(
            F.expr("sum(_n) AS _m"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
        state = _holding(inside)
    last = counts.join(F.broadcast(state), "_c").filter("_v BETWEEN _from AND _to")
    found = _holding(last.selectExpr("_c", "i", "rank", "_v AS _k", "_n AS _m", "_v AS _lo", "_v AS _hi"))
    return found.groupBy(F.col("_c").alias("column")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "_from"))), lambda r: r["_from"]).alias("q"))


def _holding(parts: DataFrame) -> DataFrame:
    """(_c, i, rank, _from, _to): of each rank's parts (_k, _m, _lo, _hi) the one that holds it, and the rank within. A few rows a column."""
    upto = parts.withColumn("_upto", F.expr("sum(_m) OVER (PARTITION BY _c, i ORDER BY _k)"))
    return upto.filter("_upto >= rank AND _upto - _m < rank").selectExpr("_c", "i", "rank - (_upto - _m) AS rank", "_lo AS _from", "_hi AS _to")


def iqr_bounds(df: DataFrame, column: str, accuracy: int | None = None, factor: float = 1.5) -> DataFrame:
    """One row ``lower, upper``: quartiles widened by ``factor`` ranges, floored at zero.

    Quartiles are exact; without values both bounds are NULL. ``accuracy`` asks for a mergeable sketch instead, with rank error
    ``rows / accuracy``.
    """
    if accuracy is None:
        quartiles = order_statistics(df, column, (0.25, 0.75)).agg(F.max("q").alias("q"))
    else:
        quartiles = df.agg(F.expr(f"percentile_approx(`{column}`, array(0.25, 0.75), {accuracy}) AS q"))
    return quartiles.selectExpr(
        f"IF(q[0] IS NULL, NULL, greatest(0.0D, q[0] - {factor}D * (q[1] - q[0]))) AS lower",
        f"q[1] + {factor}D * (q[1] - q[0]) AS upper",
    )


def missing_keys(source: DataFrame, target: DataFrame, source_key: str, target_key: str | None = None) -> DataFrame:
    """Distinct keys of ``source`` that ``target`` lacks."""
    wanted = source.select(F.col(source_key).alias("_key")).distinct()
    held = target.select(F.col(target_key or source_key).alias("_key"))
    return wanted.join(held, "_key", "left_anti").withColumnRenamed("_key", source_key)


def floor_check(df: DataFrame, column: str, floor: int, label: str, dimension: str = "Validity",
                policy: Policy = BY_PERCENT) -> DataFrame:
    """Canary: fails (1) unless the column has more than ``floor`` distinct values."""
    distinct = f"count(DISTINCT `{column}`)"
    return run_checks(
        df, [Check(label, dimension, f"CASE WHEN {distinct} > {floor} THEN 0 ELSE 1 END", policy, distinct)]
    )


def reconcile(source: DataFrame, landed: DataFrame, name: str = "rows", policy: Policy = FAIL_ON_ANY) -> DataFrame:
    """Rows landed must equal rows in the source; the failure is the difference."""
    expected = source.agg(F.expr("count(1) AS n")).scalar()
    sizes = landed.agg(F.expr("count(1) AS landed")).withColumn("expected", expected)
    return run_checks(
        sizes, [Check(name, "Completeness", "sum(abs(landed - expected))", policy, "sum(expected)")]
    )


def schema_drift(frames: dict[str, DataFrame]) -> DataFrame:
    """Columns that differ between batches of one table: name, batch, type (NULL: absent).

    Compares schemas only; no data is read.
    """
    types = {batch: {f.name: f.dataType.simpleString() for f in df.schema} for batch, df in frames.items()}
    names = sorted({c for held in types.values() for c in held})
    rows = [
        (name, batch, held.get(name))
        for name in names
        if len({held.get(name) for held in types.values()}) > 1
        for batch, held in types.items()
    ]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "column string, batch string, data_type string")
