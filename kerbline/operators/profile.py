"""Column profiler for every column of every table.

Each column is profiled by its own value counts: the scan reads that column only (so
all columns together read the table once), equal values are combined map-side, and
every figure - distinct count, extremes, most common value - falls out of the counts.
No value list is ever held in one task, unlike ``mode`` or many distinct counts in one
aggregate, which multiply every row by the number of columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kerbline.functions.numeric import rounded


def profile_column(df: DataFrame, table: str, column: str) -> DataFrame:
    """One profile row of one column; ties of the most common value go to the smallest."""
    data_type = df.schema[column].dataType
    # Maps and variants can be neither grouped nor ordered.
    value = f"to_json(`{column}`)" if isinstance(data_type, (T.MapType, T.VariantType)) else f"`{column}`"
    counts = df.selectExpr(f"{value} AS v").groupBy("v").agg(F.expr("count(1) AS n"))
    figures = counts.agg(
        F.expr("coalesce(sum(n), 0) AS total_rows"),
        F.expr("coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS null_count"),
        F.expr("count(v) AS distinct_count"),
        F.expr("min(v) AS lowest"),
        F.expr("max(v) AS highest"),
        F.expr("min(CASE WHEN v IS NOT NULL THEN struct(-n AS rank, v) END) AS top"),
    )
    return figures.select(
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(data_type.simpleString()).alias("data_type"),
        "total_rows",
        "null_count",
        F.expr(f"{rounded('try_divide(null_count * 100.0D, total_rows)')} AS null_percentage"),
        "distinct_count",
        F.expr(f"{rounded('try_divide(distinct_count * 100.0D, total_rows)')} AS distinct_percentage"),
        F.expr("string(lowest) AS min_value"),
        F.expr("string(highest) AS max_value"),
        F.expr("string(top.v) AS most_common_value"),
    )


def profile(df: DataFrame, table: str) -> DataFrame:
    """Profile rows of all columns of a table. For row formats (CSV, JSON) store the
    table as Parquet first, so that each column can be read alone."""
    return reduce(DataFrame.unionByName, [profile_column(df, table, c) for c in df.columns])


def profile_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Profile rows of every column of every table, driven by the schemas alone."""
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in tables.items()])


def profile_schema(spark: SparkSession, schema: str) -> DataFrame:
    """Profile every table of a catalog schema; of a versioned one, what its view shows."""
    names = [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary and not re.search(r"__v\d+$", t.name)]
    return profile_all({name: spark.table(f"{schema}.{name}") for name in names})
