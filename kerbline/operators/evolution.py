"""Column types that drift between batches of one table: a least common type, no loss, no silent narrowing.

Types are widened along integer < decimal < double < string and date < timestamp < string; a
column that a batch lacks is NULL there. Casts are part of each batch's own projection, so
filters and column pruning still reach its scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Decimal digits that every value of an integer type fits into, and those a double holds exactly.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_EXACT = 15
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


class NarrowingError(ValueError):
    """Raised when a batch has columns that do not fit the types asked for."""


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = (type(a), type(b))
    if all(k in _WHOLE for k in kinds):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if all(k in (*_WHOLE, T.DecimalType) for k in kinds):
        scale = max(getattr(t, "scale", 0) for t in (a, b))
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in (a, b))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(k in (*_WHOLE, T.DecimalType, T.FloatType, T.DoubleType) for k in kinds):
        return T.DoubleType()
    if all(k in _TIMES for k in kinds):
        return max(a, b, key=lambda t: _TIMES.index(type(t)))
    if all(issubclass(k, T.ArrayType) for k in kinds):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if all(issubclass(k, T.StructType) for k in kinds):
        return merged_schema([a, b])
    return T.StringType()


def is_exact(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of ``source`` survives the way to ``target``: long integers and long decimals may not fit a double."""
    if not isinstance(target, T.DoubleType):
        return True
    if isinstance(source, T.DecimalType):
        return source.precision <= _EXACT
    return _DIGITS.get(type(source), 0) <= _EXACT


def merged_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """One schema for all: columns in the order in which they first appear, names compared without case."""
    types: dict[str, T.DataType] = {}
    names: dict[str, str] = {}
    for schema in schemas:
        for field in schema:
            key = field.name.lower()
            names.setdefault(key, field.name)
            types[key] = common_type(types[key], field.dataType) if key in types else field.dataType
    return T.StructType([T.StructField(names[k], T.StringType() if isinstance(t, T.NullType) else t) for k, t in types.items()])


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The batch in the given columns and types; absent columns are NULL.

    Columns whose type would have to be narrowed, or that the schema does not have, are refused by name.
    """
    held = {f.name.lower(): f for f in df.schema}
    wanted = {f.name.lower() for f in schema}
    bad = [f"{f.name}: {held[f.name.lower()].dataType.simpleString()} into {f.dataType.simpleString()}" for f in schema
           if f.name.lower() in held and common_type(held[f.name.lower()].dataType, f.dataType) != f.dataType]
    bad += [f"{f.name}: no such column" for k, f in held.items() if k not in wanted]
    if bad:
        raise NarrowingError("; ".join(bad))

    def column(field: T.StructField):
        own = held.get(field.name.lower())
        if own is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        source = F.col(f"`{own.name}`")
        nested = isinstance(own.dataType, (T.ArrayType, T.MapType, T.StructType))
        if isinstance(field.dataType, T.StringType) and nested:
            return F.to_json(source).alias(field.name)
        if isinstance(field.dataType, T.StructType) and own.dataType != field.dataType:
            return F.from_json(F.to_json(source), field.dataType).alias(field.name)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])


def union_evolved(frames: Sequence[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """All batches under one schema: ``schema``, or the least one that holds them all."""
    schemas = [df.schema for df in frames]
    target = schema or merged_schema(schemas)
    return reduce(DataFrame.unionByName, [fitted(df, target) for df in frames])


def read_evolved(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | None = None, batch: str | None = None) -> DataFrame:
    """Parquet batches whose column types differ, each read with its own schema; ``batch`` names a column for the batch's name."""
    frames = {name: spark.read.parquet(path) for name, path in paths.items()}
    target = schema or merged_schema([df.schema for df in frames.values()])
    out = [fitted(df, target) for df in frames.values()]
    return reduce(DataFrame.unionByName, [df.withColumn(batch, F.lit(name)) for name, df in zip(frames, out)] if batch else out)


def widenings(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(column, batch, data_type, resolved_type, change, exact) where a batch differs from the union's schema.

    ``change`` is ``widened`` or ``absent``; ``exact`` is false where values may lose digits. Compares
    schemas only; no data is read.
    """
    target = merged_schema([df.schema for df in frames.values()])
    rows = []
    for field in target:
        for name, df in frames.items():
            own = next((f.dataType for f in df.schema if f.name.lower() == field.name.lower()), None)
            if own != field.dataType:
                rows.append((field.name, name, own and own.simpleString(), field.dataType.simpleString(),
                             "widened" if own is not None else "absent", own is None or is_exact(own, field.dataType)))
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "column string, batch string, data_type string, resolved_type string, change string, exact boolean")
