"""Parquet files as read-only tables of the dialect (an extension: the dialect itself has only its own store)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch
from ..functions.types import DType, parse_type
from ..operators.select import Source
from ..plans.schema import Field

#: Doubles have no type in the dialect; they are read as this one, rounded half up.
DOUBLE_AS = DType("decimal", 15, 2)


def dialect_type(kind: T.DataType) -> DType | None:
    match kind:
        case T.BooleanType():
            return DType("bool")
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return DType("int")
        case T.DecimalType():
            return DType("decimal", kind.precision, kind.scale)
        case T.FloatType() | T.DoubleType():
            return DOUBLE_AS
        case T.StringType() | T.VarcharType() | T.CharType():
            return DType("text")
        case T.DateType():
            return DType("date")
        case T.TimestampType() | T.TimestampNTZType():
            return DType("timestamp")
        case T.BinaryType():
            return DType("blob")
    return None


def source(df: DataFrame, types: dict[str, str] | None = None, strict: bool = False) -> Source:
    """`df` as a table. Columns without a type in the dialect are left out; `types` overrides the mapping."""
    chosen = {k: parse_type(v) for k, v in (types or {}).items()}
    fields, cols, rounded = [], [], {}
    for f in df.schema.fields:
        dtype = chosen.get(f.name) or dialect_type(f.dataType)
        if dtype is None:
            continue
        fields.append(Field(f.name, dtype))
        col = F.col(f"`{f.name}`")
        cols.append(col if f.dataType == dtype.spark else col.cast(dtype.spark))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and dtype.name == "decimal" or isinstance(f.dataType, T.TimestampType) and dtype.name == "timestamp":
            rounded[len(fields) - 1] = col
    if missing := set(chosen) - {f.name for f in fields}:
        raise TypeMismatch(f"No such columns: {sorted(missing)}")

    def narrowed(tests: list[tuple[int, str, list]]) -> DataFrame:
        kept = df
        for at, op, values in tests:
            if at in rounded:
                kept = kept.where(_wider(rounded[at], fields[at].dtype, op, values))
        return kept.select(*cols)

    return Source(df.select(*cols), fields, strict=strict, narrowed=narrowed if rounded and not strict else None)


def _wider(col: Column, dtype: DType, op: str, values: list) -> Column:
    """A condition on a column as it is stored, which holds wherever `op` holds after its conversion: Parquet can filter
    by this one, not by the converted column. Conversion moves a number by half a step, a time by its zone's offset."""
    if dtype.name == "decimal":
        low, high = float(min(values)) - 10.0**-dtype.s, float(max(values)) + 10.0**-dtype.s
    else:
        day = dt.timedelta(days=1)
        low, high = (F.lit(str(v)).cast("timestamp") for v in (min(values) - day, max(values) + day))
    above, below = col >= low, col <= high
    return above if op in (">", ">=") else below if op in ("<", "<=") else above & below


def read(spark: SparkSession, path: str, types: dict[str, str] | None = None, strict: bool = False) -> Source:
    return source(spark.read.parquet(path), types, strict)
