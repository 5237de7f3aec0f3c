"""The five aggregates with the dialect's result types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..functions.types import NUMERIC, DType
from ..plans import ast

BIGINT = DType("bigint")


def result_type(agg: ast.Aggregate, dtype: DType | None) -> DType:
    if agg.fn == "count":
        return BIGINT
    if agg.fn in ("min", "max"):
        return dtype
    if dtype.name not in NUMERIC:
        raise TypeMismatch(f"{agg.fn} does not take {dtype}")
    if agg.fn == "sum":
        return DType("decimal", 38, dtype.s) if dtype.name == "decimal" else dtype
    return DType("decimal", 38, max(dtype.s or 0, 6))


def aggregate(agg: ast.Aggregate, col: Column | None, dtype: DType | None) -> Column:
    """NULLs do not count; without any value, counts are 0 and the others NULL. Overflow is an error (ANSI mode)."""
    out = result_type(agg, dtype)
    match agg.fn:
        case "count":
            return F.count(F.lit(1)) if col is None else F.count_distinct(col) if agg.distinct else F.count(col)
        case "min":
            return F.min(col)
        case "max":
            return F.max(col)
        case "sum":
            return (F.sum_distinct(col) if agg.distinct else F.sum(col)).cast(out.spark)
    wide = col.cast("decimal(19,0)") if dtype.name == "int" else col
    total, n = (F.sum_distinct(wide), F.count_distinct(col)) if agg.distinct else (F.sum(wide), F.count(col))
    # a NULL divisor keeps ANSI mode from failing on no values
    return (total / F.nullif(n, F.lit(0))).cast(out.spark)
