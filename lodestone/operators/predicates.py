"""Predicates as boolean columns: equality takes NULL as a value, ranges and globs on NULL are NULL or, strictly, errors.

The dialect has no NOT, so a NULL condition drops a row just as false does; nothing is wrapped, and Parquet can filter by it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..functions.types import GLOBBED, RANGED, DType, parse_literal
from ..plans import ast
from ..plans.schema import Field, resolve


def literal(value, dtype: DType) -> Column:
    return F.lit(value).cast(dtype.spark)


def glob(col: Column, pattern: str) -> Column:
    """`*` is any run, `?` any one character; the forms that Parquet can filter by stay simple."""
    body = pattern.strip("*")
    if "?" not in pattern and "*" not in body:
        if pattern == body:
            return col == F.lit(body)
        if not body:
            return col.isNotNull()
        if pattern == body + "*":
            return col.startswith(body)
        if pattern == "*" + body:
            return col.endswith(body)
        if pattern[0] == pattern[-1] == "*":
            return col.contains(body)
    parts = {"*": ".*", "?": "."}
    found = col.rlike(r"(?s)\A" + "".join(parts.get(c) or (f"\\{c}" if re.match(r"[^\w\s]", c) and c.isascii() else c) for c in pattern) + r"\z")
    start = re.match(r"[^*?]*", pattern)[0]
    return col.startswith(start) & found if start else found


class Predicates:
    """Compiles a condition over `fields`, whose columns are `cols`. `nullable` collects the columns where a strict query may not meet NULL."""

    def __init__(self, fields: list[Field], cols: list[Column], strict: bool = False):
        self.fields, self.cols, self.strict = fields, cols, strict
        self.nullable: list[Column] = []

    def compile(self, where: ast.Where) -> Column:
        if isinstance(where, ast.Logic):
            left, right = self.compile(where.left), self.compile(where.right)
            return left & right if where.op == "and" else left | right
        at = resolve(self.fields, where.column)
        col, dtype = self.cols[at], self.fields[at].dtype
        match where.op:
            case "null":
                return col.isNull()
            case "notnull":
                return col.isNotNull()
            case "in":
                values = [parse_literal(t.text, dtype) for t in where.values]
                known = [literal(v, dtype) for v in values if v is not None]
                out = col.isin(known) if known else F.lit(False)
                return out | col.isNull() if None in values else out
            case "=" | "!=":
                value = parse_literal(where.values[0].text, dtype)
                same = col.isNull() if value is None else col.eqNullSafe(literal(value, dtype))
                return same if where.op == "=" else ~same
            case "like":
                if dtype.name not in GLOBBED:
                    raise TypeMismatch(f"LIKE takes text, and '{where.column}' is {dtype}")
                self.nullable.append(col)
                return glob(col, where.values[0].text)
        if dtype.name not in RANGED:
            raise TypeMismatch(f"{where.op} does not take '{where.column}' of type {dtype}")
        value = parse_literal(where.values[0].text, dtype)
        self.nullable.append(col)
        if value is None:
            if self.strict:
                raise TypeMismatch(f"{where.op} does not take NULL")
            return F.lit(False)
        other = literal(value, dtype)
        return {">": col > other, "<": col < other, ">=": col >= other, "<=": col <= other}[where.op]

    def met_null(self) -> Column | None:
        """True for rows that a strict query rejects."""
        return reduce(lambda a, b: a | b, [c.isNull() for c in self.nullable]) if self.strict and self.nullable else None


def implied(where: ast.Where, fields: list[Field]) -> list[tuple[int, str, list]]:
    """(place, operator, values) of the comparisons with known values that every row of the result meets."""
    if isinstance(where, ast.Logic):
        return implied(where.left, fields) + implied(where.right, fields) if where.op == "and" else []
    if where.op not in ("=", "in", ">", "<", ">=", "<="):
        return []
    at = resolve(fields, where.column)
    values = [parse_literal(t.text, fields[at].dtype) for t in where.values]
    return [] if None in values else [(at, where.op, values)]


def equality(where: ast.Where | None) -> str | None:
    """The column of a condition that is one equality."""
    return where.column if isinstance(where, ast.Predicate) and where.op == "=" else None
