"""The one join of a query: inner or left, on one pair of columns of equal type. NULL keys meet nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import AmbiguousColumn, DialectError, TypeMismatch, UnknownColumn
from ..plans import ast
from ..plans.schema import Field, resolve


def _side(name: str, left: list[Field], right: list[Field]) -> tuple[int, int]:
    """(side, place) of a join operand."""
    found = []
    for side, fields in enumerate((left, right)):
        try:
            found.append((side, resolve(fields, name)))
        except UnknownColumn:
            pass
    if not found:
        raise UnknownColumn(f"Unknown column '{name}' in JOIN")
    if len(found) > 1:
        raise AmbiguousColumn(f"Column '{name}' is ambiguous in JOIN")
    return found[0]


def join(clause: ast.Join, left: DataFrame, left_fields: list[Field], right: DataFrame, right_fields: list[Field]) -> DataFrame:
    """Rows of both sides; the frames' columns are told apart by their names already."""
    a, b = _side(clause.left, left_fields, right_fields), _side(clause.right, left_fields, right_fields)
    if a[0] == b[0]:
        raise DialectError("JOIN compares a column of each table")
    if a[0] == 1:
        a, b = b, a
    if left_fields[a[1]].dtype != right_fields[b[1]].dtype:
        raise TypeMismatch(f"JOIN compares {left_fields[a[1]].dtype} with {right_fields[b[1]].dtype}")
    return left.join(right, left[left.columns[a[1]]] == right[right.columns[b[1]]], clause.kind)
