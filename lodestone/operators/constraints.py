"""Constraint checks as small Spark jobs that stop at the first offending row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ForeignKeyViolation, NotNullViolation, UniqueViolation
from ..plans.schema import ForeignKey, Schema
from .predicates import literal
from .select import RID


def places(schema: Schema, names: tuple[str, ...]) -> list[str]:
    order = [c.name for c in schema.columns]
    return [f"c{order.index(n)}" for n in names]


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def all_known(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def unique(df: DataFrame, table: str, schema: Schema, keys: list[tuple[str, ...]]) -> None:
    """No two rows agree on a key; rows with a NULL in it don't count."""
    for key in keys:
        cols = places(schema, key)
        if some(df.where(all_known(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")):
            raise UniqueViolation(f"Duplicate value of {', '.join(key)} in table '{table}'")


def unique_against(df: DataFrame, new: DataFrame, table: str, schema: Schema, keys: list[tuple[str, ...]]) -> None:
    """No row of `df` agrees on a key with a row of `new` that has another id."""
    for key in keys:
        cols = places(schema, key)
        theirs = new.where(all_known(cols)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.col(RID).alias("id"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"k{i}") for i, c in enumerate(cols)])
        if some(df.select(*cols, RID).join(theirs, same & (F.col(RID) != F.col("id")), "left_semi")):
            raise UniqueViolation(f"Duplicate value of {', '.join(key)} in table '{table}'")


def unique_row(df: DataFrame, table: str, schema: Schema, values: list) -> None:
    """No row of `df` agrees with one new row on a key. The lookups are equalities, which Parquet's statistics narrow."""
    for key in schema.keys:
        at = [int(c[1:]) for c in places(schema, key)]
        if any(values[i] is None for i in at):
            continue
        same = reduce(lambda a, b: a & b, [F.col(f"c{i}") == literal(values[i], schema.columns[i].dtype) for i in at])
        if some(df.where(same)):
            raise UniqueViolation(f"Duplicate value of {', '.join(key)} in table '{table}'")


def not_null(df: DataFrame, table: str, schema: Schema, columns: list[str]) -> None:
    for name in columns:
        if some(df.where(F.col(places(schema, (name,))[0]).isNull())):
            raise NotNullViolation(f"Column '{name}' of table '{table}' may not be NULL")


def referenced(child: DataFrame, child_schema: Schema, fk: ForeignKey, parents: DataFrame, parent_schema: Schema, how: str) -> DataFrame:
    """Rows of `child` with (left_semi) or without (left_anti) a row of `parents`; a NULL in the key references nothing and is let pass."""
    mine, theirs = places(child_schema, fk.columns), places(parent_schema, fk.keys)
    keys = parents.select(*[F.col(t).alias(f"k{i}") for i, t in enumerate(theirs)])
    rows = child.where(all_known(mine))
    return rows.join(keys, reduce(lambda a, b: a & b, [rows[m] == keys[f"k{i}"] for i, m in enumerate(mine)]), how)


def outgoing_row(values: list, name: str, schema: Schema, fk: ForeignKey, parents: DataFrame, parent_schema: Schema) -> None:
    """`outgoing` of one new row, by a lookup of its key. A row may reference itself."""
    mine = [values[int(c[1:])] for c in places(schema, fk.columns)]
    theirs = places(parent_schema, fk.keys)
    if any(v is None for v in mine) or fk.parent == name and mine == [values[int(c[1:])] for c in theirs]:
        return
    same = reduce(lambda a, b: a & b, [F.col(c) == literal(v, parent_schema.columns[int(c[1:])].dtype) for c, v in zip(theirs, mine)])
    if not some(parents.where(same)):
        raise ForeignKeyViolation(f"Table '{name}' references a missing row of '{fk.parent}' by {', '.join(fk.columns)}")


def outgoing(child: DataFrame, name: str, child_schema: Schema, fk: ForeignKey, parents: DataFrame, parent_schema: Schema) -> None:
    if some(referenced(child, child_schema, fk, parents, parent_schema, "left_anti")):
        raise ForeignKeyViolation(f"Table '{name}' references a missing row of '{fk.parent}' by {', '.join(fk.columns)}")
