"""SELECT as one lazy DataFrame: join, where, group, having, distinct, order, offset, limit, projection.

Inside, columns have positional names, so dotted and repeated headers need no care; the headers come last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DialectError, TypeMismatch, UnknownColumn
from ..plans import ast
from ..plans.schema import Field, resolve
from . import aggregates
from .join import join
from .predicates import Predicates, implied

#: Insertion order of stored tables.
RID = "__rid"


@dataclass
class Source:
    """A table as a query reads it. Columns of `df` are the fields in order, then RID if `ordered`."""

    df: DataFrame
    fields: list[Field]
    ordered: bool = False
    strict: bool = False
    #: `df` without rows that fail tests (place, operator, values), by what the files themselves hold.
    narrowed: Callable[[list[tuple[int, str, list]]], DataFrame] | None = None


@dataclass
class Compiled:
    df: DataFrame  # columns are positional; sorted only where the statement sorts or slices
    shown: DataFrame  # `df` in the order in which rows are shown
    fields: list[Field]
    base: DataFrame  # what was read, before the condition
    met_null: DataFrame | None = None  # a strict query fails if this has a row


def _order(cols: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in cols]


def _sliced(df: DataFrame, select: ast.Select) -> DataFrame:
    if select.offset:
        df = df.offset(select.offset)
    return df if select.limit is None else df.limit(select.limit)


def _read(select: ast.Select, left: Source, right: Source | None) -> tuple[DataFrame, list[Field], list[str]]:
    """(rows, fields, the columns that keep insertion order)."""
    size = len(left.fields)
    lnames = [f"c{i}" for i in range(size)]
    df = left.df.toDF(*lnames, *(["r0"] if left.ordered else []))
    if right is None:
        return df, left.fields, ["r0"] if left.ordered else []
    rdf = right.df.toDF(*[f"c{size + i}" for i in range(len(right.fields))], *(["r1"] if right.ordered else []))
    lfields = [Field(f"{select.table}.{f.name}", f.dtype) for f in left.fields]
    rfields = [Field(f"{select.join.table}.{f.name}", f.dtype) for f in right.fields]
    rids = ["r0"] * left.ordered + ["r1"] * right.ordered
    joined = join(select.join, df, lfields, rdf, rfields)
    return joined, lfields + rfields, rids


def _narrowed(source: Source, tests: list[tuple[int, str, list]]) -> Source:
    return replace(source, df=source.narrowed(tests)) if tests and source.narrowed else source


def compile_select(select: ast.Select, table: Callable[[str], Source]) -> Compiled:
    left = table(select.table)
    if select.join is not None and select.join.table == select.table:
        raise DialectError("A table is not joined with itself")
    right = table(select.join.table) if select.join else None
    strict = left.strict or right is not None and right.strict
    base, fields, rids = _read(select, left, right)
    if select.join is None:  # a single table's columns may be named in full
        qualified = [Field(f"{select.table}.{f.name}", f.dtype) for f in fields]

        def find(name: str) -> int:
            try:
                return resolve(fields, name)
            except UnknownColumn:
                return resolve(qualified, name)
    else:

        def find(name: str) -> int:
            return resolve(fields, name)

    cols = [F.col(f"c{i}") for i in range(len(fields))]
    df, met = base, None
    if select.where is not None:
        names = fields if select.join else [*fields, *qualified]
        p = Predicates(names, cols if select.join else [*cols, *cols], strict)
        condition = p.compile(select.where)
        if (bad := p.met_null()) is not None:
            met = base.where(bad)
        size = len(left.fields)
        tests = [] if strict else implied(select.where, names)
        mine = [(at if right else at % size, op, values) for at, op, values in tests if right is None or at < size]
        theirs = [(at - size, op, values) for at, op, values in tests if right and at >= size and select.join.kind == "inner"]
        near, far = _narrowed(left, mine), _narrowed(right, theirs) if right else None
        df = (base if near is left and far is right else _read(select, near, far)[0]).where(condition)
    grouped = bool(select.group_by) or any(isinstance(x.expr, ast.Aggregate) for x in select.items)
    if grouped:
        out, shown, out_fields = _grouped(select, df, fields, find, rids)
    elif select.distinct:
        out, shown, out_fields = _distinct(select, df, fields, find, rids)
    else:
        out, shown, out_fields = _plain(select, df, fields, find, rids)
    return Compiled(out, shown, out_fields, base, met)


def _projection(select: ast.Select, fields: list[Field], find: Callable[[str], int]) -> list[tuple[int, Field]]:
    if not select.items:
        return list(enumerate(fields))
    return [(at := find(x.expr), Field(x.alias or fields[at].name, fields[at].dtype)) for x in select.items]


def _plain(select, df, fields, find, rids):
    chosen = _projection(select, fields, find)
    keys = []
    for name, down in select.order_by:
        try:
            at = find(name)
        except UnknownColumn:
            aliased = [i for i, f in chosen if f.name == name]
            if not aliased:
                raise
            at = aliased[0]
        keys.append((F.col(f"c{at}"), down))
    return *_arranged(df, select, keys, rids, [F.col(f"c{i}").alias(f"o{k}") for k, (i, _) in enumerate(chosen)]), [f for _, f in chosen]


def _arranged(df: DataFrame, select: ast.Select, keys: list[tuple[Column, bool]], ties: list[str], cols: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows, and the rows as shown: by `keys`, rows that tie in insertion order (`ties`). Without ORDER BY, LIMIT or
    OFFSET only the rows as shown are sorted."""
    order = [*_order(keys), *[F.col(r).asc_nulls_first() for r in ties]]
    ordered = df.orderBy(*order) if order else df
    if keys or select.limit is not None or select.offset:
        out = _sliced(ordered, select).select(*cols)
        return out, out
    return df.select(*cols), ordered.select(*cols)


def _ordered_output(df: DataFrame, select: ast.Select, out: list[Field], first: str | None) -> tuple[DataFrame, DataFrame, list[Field]]:
    keys = [(F.col(f"o{resolve(out, name)}"), down) for name, down in select.order_by]
    return *_arranged(df, select, keys, [first] if first else [], [F.col(f"o{i}") for i in range(len(out))]), out


def _distinct(select, df, fields, find, rids):
    chosen = _projection(select, fields, find)
    out = [f for _, f in chosen]
    df = df.select(*[F.col(f"c{i}").alias(f"o{k}") for k, (i, _) in enumerate(chosen)], *rids)
    return _ordered_output(*_first_seen(df, len(out), rids, select, out))


def _first_seen(df: DataFrame, n: int, rids: list[str], select: ast.Select, out: list[Field]):
    names = [f"o{i}" for i in range(n)]
    if rids:
        df = df.groupBy(*names).agg(F.min(F.struct(*rids)).alias("first"))
        return df, select, out, "first"
    return df.select(*names).distinct(), select, out, None


def _grouped(select, df, fields, find, rids):
    if not select.items:
        raise DialectError("SELECT * does not go with GROUP BY")
    keys = [find(name) for name in select.group_by]
    out: list[Field] = []
    cols: list[Column] = []
    aggs: list[Column] = []
    for k, item in enumerate(select.items):
        if isinstance(item.expr, ast.Aggregate):
            at = None if item.expr.arg == "*" else find(item.expr.arg)
            dtype = None if at is None else fields[at].dtype
            out.append(Field(item.header, aggregates.result_type(item.expr, dtype)))
            aggs.append(aggregates.aggregate(item.expr, None if at is None else F.col(f"c{at}"), dtype).alias(f"a{k}"))
            cols.append(F.col(f"a{k}").alias(f"o{k}"))
        else:
            at = find(item.expr)
            if at not in keys:
                raise DialectError(f"Column '{item.expr}' is neither grouped nor aggregated")
            out.append(Field(item.alias or fields[at].name, fields[at].dtype))
            cols.append(F.col(f"c{at}").alias(f"o{k}"))
    if any(f.dtype is None for f in out):
        raise TypeMismatch("* has no type")
    # group order is that of the first rows, where rows have an order
    first = [F.min(F.struct(*rids)).alias("first")] if rids and keys else []
    unique = list(dict.fromkeys(keys))
    if not aggs and not first:
        df = df.select(*[f"c{k}" for k in unique]).distinct()
    else:
        df = df.groupBy(*[f"c{k}" for k in unique]).agg(*aggs, *first)
    df = df.select(*cols, *(["first"] if first else []))
    if select.having is not None:
        df = df.where(Predicates(out, [F.col(f"o{i}") for i in range(len(out))]).compile(select.having))
    if select.distinct:
        return _ordered_output(*_first_seen(df, len(out), ["first"] if first else [], select, out))
    return _ordered_output(df, select, out, "first" if first else None)
