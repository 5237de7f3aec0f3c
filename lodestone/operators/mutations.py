"""INSERT, UPDATE and DELETE on a copy of a store's state, with all constraints and referential actions.

A statement either returns a new state or raises, and the old state is as it was. Cascades are a loop over
(table, rows) on the driver; the rows stay in Spark, each level is written before the next.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DialectError, ForeignKeyViolation, NotNullViolation, TypeMismatch
from ..functions.types import parse_literal
from ..plans import ast
from ..plans.schema import Field, ForeignKey, Schema
from ..sources.store import SEGMENT, State, Store, Table, spark_schema
from . import constraints as check
from .predicates import Predicates, literal
from .select import RID


class Mutations:
    def __init__(self, store: Store, state: State, strict: bool = True):
        self.store, self.state, self.strict = store, state.copy(), strict
        self.work = f"work/{uuid.uuid4().hex}"

    def close(self) -> None:
        """Removes what the statement held on the way."""
        self.store.files.delete(self.work)

    # -- statements

    def insert(self, statement: ast.Insert) -> int:
        table = self.state.table(statement.table)
        schema, values = table.schema, []
        if len(statement.values) > len(schema.columns):
            raise DialectError(f"Table '{statement.table}' has {len(schema.columns)} columns, not {len(statement.values)}")
        for i, column in enumerate(schema.columns):
            if i < len(statement.values):
                text = statement.values[i].text
            elif column.has_default:
                text = column.default
            else:
                raise DialectError(f"Column '{column.name}' has no value and no default")
            if text.lower() == "null" and column.not_null:
                raise NotNullViolation(f"Column '{column.name}' of table '{statement.table}' may not be NULL")
            values.append(parse_literal(text, column.dtype))
        check.unique_row(self.store.read(table), statement.table, schema, values)
        for fk in schema.foreign_keys:
            parent = self.state.table(fk.parent)
            check.outgoing_row(values, statement.table, schema, fk, self.store.read(parent), parent.schema)
        row = self.store.spark.createDataFrame([(*values, table.next_rid)], spark_schema(schema))
        self.state.tables[statement.table] = self.store.appended(table, row, table.next_rid + 1, few=True)
        return 1

    def insert_many(self, name: str, df: DataFrame) -> int:
        """All rows of `df`, by position (an extension). Row ids follow partition order; the checks are set operations."""
        table = self.state.table(name)
        schema = table.schema
        if len(df.columns) != len(schema.columns):
            raise DialectError(f"Table '{name}' has {len(schema.columns)} columns, not {len(df.columns)}")
        typed = df.toDF(*[f"i{k}" for k in range(len(df.columns))]).select(*[F.col(f"i{k}").cast(c.dtype.spark).alias(f"c{k}") for k, c in enumerate(schema.columns)])
        for k, c in enumerate(schema.columns):
            if c.dtype.name == "varchar" and check.some(typed.where(F.length(f"c{k}") > c.dtype.p)):
                raise TypeMismatch(f"A value of '{c.name}' is longer than {c.dtype}")
        # the ids leave gaps between partitions, as an id never comes again in any case
        staged = self.store.appended(table, typed.withColumn(RID, F.monotonically_increasing_id() + table.next_rid), table.next_rid)
        rows = self.store.read(staged, staged.segments[-1:])
        top = rows.agg(F.max(RID).alias("top"), F.count(F.lit(1)).alias("n")).first()
        check.not_null(rows, name, schema, [c.name for c in schema.columns if c.not_null])
        check.unique(rows, name, schema, schema.keys)
        check.unique_against(self.store.read(table), rows, name, schema, schema.keys)
        self.state.tables[name] = Table(staged.schema, staged.segments, (top["top"] or table.next_rid - 1) + 1, staged.version)
        self._outgoing(rows, name, schema, schema.foreign_keys)
        return top["n"]

    def update(self, statement: ast.Update) -> int:
        name, table = statement.table, self.state.table(statement.table)
        schema, new = table.schema, {}
        for column_name, token in statement.assignments:
            column = schema.column(column_name, name)
            value = parse_literal(token.text, column.dtype)
            if value is None and column.not_null:
                raise NotNullViolation(f"Column '{column.name}' of table '{name}' may not be NULL")
            new[column.name] = literal(value, column.dtype)
        targets = self._targets(name, statement.where)
        return self._apply_update(name, targets.select("*", *[(new[c.name] if c.name in new else F.col(f"c{i}")).alias(f"n{i}") for i, c in enumerate(schema.columns)]), tuple(new))

    def delete(self, statement: ast.Delete) -> int:
        return self._apply_delete(statement.table, self._targets(statement.table, statement.where))

    # -- rows

    def _targets(self, name: str, where: ast.Where) -> DataFrame:
        table = self.state.table(name)
        df = self.store.read_tagged(table)
        fields = [Field(c.name, c.dtype) for c in table.schema.columns]
        qualified = [Field(f"{name}.{f.name}", f.dtype) for f in fields]
        cols = [F.col(f"c{i}") for i in range(len(fields))]
        p = Predicates([*fields, *qualified], [*cols, *cols], self.strict)
        condition = p.compile(where)
        if (bad := p.met_null()) is not None and check.some(df.where(bad)):
            raise TypeMismatch("A range or LIKE condition met NULL")
        return df.where(condition)

    def _write(self, name: str, touched: list[str], ids: DataFrame, new: DataFrame | None) -> None:
        """Replaces the touched files: their rows without `ids`, and `new`."""
        table = self.state.table(name)
        rows = self.store.read(table, tuple(touched)).join(ids.select(F.col(RID).alias("gone")), F.col(RID) == F.col("gone"), "left_anti")
        self.state.tables[name] = self.store.replaced(table, touched, rows.unionByName(new) if new is not None else rows)

    def _held(self, df: DataFrame) -> tuple[DataFrame, list[str], int]:
        """`df` written once (so that later steps don't read what they replace), the files of its rows and its size."""
        path = f"{self.work}/{uuid.uuid4().hex}"
        df.write.parquet(self.store.files.full(path))
        held = self.store.spark.read.schema(df.schema).parquet(self.store.files.full(path))
        sizes = held.groupBy(SEGMENT).count().collect()  # a row for each file that is to be replaced
        return held, [r[SEGMENT] for r in sizes], sum(r["count"] for r in sizes)

    def _outgoing(self, rows: DataFrame, name: str, schema: Schema, keys: tuple[ForeignKey, ...] | list[ForeignKey]) -> None:
        for fk in keys:
            parent = self.state.table(fk.parent)
            parents = self.store.read(parent)
            if fk.parent == name:  # a row may reference itself or another new one
                parents = parents.unionByName(rows.select(*parents.columns))
            check.outgoing(rows, name, schema, fk, parents, parent.schema)

    def _apply_delete(self, name: str, targets: DataFrame) -> int:
        held, touched, n = self._held(targets)
        if not n:
            return 0
        schema = self.state.table(name).schema
        incoming = self.state.incoming(name)
        for child, fk in incoming:
            if fk.on_delete == "restrict":
                kept = self.store.read(self.state.table(child))
                if child == name:
                    kept = kept.join(held.select(F.col(RID).alias("gone")), F.col(RID) == F.col("gone"), "left_anti")
                if check.some(check.referenced(kept, self.state.table(child).schema, fk, held, schema, "left_semi")):
                    raise ForeignKeyViolation(f"Rows of '{name}' are referenced by '{child}'")
        self._write(name, touched, held, None)
        for action in ("set null", "cascade"):
            for child, fk in incoming:
                if fk.on_delete != action:
                    continue
                child_schema = self.state.table(child).schema
                rows = check.referenced(self.store.read_tagged(self.state.table(child)), child_schema, fk, held, schema, "left_semi")
                if action == "cascade":
                    self._apply_delete(child, rows)
                else:
                    mine = check.places(child_schema, fk.columns)
                    after = [(F.lit(None).cast(c.dtype.spark) if f"c{i}" in mine else F.col(f"c{i}")).alias(f"n{i}") for i, c in enumerate(child_schema.columns)]
                    self._apply_update(child, rows.select("*", *after), fk.columns)
        return n

    def _apply_update(self, name: str, targets: DataFrame, assigned: tuple[str, ...]) -> int:
        held, touched, n = self._held(targets)
        if not n:
            return 0
        table = self.state.table(name)
        schema = table.schema
        after = held.select(*[F.col(f"n{i}").alias(f"c{i}") for i in range(len(schema.columns))], RID)
        self._write(name, touched, held, after)
        keys = [k for k in schema.keys if set(k) & set(assigned)]
        check.unique(after, name, schema, keys)
        check.unique_against(self.store.read(self.state.table(name)), after, name, schema, keys)
        self._outgoing(after, name, schema, [fk for fk in schema.foreign_keys if set(fk.columns) & set(assigned)])
        for action in ("restrict", "set null", "cascade"):
            for child, fk in self.state.incoming(name):
                if fk.on_update != action or not set(fk.keys) & set(assigned):
                    continue
                theirs = check.places(schema, fk.keys)
                moved = held.where(reduce(lambda a, b: a | b, [~F.col(t).eqNullSafe(F.col(f"n{t[1:]}")) for t in theirs]))
                child_schema = self.state.table(child).schema
                mine = check.places(child_schema, fk.columns)
                rows = self.store.read_tagged(self.state.table(child))
                if action == "restrict":
                    if check.some(check.referenced(rows, child_schema, fk, moved, schema, "left_semi")):
                        raise ForeignKeyViolation(f"Changed keys of '{name}' are referenced by '{child}'")
                    continue
                pairs = moved.select(*[F.col(t).alias(f"k{i}") for i, t in enumerate(theirs)], *[F.col(f"n{t[1:]}").alias(f"v{i}") for i, t in enumerate(theirs)])
                met = rows.join(pairs, reduce(lambda a, b: a & b, [F.col(m) == F.col(f"k{i}") for i, m in enumerate(mine)]))
                new = []
                for i, c in enumerate(child_schema.columns):
                    k = mine.index(f"c{i}") if f"c{i}" in mine else None
                    new.append((F.col(f"c{i}") if k is None else F.lit(None).cast(c.dtype.spark) if action == "set null" else F.col(f"v{k}")).alias(f"n{i}"))
                self._apply_update(child, met.select(*rows.columns, *new), fk.columns)
        return n

    def check_no_action(self, base: State) -> None:
        """Every NO ACTION key holds that held at `base`; for the end of a statement or transaction. Only new rows of children
        and keys that parents have lost can break one."""
        for name, table in sorted(self.state.tables.items()):
            for fk in table.schema.foreign_keys:
                if "no action" not in (fk.on_delete, fk.on_update):
                    continue
                parent, before = self.state.table(fk.parent), base.tables.get(fk.parent)
                if new := self.store.beyond(table, base.tables.get(name)):
                    check.outgoing(self.store.read(table, new), name, table.schema, fk, self.store.read(parent), parent.schema)
                if before is None or not (gone := self.store.beyond(before, parent)):
                    continue
                theirs = check.places(parent.schema, fk.keys)
                back = self.store.read(parent, self.store.beyond(parent, before)).select(*[F.col(t).alias(f"b{t}") for t in theirs])
                lost = self.store.read(before, gone).join(back, reduce(lambda a, b: a & b, [F.col(t) == F.col(f"b{t}") for t in theirs]), "left_anti")
                if check.some(check.referenced(self.store.read(table), table.schema, fk, lost, parent.schema, "left_semi")):
                    raise ForeignKeyViolation(f"Rows of '{name}' reference rows that '{fk.parent}' has lost")
