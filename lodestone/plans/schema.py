"""Schemas of tables and of query results, and how names are found in them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..errors import AmbiguousColumn, UnknownColumn
from ..functions.types import DType, parse_type


@dataclass(frozen=True)
class Field:
    name: str  # as a header shows it
    dtype: DType


@dataclass(frozen=True)
class Column:
    name: str
    dtype: DType
    not_null: bool = False
    default: str | None = None  # a literal's text
    has_default: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def fields(self) -> list[Field]:
        return [Field(c.name, c.dtype) for c in self.columns]

    def column(self, name: str, table: str = "") -> Column:
        for c in self.columns:
            if c.name == name or name == f"{table}.{c.name}":
                return c
        raise UnknownColumn(f"Unknown column '{name}' in table '{table}'")

    def with_column(self, column: Column) -> Schema:
        return replace(self, columns=tuple(column if c.name == column.name else c for c in self.columns))

    @property
    def keys(self) -> list[tuple[str, ...]]:
        """Column lists that may not repeat."""
        return [*([self.primary_key] if self.primary_key else []), *self.uniques]

    def to_json(self) -> dict:
        return {
            "columns": [{"name": c.name, "type": str(c.dtype), "not_null": c.not_null, "default": c.default, "has_default": c.has_default} for c in self.columns],
            "primary_key": list(self.primary_key),
            "uniques": [list(x) for x in self.uniques],
            "indexes": [list(x) for x in self.indexes],
            "foreign_keys": [{"columns": list(f.columns), "parent": f.parent, "keys": list(f.keys), "on_delete": f.on_delete, "on_update": f.on_update} for f in self.foreign_keys],
        }

    @staticmethod
    def from_json(x: dict) -> Schema:
        return Schema(
            tuple(Column(c["name"], parse_type(c["type"]), c["not_null"], c["default"], c["has_default"]) for c in x["columns"]),
            tuple(x["primary_key"]),
            tuple(map(tuple, x["uniques"])),
            tuple(map(tuple, x["indexes"])),
            tuple(ForeignKey(tuple(f["columns"]), f["parent"], tuple(f["keys"]), f["on_delete"], f["on_update"]) for f in x["foreign_keys"]),
        )


def resolve(fields: list[Field], name: str) -> int:
    """Place of a name: the exact one, else the only one that ends in `.name`. Case counts."""
    exact = [i for i, f in enumerate(fields) if f.name == name]
    if exact:
        return exact[0]
    found = [i for i, f in enumerate(fields) if f.name.endswith("." + name)]
    if len(found) > 1:
        raise AmbiguousColumn(f"Column '{name}' is ambiguous: {', '.join(fields[i].name for i in found)}")
    if not found:
        raise UnknownColumn(f"Unknown column '{name}'")
    return found[0]
