"""Statements as frozen values."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.types import DType
from .lexer import Token


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str  # = != > < >= <= like in null notnull
    values: tuple[Token, ...] = ()


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    left: Predicate | Logic
    right: Predicate | Logic


Where = Predicate | Logic


@dataclass(frozen=True)
class Aggregate:
    fn: str  # lower case
    arg: str  # column or *
    distinct: bool
    header: str


@dataclass(frozen=True)
class Item:
    expr: str | Aggregate
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or (self.expr if isinstance(self.expr, str) else self.expr.header)


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left
    table: str
    left: str
    right: str


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[Item, ...]  # none: *
    distinct: bool = False
    join: Join | None = None
    where: Where | None = None
    group_by: tuple[str, ...] = ()
    having: Where | None = None
    order_by: tuple[tuple[str, bool], ...] = ()  # (name, descending)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    dtype: DType
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    default: Token | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    primary_keys: tuple[tuple[str, ...], ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


@dataclass(frozen=True)
class Index:
    action: str  # create, drop
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # add unique, drop unique, add foreign key, drop foreign key, set not null, drop not null
    columns: tuple[str, ...] = ()
    foreign_key: ForeignKey | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Token, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Token], ...]
    where: Where


@dataclass(frozen=True)
class Delete:
    table: str
    where: Where


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback


Statement = Select | CreateTable | Index | Alter | Insert | Update | Delete | Describe | Transaction
