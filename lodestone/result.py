"""Results of statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .functions.types import shown, wire
from .plans.schema import Field


@dataclass
class Stats:
    rows_returned: int | None = None
    rows_affected: int | None = None
    rows_scanned: int | None = None
    index_used: bool | None = None


@dataclass
class Result:
    kind: str  # select, mutation, schema_change, transaction
    message: str = ""
    stats: Stats = field(default_factory=Stats)

    def text(self) -> str:
        return self.message

    def to_json(self) -> dict:
        return {"type": self.kind, "message": self.message, "stats": {k: v for k, v in vars(self.stats).items() if v is not None}}


@dataclass
class Rows(Result):
    """Rows that are computed when they are asked for; `df` has positional column names, `frame()` the headers. Rows of
    stored tables come in insertion order from `rows()`; `frame()` doesn't sort for that."""

    df: DataFrame | None = None
    shown_df: DataFrame | None = None  # in the order in which rows are shown
    fields: list[Field] = field(default_factory=list)
    check: object = None  # runs before the first rows come
    scanned: object = None  # counts what was read
    count_always: bool = False  # or only on request

    def frame(self) -> DataFrame:
        if self.check:
            self.check()
        return self.df.toDF(*[f.name for f in self.fields])

    @property
    def headers(self) -> list[str]:
        return [f.name for f in self.fields]

    def rows(self) -> list[tuple]:
        if self.check:
            self.check()
        out = [tuple(r) for r in self.shown_df.collect()]
        self.stats.rows_returned = len(out)
        if self.count_always:
            self.count_scanned()
        return out

    def count_scanned(self) -> int:
        if self.stats.rows_scanned is None:
            self.stats.rows_scanned = self.scanned() if self.scanned else 0
        return self.stats.rows_scanned

    def text(self) -> str:
        """Tab-separated header and rows; NULL is null."""
        lines = ["\t".join(self.headers)]
        lines += ["\t".join(shown(v, f.dtype) for v, f in zip(r, self.fields)) for r in self.rows()]
        return "\n".join(lines)

    def to_json(self) -> dict:
        rows = [[wire(v, f.dtype) for v, f in zip(r, self.fields)] for r in self.rows()]
        schema = [{"name": f.name, "type": str(f.dtype)} for f in self.fields]
        return {"type": "select", "schema": schema, "rows": rows, "stats": {k: v for k, v in vars(self.stats).items() if v is not None}}
