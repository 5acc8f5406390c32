"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..types import DataType, Field


@dataclass(frozen=True)
class Null:
    type: DataType | None = None


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any
    text: str = ""


@dataclass(frozen=True)
class Compare:
    op: str
    left: Col | Lit | Null
    right: Col | Lit | Null


@dataclass(frozen=True)
class In:
    column: str
    values: tuple[Any, ...]
    negated: bool


@dataclass(frozen=True)
class Between:
    column: str
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    """kind: prefix, suffix, contains, exact or all."""

    column: str
    kind: str
    text: str
    negated: bool


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    left: Any
    right: Any


@dataclass(frozen=True)
class Item:
    """A projection. kind: star, column, scalar, aggregate, row_number. name: its default result name."""

    kind: str
    name: str = ""
    function: str = ""
    column: str | None = None
    argument: Any = None  # the type of a cast, the number of ifNull and of a subtraction, the direction of ROW_NUMBER
    alias: str | None = None

    @property
    def output(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Having:
    alias: str
    op: str  # a comparison, null, notnull
    value: int | float | None = None


@dataclass(frozen=True)
class OrderKey:
    name: str  # an output column, alias or canonical spelling
    descending: bool = False
    nulls: str | None = None  # "first" or "last" where the query says so


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[Item, ...]
    distinct: bool = False
    where: Any = None
    group_by: tuple[str, ...] | None = None
    group_casts: tuple[str, ...] = ()
    having: Having | None = None
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Union:
    left: Select
    right: Select
    distinct: bool


@dataclass(frozen=True)
class CrossJoin:
    left: str
    right: str
    limit: int | None = None


@dataclass(frozen=True)
class EquiJoin:
    """INNER projects the left column, LEFT the right one."""

    kind: str
    projected: str
    left: str
    right: str
    left_key: str
    right_key: str


@dataclass(frozen=True)
class Constant:
    name: str
    type: DataType
    value: Any


@dataclass(frozen=True)
class Meta:
    """what: databases, settings, functions, tables, create, describe, exists, system.tables, system.columns, system.metrics."""

    what: str
    table: str | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[Field, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class RenameTable:
    table: str
    to: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    field: Field
    if_not_exists: bool = False


@dataclass(frozen=True)
class RenameColumn:
    table: str
    column: str
    to: str


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Any
    where_column: str
    where_value: Any


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Any, ...], ...] = field(repr=False)


QUERIES = (Select, Union, CrossJoin, EquiJoin, Constant, Meta)
