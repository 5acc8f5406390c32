"""Tables by name. Names are found whatever their ASCII case; the case they were declared in is shown."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ColumnNotFound, TableAlreadyExists, TableNotFound
from .types import DataType, Field

#: A hidden column with the order in which rows came.
ORDER = "__order"


def fold(name: str) -> str:
    return name.translate({c: c + 32 for c in range(65, 91)})


@dataclass(frozen=True)
class Entry:
    """A table. df has its columns, and ORDER if rows were inserted; tables read from files are numbered where it matters."""

    name: str
    fields: tuple[Field, ...]
    df: DataFrame
    rows: int | None = 0
    next_order: int = 0
    depth: int = 0
    engine: str = "Memory"
    stored: bool = False  # read back from files, which need not come in the order of the rows

    def field(self, column: str) -> Field:
        for f in self.fields:
            if fold(f.name) == fold(column):
                return f
        raise ColumnNotFound(self.name, column)

    def ordered(self) -> DataFrame:
        return self.df if ORDER in self.df.columns else self.df.withColumn(ORDER, F.monotonically_increasing_id())

    def count(self) -> int:
        return self.df.count() if self.rows is None else self.rows

    def having(self, df: DataFrame, rows: int | None, **more) -> Entry:
        return replace(self, df=df, rows=rows, depth=self.depth + 1, **more)


class Catalog:
    def __init__(self, entries: dict[str, Entry] | None = None):
        self.entries = dict(entries or {})

    def get(self, name: str) -> Entry:
        if fold(name) not in self.entries:
            raise TableNotFound(name)
        return self.entries[fold(name)]

    def add(self, entry: Entry) -> None:
        if fold(entry.name) in self.entries:
            raise TableAlreadyExists(entry.name)
        self.entries[fold(entry.name)] = entry

    def put(self, entry: Entry) -> None:
        self.entries[fold(entry.name)] = entry

    def drop(self, name: str) -> None:
        self.get(name)
        del self.entries[fold(name)]

    def rename(self, name: str, to: str) -> None:
        entry = self.get(name)
        if fold(to) != fold(name) and fold(to) in self.entries:
            raise TableAlreadyExists(to)
        del self.entries[fold(name)]
        self.put(replace(entry, name=to))

    def all(self) -> list[Entry]:
        return [self.entries[k] for k in sorted(self.entries)]


def entry_of(name: str, df: DataFrame) -> Entry:
    """A table over a frame: integers as Int64, floats as Float64; columns of other types are left out."""
    fields, columns = [], []
    for f in df.schema.fields:
        if (kind := DataType.of_spark(f.dataType)) is not None:
            fields.append(Field(f.name, kind, True))
            columns.append(F.col(f.name) if f.dataType == kind.spark else F.col(f.name).cast(kind.spark).alias(f.name))
    return Entry(name, tuple(fields), df.select(*columns), None, engine="Parquet")
