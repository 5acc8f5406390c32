"""Results of SHOW, DESCRIBE, EXISTS and the system tables."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from ..catalog import Catalog, Entry
from ..limits import QueryLimits, TableLimits
from ..types import DataType, Field

INT, STR, BOOL = DataType.INT64, DataType.STRING, DataType.BOOL
#: The names of all functions, without regard to case.
FUNCTIONS = "ABS AVG CAST CEIL COUNT countIf currentDatabase empty FLOOR ifNull isNotNull isNull LENGTH lengthUTF8 LOWER MAX MIN ROUND ROW_NUMBER SUM toString UPPER version".split()
PREFIX = "stratalith"


def ddl(e: Entry) -> str:
    """Statements that make the table again; nullable columns that CREATE may not have come by ALTER."""
    kept = list(e.fields)
    late = []
    while kept and (sum(f.nullable for f in kept) > 2 or any(f.nullable for f in kept[: len(kept) - sum(f.nullable for f in kept)])):
        late.insert(0, kept.pop())
    out = f"CREATE TABLE {e.name} ({', '.join(f'{f.name} {f.declared}' for f in kept)}) ENGINE = Memory"
    return ";\n".join([out, *(f"ALTER TABLE {e.name} ADD COLUMN {f.name} {f.declared}" for f in late)])


def value_bytes(e: Entry) -> int:
    """8 bytes an Int64 or Float64, 9 a nullable Int64, 1 a Bool, and the bytes of a String."""
    n = e.count()
    out = sum({INT: 9 if f.nullable else 8, DataType.FLOAT64: 8, BOOL: 1}.get(f.type, 0) for f in e.fields) * n
    texts = [f for f in e.fields if f.type is STR]
    if texts and n:
        out += e.df.agg(sum((F.coalesce(F.sum(F.octet_length(f"`{f.name}`").cast("bigint")), F.lit(0)) for f in texts), F.lit(0))).first()[0]
    return out


def rows(what: str, table: str | None, catalog: Catalog, limits: QueryLimits, tables: TableLimits, workers: int = 16) -> tuple[list[Field], list[tuple]]:
    all_tables = catalog.all()
    if what == "databases":
        return [Field("name", STR)], [("default",)]
    if what == "settings":
        out = [(f"query_result_limits.{f.name}", getattr(limits, f.name)) for f in fields(limits)]
        out += [(f"table_limits.{f.name}", getattr(tables, f.name)) for f in fields(tables)] + [("global_aggregate_worker_cap", workers)]
        return [Field("name", STR), Field("value", STR)], [(k, "unlimited" if v is None else str(v)) for k, v in out]
    if what == "functions":
        return [Field("name", STR)], [(f,) for f in FUNCTIONS]
    if what == "tables":
        return [Field("name", STR)], [(e.name,) for e in all_tables]
    if what == "create":
        return [Field("statement", STR)], [(ddl(catalog.get(table)),)]
    if what == "describe":
        return [Field("name", STR), Field("type", STR)], [(f.name, f.declared) for f in catalog.get(table).fields]
    if what == "exists":
        return [Field("result", BOOL)], [(any(e is not None for e in [catalog.entries.get(table.lower())]),)]
    if what == "system.tables":
        return [Field(n, k) for n, k in (("database", STR), ("name", STR), ("engine", STR), ("total_rows", INT))], [("default", e.name, e.engine, e.count()) for e in all_tables]
    if what == "system.columns":
        names = [Field(n, STR) for n in ("database", "table", "name", "type")] + [Field("position", INT)]
        return names, [("default", e.name, f.name, f.declared, i + 1) for e in all_tables for i, f in enumerate(e.fields)]
    metrics = {"tables": len(all_tables), "columns": sum(len(e.fields) for e in all_tables), "retained_rows": sum(e.count() for e in all_tables), "retained_value_bytes": sum(map(value_bytes, all_tables))}
    return [Field("metric", STR), Field("value", INT)], [(f"{PREFIX}_{k}", v) for k, v in metrics.items()]
