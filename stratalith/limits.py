"""Limits of queries, tables and scripts. All are inclusive."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MIB = 1 << 20


@dataclass(frozen=True)
class QueryLimits:
    max_scan_rows: int | None = 1_000_000
    max_rows: int | None = 10_000
    max_values: int | None = 250_000
    max_bytes: int | None = 16 * MIB
    max_ordering_state_bytes: int | None = 16 * MIB
    max_groups: int | None = 100_000
    max_group_key_cells: int | None = 500_000
    max_group_key_bytes: int | None = 32 * MIB
    max_aggregate_state_cells: int | None = 500_000
    max_aggregate_state_bytes: int | None = 32 * MIB

    def tighten(self, **limits: int) -> QueryLimits:
        """Smaller limits for one request; 0 keeps the limit, a larger one does not lift it."""
        now = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{k: v if now[k] is None else min(v, now[k]) for k, v in limits.items() if v})

    @classmethod
    def none(cls) -> QueryLimits:
        return cls(**{f.name: None for f in fields(cls)})


@dataclass(frozen=True)
class TableLimits:
    max_rows: int | None = 1_000_000
    max_columns: int | None = 1_024
    max_cells: int | None = 4_000_000


@dataclass(frozen=True)
class SqlLimits:
    max_statements: int = 4_096
    max_insert_rows: int = 100_000
    max_insert_values: int = 1_000_000
    max_list_items: int = 100_000
    max_predicate_depth: int = 64
    max_predicate_nodes: int = 256
    max_batch_bytes: int = 64 * MIB
