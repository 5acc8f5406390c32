"""Text of results: table, CSV, TSV, JSON and JSON lines."""

from __future__ import annotations

import json

from ..engine import Result
from ..errors import InvalidQuery, ResourceLimitExceeded
from ..types import Field

MAX_BYTES = 16 << 20
NAMES = ("table", "csv", "tsv", "json", "jsoneachrow", "jsoncompacteachrow")
TSV = {"\\": "\\\\", "\t": "\\t", "\r": "\\r", "\n": "\\n", "\0": "\\0", "\b": "\\b", "\f": "\\f", "'": "\\'"}
CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\"}


def display(v) -> str:
    """A value as shown: whole Float64 values end in .0, and there is no exponent."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        from decimal import Decimal

        text = format(Decimal(repr(v)), "f")
        return text if "." in text else text + ".0"
    return str(v)


def as_table(fields: list[Field], rows: list[tuple]) -> str:
    def shown(v) -> str:
        return "".join(CONTROL.get(c, c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in display(v))

    cells = [[shown(f.name) for f in fields], *([shown(v) for v in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(fields))]
    border = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    said = ["|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths, strict=True)) + "|" for r in cells]
    return "\n".join([border, said[0], border, *said[1:], border]) + "\n" if rows else "\n".join([border, said[0], border]) + "\n"


def as_csv(fields: list[Field], rows: list[tuple], header: bool = True) -> str:
    def cell(text: str) -> str:
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text

    lines = [[f.name for f in fields]] * header + [[display(v) for v in r] for r in rows]
    return "".join(",".join(map(cell, line)) + "\n" for line in lines)


def as_tsv(fields: list[Field], rows: list[tuple], header: bool = True) -> str:
    def cell(text: str) -> str:
        return "".join(TSV.get(c, c) for c in text)

    lines = [[cell(f.name) for f in fields]] * header + [["\\N" if v is None else cell(display(v)) for v in r] for r in rows]
    return "".join("\t".join(line) + "\n" for line in lines)


def value(v) -> str:
    return display(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)


def as_json(fields: list[Field], rows: list[tuple]) -> str:
    columns = ",".join(f'{{"name":{value(f.name)},"type":{value(str(f.type))}}}' for f in fields)
    return f'{{"columns":[{columns}],"rows":[{",".join("[" + ",".join(map(value, r)) + "]" for r in rows)}]}}\n'


def as_json_rows(fields: list[Field], rows: list[tuple]) -> str:
    return "".join("{" + ",".join(f"{value(f.name)}:{value(v)}" for f, v in zip(fields, r, strict=True)) + "}\n" for r in rows)


def as_json_arrays(fields: list[Field], rows: list[tuple]) -> str:
    return "".join("[" + ",".join(map(value, r)) + "]\n" for r in rows)


def written(result: Result, name: str, header: bool = True, max_bytes: int | None = MAX_BYTES) -> str:
    """A result in a format, by the format's name whatever its case."""
    name = name.lower()
    if name not in NAMES:
        raise InvalidQuery(f"unknown output format '{name}'")
    fields, rows = result.fields, result.rows()
    make = {"table": as_table, "json": as_json, "jsoneachrow": as_json_rows, "jsoncompacteachrow": as_json_arrays}
    out = as_csv(fields, rows, header) if name == "csv" else as_tsv(fields, rows, header) if name == "tsv" else make[name](fields, rows)
    if max_bytes is not None and (n := len(out.encode())) > max_bytes:
        raise ResourceLimitExceeded("formatted result bytes", n, max_bytes)
    return out


def save(result: Result, path: str, name: str, header: bool = True) -> None:
    """A result of any size as a folder of files, written by the executors."""
    df = result.df
    if name in ("csv", "tsv"):
        df.write.csv(path, sep="," if name == "csv" else "\t", header=header, nullValue="NULL" if name == "csv" else "\\N", quote='"', escape='"')
    elif name == "jsoneachrow":
        df.write.json(path, ignoreNullFields=False)
    else:
        df.write.parquet(path)
