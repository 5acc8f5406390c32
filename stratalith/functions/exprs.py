"""Builders of Columns whose results are exact where Spark's own are looser.

All but the text of a Float64 (Arrow's own, batch by batch) stay on the JVM. order_key() gives a key that sorts as the expression does but raises nothing,
so that rows outside LIMIT are never computed.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import cast_text, overflow_text
from ..types import DataType

LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INTEGER = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INT, FLT, BOOL, STR = DataType.INT64, DataType.FLOAT64, DataType.BOOL, DataType.STRING


def fails(text: str, kind: DataType) -> Column:
    return F.raise_error(F.lit(text)).cast(kind.spark)


def truth(column: Column, value: bool) -> Column:
    """value where the column is not null, else null."""
    return F.when(column.isNotNull(), F.lit(value))


def compare(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def int_with_float(column: Column, op: str, value: float) -> Column:
    """An Int64 column against a Float64 literal, as exact numbers."""
    if value >= 2**63 or value < -(2**63):
        return truth(column, op in (("<", "<=", "!=") if value > 0 else (">", ">=", "!=")))
    whole = math.floor(value)
    if whole == value:
        return compare(op, column, F.lit(int(whole)))
    if op in ("=", "!="):
        return truth(column, op == "!=")
    return column <= F.lit(whole) if op in ("<", "<=") else column > F.lit(whole)


def float_with_int(column: Column, op: str, value: int) -> Column:
    """A Float64 column against an Int64 literal, as exact numbers: the nearest double decides which side of it counts."""
    near = float(value)
    if int(near) == value:
        return compare(op, column, F.lit(near))
    if op in ("=", "!="):
        return truth(column, op == "!=")
    above = int(near) > value  # no double lies between the literal and the nearest one
    if op in ("<", "<="):
        return column < F.lit(near) if above else column <= F.lit(near)
    return column >= F.lit(near) if above else column > F.lit(near)


def int_with_float_column(i: Column, op: str, f: Column) -> Column:
    """An Int64 and a Float64 column, as exact numbers."""
    inside = (f >= F.lit(-(2.0**63))) & (f < F.lit(2.0**63))
    whole = F.when(inside, f.cast("bigint"))
    part = F.when(inside, f - whole.cast("double"))
    order = F.when(f >= F.lit(2.0**63), -1).when(f < F.lit(-(2.0**63)), 1).when(i < whole, -1).when(i > whole, 1).when(part > 0, -1).when(part < 0, 1).otherwise(0)
    return F.when(i.isNotNull() & f.isNotNull(), compare(op, order, F.lit(0)))


# Strings.
def lower_ascii(c: Column) -> Column:
    return F.translate(c, UP, LOW)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOW, UP)


def float_text(c: Column) -> Column:
    """The shortest text that reads back as the same number, without exponent; whole numbers have no point."""

    def texts(values: pa.Array) -> pa.Array:
        values = pc.if_else(pc.is_nan(values), pa.scalar(None, pa.float64()), values)
        said = pc.replace_substring_regex(values.cast(pa.string()), r"\.0$", "")
        far = pc.fill_null(pc.match_substring(said, "e"), False)
        if pc.any(far).as_py():  # very large and very small numbers
            plain = [format(Decimal(repr(x)), "f") for x in values.filter(far).to_pylist()]
            said = pc.replace_with_mask(said, far, pa.array([x.rstrip("0").rstrip(".") if "." in x else x for x in plain], pa.string()))
        return said

    return F.arrow_udf(texts, "string")(c)


# Numbers.
def floor_float(x: Column) -> Column:
    r = F.rint(x)
    return F.when(r > x, r - 1.0).otherwise(r)


def ceil_float(x: Column) -> Column:
    r = F.rint(x)
    return F.when(r < x, r + 1.0).otherwise(r)


def abs_int(c: Column) -> Column:
    least = F.expr("-9223372036854775807L - 1L")
    return F.when(c == least, fails(overflow_text("ABS(Int64)"), INT)).otherwise(F.abs(F.when(c != least, c)))


def minus(c: Column, n: int) -> Column:
    if n == 0:
        return c
    bound = -(2**63) + n
    return F.when(c < F.lit(bound), fails(overflow_text("Int64 subtraction"), INT)).otherwise(F.when(c >= F.lit(bound), c) - F.lit(n))


def cast(c: Column, source: DataType, target: DataType) -> Column:
    if source is target:
        return c
    if source is INT:
        return {FLT: lambda: c.cast("double"), BOOL: lambda: c != 0, STR: lambda: c.cast("string")}[target]()
    if source is BOOL:
        return {INT: lambda: c.cast("bigint"), FLT: lambda: c.cast("int").cast("double"), STR: lambda: c.cast("string")}[target]()
    if source is FLT:
        if target is BOOL:
            return c != 0.0
        if target is STR:
            return float_text(c)
        outside = (c >= F.lit(2.0**63)) | (c < F.lit(-(2.0**63)))
        return F.when(outside, fails(overflow_text("CAST(Float64 AS Int64)"), INT)).otherwise(F.when(~outside, c).cast("bigint"))
    if target is INT:
        number = c.try_cast("bigint")
        wrong = F.when(c.rlike(INTEGER), fails(overflow_text("CAST(String AS Int64)"), INT)).otherwise(fails(cast_text(source, target), INT))
        return F.when(c.isNull(), F.lit(None).cast("bigint")).when(c.rlike(INTEGER) & number.isNotNull(), number).otherwise(wrong)
    if target is FLT:
        number = c.try_cast("double")
        wrong = F.when(c.rlike(FLOAT), fails(overflow_text("CAST(String AS Float64)"), FLT)).otherwise(fails(cast_text(source, target), FLT))
        return F.when(c.isNull(), F.lit(None).cast("double")).when(c.rlike(FLOAT) & (F.abs(number) != float("inf")), number).otherwise(wrong)
    low = lower_ascii(c)
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(low == "true", True).when(low == "false", False).otherwise(fails(cast_text(source, target), BOOL))


def scalar(function: str, c: Column, kind: DataType, argument) -> tuple[Column, DataType]:
    """The value of a scalar call and its type."""
    if function == "CAST":
        return cast(c, kind, argument), argument
    if function == "toString":
        return cast(c, kind, STR), STR
    if function == "ifNull":
        return F.coalesce(c, F.lit(argument)), INT
    if function == "-":
        return minus(c, argument), INT
    if function == "ABS":
        return (abs_int(c), INT) if kind is INT else (F.abs(c), FLT)
    return {
        "LENGTH": lambda: (F.octet_length(c).cast("bigint"), INT),
        "lengthUTF8": lambda: (F.char_length(c).cast("bigint"), INT),
        "empty": lambda: ((c == "").cast("bigint"), INT),
        "LOWER": lambda: (lower_ascii(c), STR),
        "UPPER": lambda: (upper_ascii(c), STR),
        "ROUND": lambda: (F.round(c), FLT),
        "FLOOR": lambda: (floor_float(c), FLT),
        "CEIL": lambda: (ceil_float(c), FLT),
        "isNull": lambda: (c.isNull(), BOOL),
        "isNotNull": lambda: (c.isNotNull(), BOOL),
    }[function]()


def order_keys(function: str, c: Column, kind: DataType, argument, descending: bool) -> list[Column]:
    """Keys that sort as the expression does, nulls first on the way up, without raising on overflow."""

    def way(x: Column, down: bool) -> Column:
        return x.desc_nulls_last() if down else x.asc_nulls_first()

    if function == "ABS" and kind is INT:
        negative = F.when(c < 0, c).otherwise(-F.when(c >= 0, c))
        return [negative.asc_nulls_last() if descending else negative.desc_nulls_first()]
    if function == "-":
        return [way(c, descending)]
    if function == "CAST" and kind is FLT and argument is INT:
        return [way(F.when(c < 0, ceil_float(c)).otherwise(floor_float(c)), descending)]
    if function == "CAST" and kind is STR and argument is FLT:
        number = F.when(c.rlike(FLOAT), c.try_cast("double")).when(c.isNotNull(), fails(cast_text(STR, FLT), FLT))
        return [way(number, descending)]
    if function == "CAST" and kind is STR and argument is INT:
        good = F.when(c.rlike(INTEGER), c).when(c.isNotNull(), fails(cast_text(STR, INT), STR))
        digits = F.regexp_replace(F.regexp_replace(good, r"\A[+-]", ""), r"\A0+", "")
        sign = F.when(F.length(digits) == 0, 0).when(good.startswith("-"), -1).otherwise(1)
        flipped = F.translate(digits, "0123456789", "9876543210")
        return [way(sign, descending), way(sign * F.length(digits), descending), way(F.when(sign < 0, flipped).otherwise(digits), descending)]
    value, _ = scalar(function, c, kind, argument)
    return [way(value, descending)]


# Aggregates.
def exact_sum(c: Column) -> Column:
    """SUM(Int64) as decimal: three limbs of 22, 21 and 21 bits are added as bigints, so no intermediate sum can overflow below
    2^41 rows a group."""
    low = F.lit((1 << 21) - 1)
    limbs = F.sum(F.shiftright(c, 42)), F.sum(F.shiftright(c, 21).bitwiseAND(low)), F.sum(c.bitwiseAND(low))
    high, mid, least = (x.cast("decimal(19,0)") for x in limbs)
    return high * F.lit(1 << 42).cast("decimal(13,0)") + mid * F.lit(1 << 21).cast("decimal(7,0)") + least


def sum_int(c: Column) -> Column:
    total = exact_sum(c)
    inside = (total <= F.lit(2**63 - 1)) & (total >= F.expr("cast(-9223372036854775808 as decimal(19,0))"))
    return F.when(total.isNull() | inside, F.when(inside, total).cast("bigint")).otherwise(fails(overflow_text("SUM(Int64)"), INT))


def avg_int(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 0, exact_sum(c).cast("double") / n)


def aggregate(function: str, c: Column | None, kind: DataType | None) -> tuple[Column, DataType]:
    if function == "COUNT":
        return F.count(F.lit(1) if c is None else c), INT
    if function == "countIf":
        return F.count_if(c), INT
    if function == "SUM":
        return (sum_int(c), INT) if kind is INT else (F.sum(c), FLT)
    if function == "AVG":
        return (avg_int(c) if kind is INT else F.avg(c)), FLT
    return (F.min(c) if function == "MIN" else F.max(c)), kind
