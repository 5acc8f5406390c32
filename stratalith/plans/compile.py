"""Checks names, types and shapes of a query and builds its DataFrame.

Rows are chosen (filter, order, offset, limit) before scalar projections run, so a value that would raise in a row that is
not returned never raises. With ordered=True results come in source order, or in the order in which groups were first seen,
where the query gives none; that costs a sort, so queries on large tables go without.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import ORDER, Catalog, Entry, fold
from ..errors import InvalidQuery, ResourceLimitExceeded, TypeMismatch, UnionColumnCountMismatch
from ..functions import exprs as X
from ..limits import QueryLimits
from ..operators import kernels
from ..sql import ast as A
from ..types import DataType, Field

INT, FLT, BOOL, STR = DataType.INT64, DataType.FLOAT64, DataType.BOOL, DataType.STRING
NUMBERS = (INT, FLT)
#: What each scalar takes.
TAKES = {"LENGTH": (STR,), "lengthUTF8": (STR,), "empty": (STR,), "LOWER": (STR,), "UPPER": (STR,), "ABS": NUMBERS, "ROUND": (FLT,), "FLOOR": (FLT,), "CEIL": (FLT,), "-": (INT,), "ifNull": (INT,)}
GROUPED = ("isNull", "isNotNull", "ifNull", "CAST")
CASTS = {INT: (FLT, BOOL, STR), FLT: (INT, BOOL, STR), BOOL: (INT, FLT, STR), STR: (INT, FLT, BOOL)}


def column(f: Field) -> Column:
    return F.col(f"`{f.name}`")


class Compiler:
    def __init__(self, catalog: Catalog, limits: QueryLimits | None = None, ordered: bool = True, write: Callable[[DataFrame, str], DataFrame] | None = None):
        self.catalog, self.limits, self.ordered, self.write = catalog, limits or QueryLimits.none(), ordered, write
        #: What the state of the query must not exceed: (what, frame of one number, limit). run() of the engine looks.
        self.state: list[tuple[str, DataFrame, int]] = []

    def charge(self, what: str, df: DataFrame, size: Column, most: int | None) -> None:
        """Remembers a limit on the sum of size over the rows of df."""
        if most is not None:
            self.state.append((what, df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))), most))

    @staticmethod
    def bytes_of(columns: list[tuple[Column, DataType]]) -> Column:
        """8 bytes a number, 1 a Bool, and the bytes of a String."""
        sizes = [F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0)) if kind is STR else F.lit(1 if kind is BOOL else 8) for c, kind in columns]
        return sum(sizes, F.lit(0))

    def compile(self, query) -> tuple[DataFrame, list[Field]]:
        if isinstance(query, A.Select):
            return self.select(query)
        if isinstance(query, A.Union):
            return self.union(query)
        if isinstance(query, A.CrossJoin):
            return self.cross_join(query)
        return self.equi_join(query)

    def scanned(self, name: str) -> Entry:
        """A table whose rows are charged to the scan limit before any is read."""
        entry = self.catalog.get(name)
        most = self.limits.max_scan_rows
        if most is not None and (n := entry.count()) > most:
            raise ResourceLimitExceeded("scanned rows", n, most)
        return entry

    # Predicates.
    def predicate(self, p, entry: Entry) -> Column:
        if isinstance(p, A.Both):
            left, right = self.predicate(p.left, entry), self.predicate(p.right, entry)
            return left & right if p.op == "and" else left | right
        if isinstance(p, A.Not):
            return ~self.predicate(p.inner, entry)
        if isinstance(p, A.Compare):
            return self.comparison(p.op, p.left, p.right, entry)
        f = entry.field(p.column)
        c = column(f)
        if isinstance(p, A.IsNull):
            return c.isNotNull() if p.negated else c.isNull()
        if isinstance(p, A.Between):
            inside = self.comparison(">=", A.Col(p.column), p.low, entry) & self.comparison("<=", A.Col(p.column), p.high, entry)
            return ~inside if p.negated else inside
        if isinstance(p, A.In):
            inside = self.among(f, p.values, entry)
            return ~inside if p.negated else inside
        if f.type is not STR:
            raise TypeMismatch("LIKE", STR, f.type)
        found = {"all": lambda: X.truth(c, True), "prefix": lambda: c.startswith(p.text), "suffix": lambda: c.endswith(p.text), "contains": lambda: c.contains(p.text)}[p.kind]()
        return ~found if p.negated else found

    def among(self, f: Field, values: tuple, entry: Entry) -> Column:
        """One set where all values are of the column's type, else equalities."""
        if values and all(isinstance(v, A.Lit) and DataType.of_value(v.value) is f.type for v in values):
            return column(f).isin([v.value for v in values])
        out = None
        for v in values:
            one = self.comparison("=", A.Col(f.name), v, entry)
            out = one if out is None else out | one
        return out

    def comparison(self, op: str, left, right, entry: Entry) -> Column:
        for side in (left, right):
            if isinstance(side, A.Null):
                raise InvalidQuery("WHERE comparisons do not support NULL literals")

        def kind(side) -> DataType:
            return entry.field(side.name).type if isinstance(side, A.Col) else DataType.of_value(side.value)

        a, b = kind(left), kind(right)
        if a is not b and not (a in NUMBERS and b in NUMBERS):
            raise TypeMismatch("WHERE comparison", a, b)
        if isinstance(left, A.Lit):
            if isinstance(right, A.Lit):
                return F.lit(bool({"=": left.value == right.value, "!=": left.value != right.value, "<": left.value < right.value, "<=": left.value <= right.value, ">": left.value > right.value, ">=": left.value >= right.value}[op]))
            return self.comparison(X.FLIP[op], right, left, entry)
        c = column(entry.field(left.name))
        if isinstance(right, A.Col):
            d = column(entry.field(right.name))
            if a is b:
                return X.compare(op, c, d)
            return X.int_with_float_column(c, op, d) if a is INT else X.int_with_float_column(d, X.FLIP[op], c)
        if a is b:
            return X.compare(op, c, F.lit(right.value))
        return X.int_with_float(c, op, right.value) if a is INT else X.float_with_int(c, op, right.value)

    # Projections.
    def check_scalar(self, item: A.Item, f: Field) -> None:
        if item.function == "CAST":
            identity = f.type is item.argument
            if identity and not (f.type is INT and f.nullable) or not identity and item.argument not in CASTS[f.type]:
                raise InvalidQuery(f"CAST({f.type} AS {item.argument}) is not supported")
        elif item.function == "ifNull" and not (f.type is INT and f.nullable):
            raise TypeMismatch("ifNull", "Nullable(Int64)", f.declared)
        elif item.function in TAKES and f.type not in TAKES[item.function]:
            raise TypeMismatch(item.function if item.function != "-" else "subtraction", " or ".join(map(str, TAKES[item.function])), f.type)

    def projected(self, item: A.Item, entry: Entry) -> tuple[Column, Field]:
        f = entry.field(item.column)
        if item.kind == "column":
            return column(f), Field(item.alias or f.name, f.type, f.nullable)
        self.check_scalar(item, f)
        value, kind = X.scalar(item.function, column(f), f.type, item.argument)
        return value, Field(item.output, kind, f.nullable and item.function not in ("ifNull", "isNull", "isNotNull"))

    def page(self, df: DataFrame, keys: list[Column], q: A.Select) -> DataFrame:
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def select(self, q: A.Select) -> tuple[DataFrame, list[Field]]:
        entry = self.scanned(q.table)
        items = [A.Item("column", f.name, column=f.name) if i.kind == "star" else i for i in q.items for f in (entry.fields if i.kind == "star" else (None,))]
        needs_order = self.ordered or q.limit is not None or any(i.kind == "row_number" for i in items)
        df = entry.ordered() if needs_order else entry.df
        if q.where is not None:
            df = df.where(self.predicate(q.where, entry))
        if q.group_by is not None or q.having or any(i.kind == "aggregate" for i in items):
            return self.grouped(q, items, entry, df)
        if q.distinct:
            return self.distinct(q, items, entry, df)
        if any(i.kind == "row_number" for i in items):
            return self.row_number(q, items, entry, df)
        keys, sorted_by = [], []
        for k in q.order_by:
            item = self.output(k.name, items, entry)
            f = entry.field(item.column)
            if item.kind == "column":
                keys.append(self.way(column(f), k.descending, k.nulls))
            else:
                self.check_scalar(item, f)
                if k.nulls:
                    keys.append(column(f).isNull().desc() if k.nulls == "first" else column(f).isNull().asc())
                keys += X.order_keys(item.function, column(f), f.type, item.argument, k.descending)
            sorted_by.append((column(f), f.type))
        if keys and needs_order or q.limit is not None or self.ordered and entry.stored:
            keys.append(F.col(ORDER))
        made = [self.projected(i, entry) for i in items]
        if sorted_by and self.limits.max_ordering_state_bytes is not None:
            held = df if q.limit is None else df.orderBy(*keys).limit(q.offset + q.limit)
            self.charge("ordering state bytes", held, self.bytes_of(sorted_by) + 8, self.limits.max_ordering_state_bytes)
        df = self.page(df, keys, q)
        return self.named(df, [c for c, _ in made], [f for _, f in made])

    def named(self, df: DataFrame, columns: list[Column], fields: list[Field]) -> tuple[DataFrame, list[Field]]:
        """Results may share a name, so columns get their names last."""
        return df.select(*[c.alias(f"__c{i}") for i, c in enumerate(columns)]).toDF(*[f.name for f in fields]), fields

    def way(self, c: Column, descending: bool, nulls: str | None = None) -> Column:
        """Nulls lie below all values unless the query places them."""
        first = nulls == "first" if nulls else not descending
        return {(True, True): c.desc_nulls_first, (True, False): c.desc_nulls_last, (False, True): c.asc_nulls_first, (False, False): c.asc_nulls_last}[descending, first]()

    def output(self, name: str, items: list[A.Item], entry: Entry) -> A.Item:
        for i in items:
            if fold(i.output) == fold(name) or i.kind != "column" and i.name == name:
                return i
        for i in items:
            if i.kind == "column" and fold(i.column) == fold(name):
                return i
        raise InvalidQuery(f"ORDER BY column or alias '{name}' is not in the SELECT output")

    def distinct(self, q: A.Select, items, entry: Entry, df: DataFrame) -> tuple[DataFrame, list[Field]]:
        fields = [entry.field(i.column) for i in items]
        columns = [column(f) for f in fields]
        keys = [self.way(column(entry.field(self.output(k.name, items, entry).column)), k.descending, k.nulls) for k in q.order_by]
        if ORDER in df.columns:
            df = df.groupBy(*columns).agg(F.min(ORDER).alias(ORDER))
            keys.append(F.col(ORDER))
        else:
            df = df.select(*columns).distinct()
        return self.named(self.page(df, keys, q), columns, fields)

    def row_number(self, q: A.Select, items, entry: Entry, df: DataFrame) -> tuple[DataFrame, list[Field]]:
        item = next(i for i in items if i.kind == "row_number")
        if item.column is None:
            keys = [F.col(ORDER)] if entry.engine == "Memory" or q.limit is not None else []
        else:
            f = entry.field(item.column)
            if f.type is not INT:
                raise TypeMismatch("ROW_NUMBER ORDER BY", INT, f.type)
            c = column(f)
            keys = [self.way(c, item.argument), F.col(ORDER)]
        df = df.select(ORDER, *{c: column(entry.field(c)) for c in sorted({fold(i.column): i.column for i in items if i.column is not None}.values())}.values())
        if q.limit is not None:  # numbers of the first rows need only these
            df = df.orderBy(*keys).limit(q.limit).withColumn("__number", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
        else:
            df = kernels.numbered(df, keys, self.write, "__number")
        if self.ordered or q.limit is not None:
            df = df.orderBy("__number")
        columns, fields = [], []
        for i in items:
            c, f = (F.col("__number"), Field(i.output, INT)) if i.kind == "row_number" else self.projected(i, entry)
            columns.append(c)
            fields.append(f)
        return self.named(df, columns, fields)

    # Groups.
    def aggregate(self, item: A.Item, entry: Entry) -> tuple[Column, Field]:
        if item.column is None:
            return F.count(F.lit(1)), Field(item.output, INT)
        f = entry.field(item.column)
        if item.function in ("SUM", "AVG") and f.type not in NUMBERS:
            raise TypeMismatch(item.function, "Int64 or Float64", f.type)
        if item.function == "countIf" and f.type is not BOOL:
            raise TypeMismatch("countIf", BOOL, f.type)
        value, kind = X.aggregate(item.function, column(f), f.type)
        return value, Field(item.output, kind, item.function not in ("COUNT", "countIf"))

    def grouped(self, q: A.Select, items, entry: Entry, df: DataFrame) -> tuple[DataFrame, list[Field]]:
        keys = [entry.field(g) for g in q.group_by or ()]
        for g in q.group_casts:
            if not (entry.field(g).type is INT and entry.field(g).nullable):
                raise InvalidQuery("GROUP BY CAST only supports CAST(Nullable(Int64) AS Int64)")
        names = {fold(f.name): f"__k{i}" for i, f in enumerate(keys)}
        aggregates, after, fields = [], [], []
        for n, item in enumerate(items):
            if item.kind == "aggregate":
                value, f = self.aggregate(item, entry)
                aggregates.append(value.alias(f"__a{n}"))
                after.append(F.col(f"__a{n}"))
                fields.append(f)
                continue
            if item.kind == "scalar" and (item.function not in GROUPED or item.function == "CAST" and item.argument is not INT):
                raise InvalidQuery(f"{item.function} projections are only supported in ungrouped SELECT queries")
            f = entry.field(item.column)
            if fold(f.name) not in names:
                raise InvalidQuery(f"column '{item.column}' must appear in GROUP BY")
            key = F.col(names[fold(f.name)])
            if item.kind == "scalar":
                self.check_scalar(item, f)
                value, kind = X.scalar(item.function, key, f.type, item.argument)
                after.append(value)
                fields.append(Field(item.output, kind, f.nullable and item.function == "CAST"))
            else:
                after.append(key)
                fields.append(Field(item.alias or f.name, f.type, f.nullable))
        by_source = q.group_by is not None and ORDER in df.columns
        if by_source:
            aggregates.append(F.min(ORDER).alias("__first"))
        with_keys = df.select("*", *[column(f).alias(names[fold(f.name)]) for f in keys])
        out = with_keys.groupBy(*names.values()).agg(*(aggregates or [F.count(F.lit(1)).alias("__n")])) if q.group_by is not None else df.agg(*(aggregates or [F.count(F.lit(1)).alias("__n")]))
        if q.group_by is not None:
            most, by = self.limits, [(F.col(names[fold(f.name)]), f.type) for f in keys]
            self.charge("groups", out if most.max_groups is None else out.limit(most.max_groups + 1), F.lit(1), most.max_groups)
            self.charge("group key cells", out, F.lit(len(keys)), most.max_group_key_cells)
            self.charge("group key bytes", out, self.bytes_of(by), most.max_group_key_bytes)
        held = [(F.col(f"__a{n}"), f.type) for n, (i, f) in enumerate(zip(items, fields, strict=True)) if i.kind == "aggregate"]
        self.charge("aggregate state cells", out, F.lit(len(held)), self.limits.max_aggregate_state_cells)
        self.charge("aggregate state bytes", out, self.bytes_of(held), self.limits.max_aggregate_state_bytes)
        if q.having:
            out = out.where(self.having(q.having, items, fields, after))
        order = []
        for k in q.order_by:
            at = self.position(k.name, items, entry)
            order.append(self.way(after[at], k.descending, k.nulls))
        if by_source and (order or self.ordered or q.limit is not None):
            order.append(F.col("__first"))
        return self.named(self.page(out, order, q), after, fields)

    def position(self, name: str, items, entry: Entry) -> int:
        found = self.output(name, items, entry)
        return next(n for n, i in enumerate(items) if i is found)

    def having(self, h: A.Having, items, fields: list[Field], after: list[Column]) -> Column:
        at = next((n for n, i in enumerate(items) if i.kind == "aggregate" and i.alias and fold(i.alias) == fold(h.alias)), None)
        if at is None:
            raise InvalidQuery(f"HAVING requires a projected aggregate alias; '{h.alias}' is not one")
        c, kind = after[at], fields[at].type
        if h.op in ("null", "notnull"):
            return c.isNull() if h.op == "null" else c.isNotNull()
        if kind not in NUMBERS:
            raise TypeMismatch("HAVING comparison", "Int64 or Float64", kind)
        if isinstance(h.value, float) is (kind is FLT):
            return X.compare(h.op, c, F.lit(h.value))
        return X.int_with_float(c, h.op, h.value) if kind is INT else X.float_with_int(c, h.op, h.value)

    # Several tables.
    def union(self, q: A.Union) -> tuple[DataFrame, list[Field]]:
        left, a = self.select(q.left)
        right, b = self.select(q.right)
        word = "DISTINCT" if q.distinct else "ALL"
        if len(a) != len(b):
            raise UnionColumnCountMismatch(word, len(a), len(b))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x.type is not y.type:
                raise TypeMismatch(f"UNION {word} column {i + 1}", x.type, y.type)
        names = [f"__c{i}" for i in range(len(a))]
        left, right = left.toDF(*names), right.toDF(*names)
        fields = [Field(x.name, x.type, x.nullable or y.nullable) for x, y in zip(a, b, strict=True)]
        if not q.distinct:
            return left.union(right).toDF(*[f.name for f in fields]), fields
        if not self.ordered:
            return left.union(right).distinct().toDF(*[f.name for f in fields]), fields
        tagged = left.withColumn("__side", F.lit(0)).union(right.withColumn("__side", F.lit(1))).withColumn(ORDER, F.monotonically_increasing_id())
        first = tagged.groupBy(*names).agg(F.min(F.struct("__side", ORDER)).alias("__at")).orderBy("__at")
        return first.select(*names).toDF(*[f.name for f in fields]), fields

    def cross_join(self, q: A.CrossJoin) -> tuple[DataFrame, list[Field]]:
        """Left rows in order, each with all right rows; with LIMIT n no more than n rows of a side can matter."""
        left, right = self.scanned(q.left), self.scanned(q.right)
        sides = []
        for prefix, e in (("l", left), ("r", right)):
            df = e.ordered() if self.ordered or q.limit is not None else e.df
            if q.limit is not None:
                df = df.orderBy(ORDER).limit(q.limit)
            sides.append(df.select(*[column(f).alias(f"__{prefix}{i}") for i, f in enumerate(e.fields)], *([F.col(ORDER).alias(f"__{prefix}")] if ORDER in df.columns else [])))
        df = sides[0].crossJoin(sides[1])
        if "__l" in df.columns:
            df = df.orderBy("__l", "__r")
        if q.limit is not None:
            df = df.limit(q.limit)
        fields = [*left.fields, *right.fields]
        return self.named(df, [F.col(f"__l{i}") for i in range(len(left.fields))] + [F.col(f"__r{i}") for i in range(len(right.fields))], fields)

    def equi_join(self, q: A.EquiJoin) -> tuple[DataFrame, list[Field]]:
        left, right = self.scanned(q.left), self.scanned(q.right)
        a, b = left.field(q.left_key), right.field(q.right_key)
        if a.type is not b.type:
            raise TypeMismatch("JOIN keys", a.type, b.type)
        source = left if q.kind == "inner" else right
        f = source.field(q.projected)
        keep_order = self.ordered
        l_df = (left.ordered() if keep_order else left.df).select(column(a).alias("__lk"), *([column(f).alias("__out")] if source is left else []), *([F.col(ORDER).alias("__l")] if keep_order else []))
        r_df = (right.ordered() if keep_order else right.df).select(column(b).alias("__rk"), *([column(f).alias("__out")] if source is right else []), *([F.col(ORDER).alias("__r")] if keep_order else []))
        df = kernels.equi_join(l_df, r_df, "__lk", "__rk", q.kind)
        if keep_order:
            df = df.orderBy("__l", "__r")
        return self.named(df, [F.col("__out")], [Field(f.name, f.type, True)])


def finite(value) -> bool:
    return not isinstance(value, float) or math.isfinite(value)
