"""The engine: scripts of statements over a catalog of tables.

Statements that change a table build a new frame and swap the catalog's entry at the end, so they happen whole or not at all,
and frames that were handed out before keep what they show. A table whose frame has been rewritten often is written out, so
that plans do not grow.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ORDER, Catalog, Entry, entry_of, fold
from .errors import (
    DatabaseBusy,
    DuplicateColumn,
    InsertOnlyStatementRequired,
    InvalidQuery,
    ResourceLimitExceeded,
    RowLength,
    TypeMismatch,
    typed,
)
from .limits import QueryLimits, SqlLimits, TableLimits
from .plans import metadata
from .plans.compile import Compiler, column, finite
from .sql import ast as A
from .sql import parse, parse_single
from .types import DataType, Field

MAX_DEPTH = 24


class Command:
    """A statement without a result. rows: how many it touched, counted when asked where the table may be of any size."""

    def __init__(self, rows: int | Callable[[], int] = 0):
        self._rows = rows

    @property
    def rows(self) -> int:
        if callable(self._rows):
            self._rows = self._rows()
        return self._rows


class Result:
    """A query's columns and frame. rows() runs it, within the limits."""

    def __init__(self, fields: list[Field], df: DataFrame, limits: QueryLimits):
        self.fields, self.df, self.limits = fields, df, limits
        self._rows: list[tuple] | None = None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def rows(self) -> list[tuple]:
        if self._rows is None:
            most = self.limits.max_rows
            try:
                found = [tuple(r) for r in (self.df if most is None else self.df.limit(most + 1)).collect()]
            except Exception as e:
                raise typed(e) from e
            if most is not None and len(found) > most:
                raise ResourceLimitExceeded("result rows", len(found), most)
            self._check("result values", len(found) * len(self.fields), self.limits.max_values)
            if self.limits.max_bytes is not None:
                self._check("result bytes", sum(len(v.encode()) if isinstance(v, str) else 8 for r in found for v in r), self.limits.max_bytes)
            self._rows = found
        return self._rows

    @staticmethod
    def _check(what: str, n: int, most: int | None) -> None:
        if most is not None and n > most:
            raise ResourceLimitExceeded(what, n, most)


class Engine:
    def __init__(self, spark: SparkSession, limits: QueryLimits | None = None, tables: TableLimits | None = None, sql: SqlLimits | None = None, ordered: bool = True):
        self.spark, self.catalog, self.ordered = spark, Catalog(), ordered
        self.limits, self.tables, self.sql = limits or QueryLimits(), tables or TableLimits(), sql or SqlLimits()

    @classmethod
    def over(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Engine:
        """An engine over frames of any size: without limits, and without sorts that a query does not ask for."""
        out = cls(spark, QueryLimits.none(), TableLimits(None, None, None), ordered=False)
        for name, df in tables.items():
            out.catalog.add(entry_of(name, df))
        return out

    # Running statements.
    def execute(self, script: str) -> list[Command | Result]:
        return [self.run(s) for s in parse(script, self.sql)]

    def query(self, text: str, limits: QueryLimits | None = None) -> Result:
        statement = parse_single(text, self.sql)
        if not isinstance(statement, A.QUERIES):
            raise InvalidQuery("expected a read-only query")
        return self.run(statement, limits)

    def frame(self, text: str) -> DataFrame:
        return self.query(text).df

    def run(self, s, limits: QueryLimits | None = None) -> Command | Result:
        limits = limits or self.limits
        if isinstance(s, (A.Select, A.Union, A.CrossJoin, A.EquiJoin)):
            compiler = Compiler(self.catalog, limits, self.ordered, self.written)
            df, fields = compiler.compile(s)
            for what, total, most in compiler.state:
                Result._check(what, total.first()[0], most)
            return Result(fields, df, limits)
        if isinstance(s, A.Constant):
            return self._local([Field(s.name, s.type, s.value is None)], [(s.value,)], limits)
        if isinstance(s, A.Meta):
            return self._local(*metadata.rows(s.what, s.table, self.catalog, limits, self.tables), limits)
        return getattr(self, f"_{type(s).__name__}")(s)

    def _local(self, fields: list[Field], rows: list[tuple], limits: QueryLimits) -> Result:
        schema = T.StructType([T.StructField(f"c{i}", f.type.spark, True) for i, f in enumerate(fields)])
        return Result(fields, self.spark.createDataFrame(rows, schema).toDF(*[f.name for f in fields]), limits)

    def execute_insert_batch(self, script: str) -> int:
        """A script of INSERTs, all or none."""
        statements = parse(script, self.sql)
        for s in statements:
            if not isinstance(s, A.Insert):
                raise InsertOnlyStatementRequired(type(s).__name__)
        before = dict(self.catalog.entries)
        try:
            return sum(self.run(s).rows for s in statements)
        except Exception:
            self.catalog.entries = before
            raise

    # Tables.
    def _schema(self, fields: Iterable[Field]) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark, True) for f in fields] + [T.StructField(ORDER, T.LongType(), False)])

    def _CreateTable(self, s: A.CreateTable) -> Command:
        names = [fold(f.name) for f in s.fields]
        for i, n in enumerate(names):
            if n in names[:i]:
                raise DuplicateColumn(s.fields[i].name)
        self._check_size(0, len(s.fields))
        if s.if_not_exists and fold(s.table) in self.catalog.entries:
            return Command()
        self.catalog.add(Entry(s.table, s.fields, self.spark.createDataFrame([], self._schema(s.fields))))
        return Command()

    def _DropTable(self, s: A.DropTable) -> Command:
        if not (s.if_exists and fold(s.table) not in self.catalog.entries):
            self.catalog.drop(s.table)
        return Command()

    def _RenameTable(self, s: A.RenameTable) -> Command:
        self.catalog.rename(s.table, s.to)
        return Command()

    def _check_size(self, rows: int, columns: int) -> None:
        for what, n, most in (("table rows", rows, self.tables.max_rows), ("table columns", columns, self.tables.max_columns), ("table cells", rows * columns, self.tables.max_cells)):
            if most is not None and n > most:
                raise ResourceLimitExceeded(what, n, most)

    def _put(self, entry: Entry) -> None:
        if entry.depth >= MAX_DEPTH:
            entry = replace(entry, df=self.written(entry.df, entry.name), depth=0, stored=True)
        self.catalog.put(entry)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the warehouse; its plan starts anew there."""
        where = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.conf.get("spark.sql.warehouse.dir")
        if where.startswith(("file:", "/")) and not self.spark.conf.get("spark.checkpoint.dir", None) and not self.spark.sparkContext.master.startswith("local"):
            raise InvalidQuery("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path)

    def _AddColumn(self, s: A.AddColumn) -> Command:
        e = self.catalog.get(s.table)
        if any(fold(f.name) == fold(s.field.name) for f in e.fields):
            if s.if_not_exists:
                return Command()
            raise DuplicateColumn(s.field.name)
        self._check_size(e.count(), len(e.fields) + 1)
        value = F.lit(None if s.field.nullable else s.field.type.default).cast(s.field.type.spark)
        self._put(e.having(e.df.withColumn(s.field.name, value), e.rows, fields=(*e.fields, s.field)))
        return Command()

    def _RenameColumn(self, s: A.RenameColumn) -> Command:
        e = self.catalog.get(s.table)
        f = e.field(s.column)
        if any(fold(g.name) == fold(s.to) and g is not f for g in e.fields):
            raise DuplicateColumn(s.to)
        names = tuple(replace(g, name=s.to) if g is f else g for g in e.fields)
        self._put(e.having(e.df.withColumnRenamed(f.name, s.to), e.rows, fields=names))
        return Command()

    def _DropColumn(self, s: A.DropColumn) -> Command:
        e = self.catalog.get(s.table)
        f = e.field(s.column)
        if len(e.fields) == 1:
            raise InvalidQuery(f"cannot drop the only column of table '{e.name}'")
        self._put(e.having(e.df.drop(f.name), e.rows, fields=tuple(g for g in e.fields if g is not f)))
        return Command()

    def check_value(self, f: Field, value, context: str):
        if value is None:
            if not f.nullable:
                raise TypeMismatch(context, f.type, "NULL")
        elif DataType.of_value(value) is not f.type:
            raise TypeMismatch(context, f.type, DataType.of_value(value))
        elif not finite(value):
            raise TypeMismatch(context, "finite Float64", value)

    def _Update(self, s: A.Update) -> Command:
        e = self.catalog.get(s.table)
        f, w = e.field(s.column), e.field(s.where_column)
        value = None if isinstance(s.value, A.Null) else s.value.value
        self.check_value(f, value, f"column '{f.name}'")
        self.check_value(w, s.where_value.value, f"column '{w.name}'")
        found = column(w) == F.lit(s.where_value.value)
        self._put(e.having(e.df.withColumn(f.name, F.when(found, F.lit(value).cast(f.type.spark)).otherwise(column(f))), e.rows))
        return Command(self._count(e, found))

    def _Delete(self, s: A.Delete) -> Command:
        e = self.catalog.get(s.table)
        found = F.coalesce(Compiler(self.catalog).predicate(s.where, e), F.lit(False))
        n = self._count(e, found)
        self._put(e.having(e.df.where(~found), None if e.rows is None else e.rows - n))
        return Command(n)

    def _count(self, e: Entry, found) -> int | Callable[[], int]:
        """How many rows are found: at once in a session's table, when asked in one of any size."""
        count = e.df.where(found).count
        return count() if e.rows is not None else count

    def _Truncate(self, s: A.Truncate) -> Command:
        e = self.catalog.get(s.table)
        self.catalog.put(replace(e, df=self.spark.createDataFrame([], self._schema(e.fields)), rows=0, depth=0))
        return Command(e.rows if e.rows is not None else e.df.count)

    def _Insert(self, s: A.Insert) -> Command:
        return Command(self.append(s.table, s.rows, s.columns))

    def append(self, table: str, rows: Iterable[tuple], columns: Iterable[str] | None = None) -> int:
        """Appends checked rows; columns that are left out get the default of their type."""
        e = self.catalog.get(table)
        given = list(e.fields) if columns is None else [e.field(c) for c in columns]
        for i, f in enumerate(given):
            if f in given[:i]:
                raise DuplicateColumn(f.name)
        place = {f.name: i for i, f in enumerate(given)}
        rows = list(rows)
        for r in rows:
            if len(r) != len(given):
                raise RowLength(e.name, len(given), len(r))
            for f, v in zip(given, r, strict=True):
                self.check_value(f, v, f"column '{f.name}'")
        self._check_size(e.count() + len(rows), len(e.fields))
        if not rows:
            return 0
        full = [(*(r[place[f.name]] if f.name in place else None if f.nullable else f.type.default for f in e.fields), e.next_order + i) for i, r in enumerate(rows)]
        new = self.spark.createDataFrame(full, self._schema(e.fields))
        df = new if e.rows == 0 else e.ordered().select(*new.columns).unionByName(new)
        self._put(e.having(df, None if e.rows is None else e.rows + len(rows), next_order=e.next_order + len(rows)))
        return len(rows)

    def append_frame(self, table: str, df: DataFrame) -> int:
        """Appends the rows of a stored frame with the table's columns, of any size; they come after all that are there."""
        e = self.catalog.get(table)
        n = df.count()
        self._check_size(e.count() + n, len(e.fields))
        numbered = df.select(*[column(f) for f in e.fields]).withColumn(ORDER, F.lit(e.next_order) + F.monotonically_increasing_id())
        new = self.written(numbered, e.name)  # its numbers stay as they are
        top = new.agg(F.max(ORDER)).first()[0]
        whole = new if e.rows == 0 else e.ordered().select(*new.columns).unionByName(new)
        self._put(e.having(whole, None if e.rows is None else e.rows + n, next_order=e.next_order if top is None else top + 1, stored=True))
        return n


class SharedEngine:
    """An engine for several threads: many readers or one writer. try_ forms raise DatabaseBusy instead of waiting."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._lock, self._readers, self._free = threading.Condition(), 0, True

    @contextmanager
    def _reading(self, wait: bool):
        with self._lock:
            if not wait and not self._free:
                raise DatabaseBusy
            self._lock.wait_for(lambda: self._free)
            self._readers += 1
        try:
            yield
        finally:
            with self._lock:
                self._readers -= 1
                self._lock.notify_all()

    @contextmanager
    def _writing(self, wait: bool):
        with self._lock:
            if not wait and (self._readers or not self._free):
                raise DatabaseBusy
            self._lock.wait_for(lambda: self._free and not self._readers)
            self._free = False
        try:
            yield
        finally:
            with self._lock:
                self._free = True
                self._lock.notify_all()

    def query(self, text: str, limits: QueryLimits | None = None, wait: bool = True) -> Result:
        with self._reading(wait):
            result = self.engine.query(text, limits)
            result.rows()
            return result

    def execute(self, script: str, wait: bool = True) -> list[Command | Result]:
        with self._writing(wait):
            return self.engine.execute(script)

    def execute_insert_batch(self, script: str, wait: bool = True) -> int:
        with self._writing(wait):
            return self.engine.execute_insert_batch(script)

    def ingest(self, reader, table: str, data: bytes, wait: bool = True) -> int:
        with self._writing(wait):
            return reader(self.engine, table, data)

    def try_query(self, text: str, limits: QueryLimits | None = None) -> Result:
        return self.query(text, limits, wait=False)

    def try_execute_insert_batch(self, script: str) -> int:
        return self.execute_insert_batch(script, wait=False)
