"""Written intermediate tables, joins on skewed keys, and Bloom filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets a temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='stratalith-')}"
    return _OWN[app]


#: Rows and bytes that go to a Python worker at once while a table is written: sets and texts are wide, and a batch is held on
#: both sides of the pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: How tables are read while one is written. A vectored read takes a column's whole share of a row group at once, and each of the
#: threads that do so keeps direct memory of that size; without it the share comes in pieces. Rows of a scan are wide too.
READ = {"parquet.hadoop.vectored.io.enabled": "false", "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Bytes of a row group of tables with wide rows, which is what a task holds of them at least, to write as to read.
WIDE = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, batches for Python workers are of BATCH and tables are read as READ says; then the session's settings hold again."""
    now = BATCH | READ
    before = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(spark: SparkSession, df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor repeats no earlier step. It goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).options(**READ).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for columns of one's own: _name, with as many more underscores as keep it apart from the columns that are there."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while f"_{n}".lower() in low:
            n = "_" + n
        out.append(f"_{n}")
    return out


#: A key with more than one in so many of all rows is hot; there are at most so many of them, so they may be broadcast.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with side on key; count: how many of all total rows have the key, so that its hot keys need no shuffle of their rows."""
    is_hot = F.col(count) * HOT_KEYS > total
    hot = F.broadcast(side.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti").join(side.where(~is_hot), key, how)
    return rows.join(hot, key).unionByName(rest)


class Bloom:
    """A Bloom filter over 64-bit hashes. Its size is fixed by log2_bits, so it may be broadcast whatever the input."""

    def __init__(self, words: np.ndarray, probes: int = 2):
        self.words, self.probes = words, probes
        self.mask = np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, hashes: DataFrame, column: str, log2_bits: int = 25, probes: int = 2) -> Bloom:
        """Set bits are OR-ed on the executors, one row for each 64-bit word; the driver gets at most 2^(log2_bits - 6) rows."""
        mask = (1 << log2_bits) - 1
        at = hashes.select(F.explode(F.array(F.expr(f"{column} & {mask}L"), F.expr(f"shiftrightunsigned({column}, 32) & {mask}L"))).alias("at") if probes == 2 else F.expr(f"{column} & {mask}L").alias("at"))
        at = at.select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        got = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return cls(words, probes)

    def __contains__(self, _: object) -> bool:
        raise TypeError("use has()")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each uint64 hash: False if it was surely not put in."""
        out = np.ones(len(hashes), bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask)[: self.probes]:
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out
