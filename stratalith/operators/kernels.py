"""The operators on single columns, as functions of frames: scans, top-k, distinct, counts by key, equi-joins, numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def scan(df: DataFrame, column: str, op: str, value: int) -> DataFrame:
    """Rows whose Int64 column compares as asked; nulls never do."""
    return df.where(X.compare(op, F.col(column), F.lit(value)))


def scan_null(df: DataFrame, column: str, negated: bool = False) -> DataFrame:
    return df.where(F.col(column).isNotNull() if negated else F.col(column).isNull())


def top_k(df: DataFrame, column: str, k: int, descending: bool = False, nulls_first: bool = True, tie: str | None = None) -> DataFrame:
    """The first k rows by a column with nulls where asked; ties by another column."""
    c = F.col(column)
    key = (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last())
    return df.orderBy(key, *([F.col(tie)] if tie else [])).limit(k)


def distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null first, then ascending."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())


def grouped_count(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """(key, count), the null key first, then ascending."""
    out = df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("key").asc_nulls_first()) if ordered else out


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """All pairs with equal keys; null keys meet nothing. how: inner, or left, which keeps each left row without a partner once.

    The planner picks broadcast by the size of a side, and splits skewed keys of a sort-merge join at run time.
    """
    return left.join(right, left[left_key] == right[right_key], how)


def numbered(df: DataFrame, keys: list[Column], write: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """Rows numbered from 1 by keys (without keys, in the order they come), without sorting them all in one task.

    Rows are dealt to partitions by ranges of the keys and sorted there; a key that many rows share is split if a later key tells
    them apart. The sorted rows are written once with their places, so places and counts belong to one and the same deal. Each
    partition's numbers start after the rows of those before it, whose counts (one number each) are collected.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    kept = write(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = sorted(tuple(r) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    before = kept.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    joined = kept.join(F.broadcast(before), part == F.col("__part"))  # a row for each partition
    return joined.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__start")
