"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells; each shard owns the arcs that end at its virtual nodes. A key's cell is a hash of its id. A shard
holds at most its share of the rows (counts differ by one at most); what overflows a full shard goes on clockwise to the
next arc whose shard has room. How much flows where is decided on the counts of the arcs (shards * virtual nodes numbers,
however many rows there are); which rows flow, and each row's slot, follows from its rank in its arc.

Rows equal in doc_id, CRC and size are one group with a count, pre-aggregated, which takes as many slots; a large group is dealt
out in pieces of PIECE rows, so that an id which a third of all rows share lies in no single task.

Nulls: a null text has no bytes and CRC 0; a row without an id hashes by its text. Repeated rows are placed one by one. Ties:
keys with one hash are ranked by doc_id, CRC and size. Of long texts only length and CRC are taken. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

CELLS, PIECE = 65536, 65536


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; two of one cell: the smaller shard first."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) * 2654435761 % 2**32 * CELLS >> 32, s) for s in range(shards) for v in range(nodes))


def arcs(points: list[tuple[int, int]]) -> list[int]:
    """For every cell the arc (index of a point) that it lies in: the next point clockwise."""
    out, k = [], 0
    for cell in range(CELLS):
        while k < len(points) and points[k][0] < cell:
            k += 1
        out.append(k % len(points))
    return out


def flow(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot) of every run of rows that stays together."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs, over = [], []
    for arc, (_, s) in enumerate(points):
        stay = min(counts.get(arc, 0), room[s] - used[s])
        if stay:
            runs.append((arc, 0, s, used[s]))
            used[s] += stay
        if counts.get(arc, 0) > stay:
            over.append([arc, stay, counts[arc] - stay])
    waiting: list[list[int]] = []
    by_arc = {x[0]: x for x in over}
    for step in range(2 * len(points)):  # two rounds: each passes every shard
        arc = step % len(points)
        if step < len(points) and arc in by_arc:
            waiting.append(by_arc[arc])
        s = points[arc][1]
        while waiting and used[s] < room[s]:
            item = waiting[0]
            n = min(item[2], room[s] - used[s])
            runs.append((item[0], item[1], s, used[s]))
            used[s] += n
            item[1] += n
            item[2] -= n
            if not item[2]:
                waiting.pop(0)
    return runs


def shard(docs: DataFrame, shards: int = 24, nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: the law is not 'key')."""
    spark = docs.sparkSession
    points = ring(shards, nodes)
    arc_of = F.split(F.lit(",".join(map(str, arcs(points)))), ",").cast("array<int>")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
        key.alias("key"),
    )
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("arc", F.element_at(arc_of, (F.pmod("key", F.lit(CELLS)) + 1).cast("int")))
    groups = written(spark, groups, "ring")
    counts = {r["arc"]: r["n"] for r in groups.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * nodes rows at most
    runs = [dict(zip(("arc", "low", "shard", "base"), r, strict=True)) for r in flow(points, counts, shards)]
    by_arc: dict[int, list[dict]] = {}
    for r in sorted(runs, key=lambda r: (r["arc"], r["low"])):
        if r["arc"] in by_arc:
            by_arc[r["arc"]][-1]["high"] = r["low"]
        by_arc.setdefault(r["arc"], []).append(r)
    kind = "array<struct<arc int, low bigint, high bigint, shard int, base bigint>>"
    placed = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), kind)))
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1))
    pieces = groups.withColumn("rank", F.coalesce(before, F.lit(0))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE).cast("bigint"))))
    pieces = pieces.repartition("key", "piece")
    each = pieces.withColumn("at", F.explode(F.sequence(F.col("rank") + F.col("piece"), F.col("rank") + F.least(F.col("n"), F.col("piece") + PIECE) - 1)))
    at = F.col("at")
    both = each.join(F.broadcast(placed), "arc").where((at >= F.col("low")) & (F.col("high").isNull() | (at < F.col("high"))))  # at most shards * nodes + 2 * shards runs
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + at - F.col("low")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
