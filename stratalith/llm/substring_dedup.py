"""Exact repeated passages across documents, found by difference-cover anchors.

A window is WINDOW consecutive words. Short anchors (WINDOW - PERIOD + 1 words) are hashed only at word positions whose
remainder modulo PERIOD lies in a difference cover: whatever the offset of two equal windows, some anchor lies in both at the
same place. So:
0. Of rows with equal texts only the one with the least doc_id goes on: all windows of the others are repeats. Rows whose
   text's hash is in no Bloom filter of the texts found twice are not touched for this.
1. Anchors of all documents (each once a document) are counted by hash, pre-aggregated: those of two documents are shared.
2. Documents are read again; each shared anchor extends to the windows around it, and only these are hashed (64 bits).
   Documents with none are done. Windows and the texts of the others go to a table.
3. Windows are grouped by hash, pre-aggregated to their smallest doc_id; a window of a larger doc_id is a repeat, and its
   words go. A filter of the hashes found twice keeps other windows from being shuffled again for this.
Shared anchors reach the documents as a Bloom filter of bounded size (a false hit costs a window that step 3 finds alone), or
beyond MAX_BLOOM anchors by joins on the anchor and on doc_id.

Nulls: a null text has no words. A row without doc_id has no smaller document and is smaller than none: nothing goes. Rows
that repeat a doc_id are judged alike and never against each other. Empty texts and those of fewer words than a window lose
nothing. Ties: of equal windows only those of the smallest doc_id stay. Long texts are hashed whole, one at a time beyond a
megabyte. A text that more than a thousandth of all rows share finds its least doc_id by broadcast (there are at most a
thousand such texts). Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, released, slices, windows
from .shared import HOT_KEYS, Bloom, table, written

WINDOW, PERIOD = 50, 31
MAX_BLOOM = 16_000_000


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of remainders whose differences give every remainder (found by search; periods to about 40)."""
    size = 1
    while True:
        if size * (size - 1) + 1 >= period:
            stack = [((0,), {0})]
            while stack:
                have, diffs = stack.pop()
                if len(diffs) == period:
                    return have
                left = size - len(have)
                if not left or len(diffs) + 2 * sum(range(len(have), size)) < period:
                    continue
                for x in range(period - 1, have[-1], -1):
                    stack.append(((*have, x), diffs | {(x - y) % period for y in have} | {(y - x) % period for y in have}))
        size += 1


class Anchored:
    """The words of some rows and the places of their anchors."""

    def __init__(self, part: pa.RecordBatch, window: int, period: int):
        self.words = Words(part.column("text"))
        self.hashes = self.words.hashes()
        self.length = window - period + 1
        at = self.words.window_starts(self.length)
        covered = np.zeros(period, bool)
        covered[list(difference_cover(period))] = True
        self.at = at[covered[(at - self.words.first[self.words.row[at]]) % period]]
        self.anchors = windows(self.hashes, self.length, self.at)

    def windows_near(self, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
        """The starts of all windows that hold one of the given anchors (word places) less than a period after their start."""
        words = self.words
        mark = np.zeros(len(words.starts) + 1, np.int64)
        low = np.maximum(anchors - period + 1, words.first[words.row[anchors]])
        np.add.at(mark, low, 1)
        np.add.at(mark, anchors + 1, -1)
        near = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        return near[near + window <= words.first[words.row[near] + 1]]


def without(batch: pa.RecordBatch, twice: Bloom | None, keep: bool = False) -> pa.RecordBatch:
    """The rows whose text is surely not there twice, or with keep the others. A row without text or doc_id is never a copy."""
    if twice is None:
        return batch
    maybe = twice.has(batch.column("_x").to_numpy().view(np.uint64)) & np.array(batch.column("doc_id").is_valid()) & np.array(batch.column("text").is_valid())
    return batch.filter(pa.array(maybe if keep else ~maybe))


def anchor_rows(docs: DataFrame, window: int, period: int, twice: Bloom | None = None) -> DataFrame:
    """h, doc_id, place of every anchor."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(without(batch, sent.value), "text"):
                own = Anchored(part, window, period)
                rows = own.words.row[own.at]
                yield pa.RecordBatch.from_arrays([pa.array(own.anchors.view(np.int64)), part.column("doc_id").take(pa.array(rows)), pa.array(own.at - own.words.first[rows])], ["h", "doc_id", "place"])

    return docs.where("doc_id is not null").mapInArrow(run, "h bigint, doc_id bigint, place bigint")


def anchor_hashes(docs: DataFrame, window: int, period: int, twice: Bloom | None = None) -> DataFrame:
    """h of every anchor, once for each document that has it."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(without(batch, sent.value), "text"):
                own = Anchored(part, window, period)
                rows = own.words.row[own.at]
                order = np.lexsort((own.anchors, rows))
                rows, anchors = rows[order], own.anchors[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64))], ["h"])

    return docs.where("doc_id is not null").mapInArrow(run, "h bigint")


def only(rows: DataFrame, wanted: Bloom) -> DataFrame:
    """The rows whose h the filter has."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column("h").to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


PARTS = "part int, doc_id bigint, t bigint, place bigint, h bigint, n_words bigint, kept_sha256 string, text string"
#: part: a document that is done; a window; the text of a document with windows.
DONE, WINDOW_ROW, TEXT = 0, 1, 2


def parted(docs: DataFrame, window: int, period: int, shared: Bloom | None, twice: Bloom | None = None, repeated: bool = True) -> DataFrame:
    """Rows of the three parts. docs has _anchors (places) where shared is None. t: a hash of the text (0 if no doc_id is repeated), so that rows that repeat one stay apart."""
    sent = docs.sparkSession.sparkContext.broadcast((shared, twice))
    schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[k]) for n, k in (x.split() for x in PARTS.split(", "))])

    def made(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, twice = sent.value
        for batch in batches:
            for part in slices(without(batch, twice), "text"):
                own = Anchored(part, window, period)
                words, ids = own.words, part.column("doc_id")
                known = np.array(ids.is_valid())
                if shared is not None:
                    hit = own.at[shared.has(own.anchors) & known[words.row[own.at]]]
                else:
                    lists = part.column("_anchors")
                    # Rows that repeat a doc_id get each other's places: those beyond a row's words are not its own.
                    hit = np.concatenate([np.zeros(0, np.int64), *(words.first[i] + (p := np.unique(x.values.to_numpy()))[p < words.counts[i]] for i, x in enumerate(lists) if x.is_valid and len(x.values) and known[i])])
                at = own.windows_near(hit, window, period)
                some = np.zeros(words.rows, bool)
                some[words.row[at]] = True
                texts = [words.raw[a:b].tobytes() for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
                t = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "big") if s and repeated else 0 for x, s in zip(texts, some, strict=True)], np.int64)
                done, left = np.flatnonzero(~some), np.flatnonzero(some)
                sums = [hashlib.sha256(b" ".join(texts[i].split())).hexdigest() for i in done]
                yield made(len(done), part=pa.array(np.full(len(done), DONE, np.int32)), doc_id=ids.take(pa.array(done)), n_words=pa.array(words.counts[done]), kept_sha256=pa.array(sums, pa.string()))
                if len(left):
                    rows = words.row[at]
                    yield made(len(left), part=pa.array(np.full(len(left), TEXT, np.int32)), doc_id=ids.take(pa.array(left)), t=pa.array(t[left]), text=part.column("text").take(pa.array(left)))
                    yield made(
                        len(at),
                        part=pa.array(np.full(len(at), WINDOW_ROW, np.int32)),
                        doc_id=ids.take(pa.array(rows)),
                        t=pa.array(t[rows]),
                        place=pa.array(at - words.first[rows]),
                        h=pa.array(windows(own.hashes, window, at).view(np.int64)),
                    )

    return docs.mapInArrow(run, PARTS)


FOUND = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def cut(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """texts (doc_id, text, places of repeated windows) without the words of these windows."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sums, kept = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words = (text.as_py() or "").encode().split()
                stays = np.ones(len(words), bool)
                if places.is_valid:
                    mark = np.zeros(len(words) + 1, np.int64)
                    starts = places.values.to_numpy()
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    stays = np.cumsum(mark[:-1]) == 0
                left = b" ".join(w for w, s in zip(words, stays, strict=True) if s)
                n_words.append(len(words))
                n_removed.append(int(len(words) - stays.sum()))
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names + ["kept"] * with_text)

    return texts.select("doc_id", "text", "places").mapInArrow(run, FOUND + ", kept string" * with_text)


def copies_apart(docs: DataFrame) -> tuple[DataFrame, Bloom, DataFrame]:
    """docs with _x (a hash of the text), the filter of texts that are there twice, and the rows that it has, with the least doc_id of their text."""
    spark = docs.sparkSession
    own = docs.withColumn("_x", F.xxhash64("text"))
    keyed = own.select("doc_id", "_x", F.md5(F.col("text").cast("binary")).alias("_key"))
    twice = keyed.where("doc_id is not null and _key is not null").groupBy("_key").agg(F.min("doc_id").alias("least"), F.first("_x").alias("_x"), F.count("*").alias("c")).where("c > 1")
    twice = written(spark, twice, "copied-texts")
    found = Bloom.of(twice, "_x", min(27, max(16, (16 * twice.count()).bit_length())))
    sent = spark.sparkContext.broadcast(found)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield without(batch, sent.value, keep=True)

    maybe = own.mapInArrow(run, own.schema).withColumn("_key", F.md5(F.col("text").cast("binary")))
    is_hot = F.col("c") * HOT_KEYS > docs.count()
    hot = maybe.join(F.broadcast(twice.where(is_hot).select("_key", F.col("least").alias("_hot"))), "_key", "left")
    hot = hot.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))))
    least = hot.join(twice.where(~is_hot).select("_key", "least", F.lit(0).cast("bigint").alias("_salt")), ["_key", "_salt"], "left")
    least = least.select("doc_id", "text", F.coalesce("_hot", "least", "doc_id").alias("least"))
    return own, found, written(spark, least, "copies")


def dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, with_text: bool = False, max_bloom: int = MAX_BLOOM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, for documents that lose some)."""
    spark = docs.sparkSession
    slim, twice, maybe = copies_apart(docs.select("doc_id", "text"))
    firsts = maybe.where("doc_id = least").select("doc_id", "text")
    repeated = not slim.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    counts = anchor_hashes(slim, window, period, twice).unionByName(anchor_hashes(firsts, window, period)).groupBy("h").agg(F.count("*").alias("c"))
    shared = written(spark, counts.where("c > 1").select("h"), "anchors")
    n = shared.count()
    if n <= max_bloom:
        known = Bloom.of(shared, "h", min(27, max(16, (8 * n).bit_length())))
        found = parted(slim, window, period, known, twice, repeated).unionByName(parted(firsts, window, period, known, None, repeated))
    else:
        rows = anchor_rows(slim, window, period, twice).unionByName(anchor_rows(firsts, window, period))
        places = rows.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("_anchors"))
        found = parted(slim.join(places, "doc_id", "left"), window, period, None, twice).unionByName(parted(firsts.join(places, "doc_id", "left"), window, period, None))
    found = written(spark, found, "windows")
    own = found.where(f"part = {WINDOW_ROW}").select("h", "doc_id", "t", "place")
    first = written(spark, own.groupBy("h").agg(F.min("doc_id").alias("low"), F.count("*").alias("c")).where("c > 1").select("h", "low"), "shared-windows")
    wanted = Bloom.of(first, "h", min(27, max(16, (8 * first.count()).bit_length())), 1)
    repeats = only(own, wanted).join(first, "h").where("doc_id > low").groupBy("doc_id", "t").agg(F.collect_set("place").alias("places"))
    texts = found.where(f"part = {TEXT}").select("doc_id", "t", "text")
    rest = cut(texts.join(repeats, ["doc_id", "t"], "left"), window, with_text)
    more = [F.lit(None).cast("string").alias("kept")] * with_text
    done = found.where(f"part = {DONE}").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", *more)
    # A copy loses all its words, or if it has no window, none.
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    whole = maybe.where("doc_id > least").select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("all"))
    gone = F.col("n_words") >= window
    kept = F.when(gone, "").otherwise(F.col("all"))
    copies = whole.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("bigint").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), *[kept.alias("kept")] * with_text)
    return done.unionByName(rest).unionByName(copies)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
