"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items, as normalised words, go into one automaton. The words of a document are streamed through it, tracking the longest
suffix that occurs in some item: where it reaches the window's length, its words are hit; an item shorter than a window is
found when it is itself a suffix of the match. Only runs of words whose neighbouring pairs all occur in items are walked (no
other place can hold a match); the pairs are found by numpy over whole batches. Documents are read once, without a shuffle.

The items are taken in blocks of a fixed number of bytes. Each block's automaton is built once, on the driver, and broadcast as
arrays; a worker keeps it from task to task. PASS_BLOCKS blocks are searched in one pass over the documents, in one function;
what a pass found is written before the next one, so no more than that lies in memory however many items there are.

Nulls: a null text has no words; a null item is no window; an item without an id counts as a window but not as an item.
Equal items each count. Repeated rows are judged alike, one by one. Ties: overlapping hits are merged. Long texts are streamed
whole. Empty tables: no documents give no rows, no items give no hits. Extra columns are ignored (but kept by remove(),
whatever their names).
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, Words, released, slices
from .shared import fresh, table, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 1 << 20
PASS_BLOCKS = 8


class Automaton:
    """Of all substrings of the items; state 0 is the empty one."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        texts = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in WORD.findall((text or "").encode().lower())]
            if ids:
                texts.append((item, ids))
        self.link, self.length = [-1], [0]
        self.next: list[dict[int, int]] = [{}]
        for _, ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # Of each state: the items that hold its windows, and the short items that end there.
        self.items: list[set[str]] = [set() for _ in self.link]
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in self.link]
        for item, ids in texts:
            state, seen = 0, set()
            for c in ids:
                state = self.next[state][c]
                s = state
                while s and self.length[s] >= window and s not in seen:
                    seen.add(s)
                    if item is not None:
                        self.items[s].add(item)
                    s = self.link[s]
            if len(ids) < window:
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.short[state].append((len(ids), item))
        self.above = [0] * len(self.link)  # the next state up the links with a short item
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.above[s] = up if self.short[up] else self.above[up]
        self.least = min([window, *(len(ids) for _, ids in texts)])
        vocabulary = sorted(self.words, key=self.words.__getitem__)
        own = Words(pa.array([b"\n".join(vocabulary).decode("utf-8", "surrogateescape")] if vocabulary else [""], pa.string()), NOT_ALNUM)
        hashes = own.hashes()
        order = np.argsort(hashes)
        self.sorted, self.id_of = hashes[order], order.astype(np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        pairs = {a * len(vocabulary) + b for _, ids in texts for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.vocabulary = vocabulary
        # As arrays: transitions sorted by state and word.
        self.keys = array("q", [s << 32 | c for s, edges in enumerate(self.next) for c in sorted(edges)])
        self.targets = array("q", [edges[c] for edges in self.next for c in sorted(edges)])
        del self.next
        self.link, self.length, self.above = array("q", self.link), array("q", self.length), array("q", self.above)
        self.items = {s: x for s, x in enumerate(self.items) if x}
        self.short = {s: x for s, x in enumerate(self.short) if x}

    def to(self, state: int, c: int) -> int:
        """The state after word c, or -1."""
        key = state << 32 | c
        at = bisect_left(self.keys, key) if c >= 0 else len(self.keys)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(self.link)
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.link)
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Of each word its number in the items, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.sorted):
            some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
            same = self.sorted[at] == hashes[some]
            out[some[same]] = self.id_of[at[same]]
        return out

    def runs(self, words: Words, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """The stretches of words of one document that can hold a match."""
        known = ids >= 0
        if not known.any():
            return
        join = np.zeros(len(ids), bool)  # word i goes on to i + 1
        near = np.flatnonzero(known[:-1] & known[1:] & (words.row[:-1] == words.row[1:]))
        if len(near) and len(self.pairs):
            key = ids[near] * len(self.vocabulary) + ids[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            join[near[self.pairs[at] == key]] = True
        begins = np.flatnonzero(known & ~np.concatenate(([False], join[:-1])))
        ends = np.flatnonzero(known & ~join) + 1
        long = ends - begins >= self.least
        yield from zip(begins[long].tolist(), ends[long].tolist())

    def walk(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit spans of a run, and the items with a window in it."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = n = 0
        for i, c in enumerate(ids):
            on = self.to(state, c)
            while state and on < 0:
                state = self.link[state]
                n = self.length[state]
                on = self.to(state, c)
            if on >= 0:
                state, n = on, n + 1
            if n >= self.window:
                spans.append((i + 1 - n, i + 1))
                s = state
                while self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                found |= self.items.get(s, set())
            s = state if state in self.short else self.above[state]
            while s:
                for m, item in self.short[s]:
                    if m <= n:
                        spans.append((i + 1 - m, i + 1))
                        if item is not None:
                            found.add(item)
                s = self.above[s]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(items: DataFrame, window: int, limit: int = BLOCK_BYTES) -> Iterator[Automaton]:
    """Automata of blocks of at most about limit bytes of items, an item longer than that alone; one block is on the driver at a time."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Automaton([(r["item_id"], r["text"]) for r in rows], window)


SPANS = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint>>"


def spans(docs: DataFrame, items: DataFrame, window: int = 10, names: tuple[str, str, str] = ("_words", "_hits", "_items")) -> DataFrame:
    """docs with, in columns of these names, the number of words, the spans of hit words (first, last + 1, and their bytes) and the ids of the items."""
    spark = docs.sparkSession
    out = docs.withColumns(dict(zip(names, (F.lit(None).cast("bigint"), F.lit(None).cast(SPANS), F.lit(None).cast("array<string>")), strict=True)))

    def searched_for(out: DataFrame, sent: list) -> DataFrame:
        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    words = Words(part.column("text"), NOT_ALNUM, lower=True)
                    hashes = words.hashes()
                    for block in sent:
                        part = searched(part, words, hashes, block.value, names)
                    yield part

        return out.mapInArrow(run, out.schema)

    sent: list = []
    for automaton in blocks(items, window):
        if len(sent) == PASS_BLOCKS:
            out = written(spark, searched_for(out, sent), "benchmark-hits")
            for block in sent:
                block.unpersist()
            sent = []
        sent.append(spark.sparkContext.broadcast(automaton))
    return searched_for(out, sent)


def searched(part: pa.RecordBatch, words: Words, hashes: np.ndarray, automaton: Automaton, names: tuple[str, str, str]) -> pa.RecordBatch:
    n_words, n_hits, n_items = names
    ids = automaton.ids(hashes)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for a, b in automaton.runs(words, ids):
        own = ids[a:b].tolist()
        if any(words.data[words.starts[a + i] : words.ends[a + i]].tobytes() != automaton.vocabulary[c] for i, c in enumerate(own)):
            own = [automaton.words.get(words.data[words.starts[i] : words.ends[i]].tobytes(), -1) for i in range(a, b)]  # hashes that collide
        got, found = automaton.walk(own)
        if got:
            row = int(words.row[a])
            at = a - int(words.first[row])
            hits.setdefault(row, []).extend((at + x, at + y) for x, y in got)
            items.setdefault(row, set()).update(found)
    all_hits, all_items = [], []
    for row, (old, old_items) in enumerate(zip(part.column(n_hits), part.column(n_items), strict=True)):
        before = [(h["start"], h["end"]) for h in old.as_py()] if old.is_valid else []
        all_items.append(sorted(items.get(row, set()) | set(old_items.as_py() if old_items.is_valid else [])))
        if row not in hits:
            all_hits.append(old.as_py() if old.is_valid else [])
            continue
        w, base = int(words.first[row]), int(words.at[row])
        all_hits.append([{"start": a, "end": b, "from": int(words.starts[w + a]) - base, "to": int(words.ends[w + b - 1]) - base} for a, b in merged(before + hits[row])])
    put = {n_words: pa.array(words.counts), n_hits: pa.array(all_hits, part.schema.field(n_hits).type), n_items: pa.array(all_items, part.schema.field(n_items).type)}
    return pa.RecordBatch.from_arrays([put.get(n, part.column(n)) for n in part.schema.names], schema=part.schema)


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return spans(docs.select("doc_id", "text"), items, window).select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without those of which more than max_coverage is hit; in the others each hit span becomes a line break."""
    names = n_words, n_hits, _ = tuple(fresh(docs.columns, "words", "hits", "items"))
    hit = F.aggregate(n_hits, F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    found = spans(docs, items, window, names).where(hit <= max_coverage * F.col(n_words))
    data = F.col("text").cast("binary")
    # The bytes between the hits: from the end of each to the start of the next.
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(n_hits, lambda x: x["to"]))
    starts = F.concat(F.transform(n_hits, lambda x: x["from"]), F.array(F.octet_length("text").cast("bigint")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(data, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"))
    return found.withColumn("text", F.when(F.size(n_hits) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
