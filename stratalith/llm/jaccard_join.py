"""Similarity join of documents on sets of word n-grams (Jaccard), size-aware: small sets by subsets, large ones by lists.

The texts are read once: the sets of all rows (sorted 64-bit hashes of n-grams) go to a table, which every later step reads.
Equal sets are one class; only classes are joined. All tokens have one global order: tokens in few documents come first, then
those in up to four times as many, and so on, by hash within each step. Two sets whose overlap is at least o share j of their first |x| - o + j tokens. So
- small sets enumerate all two-token subsets of their prefix (j = 2), which meet others only in near copies;
- large sets put the tokens of their prefix (j = SHARED) on inverted lists. Pairs with a large set are found there (a small
  set that is large enough to pair with one is on the lists too).
The boundary is the size up to which subsets cost less: rows to enumerate against list entries to write and scan, whose mean
length is measured. On a list of few classes, pairs whose sizes fit are counted, and those with enough common entries are
candidates. A longer list (of a large group of near copies: there nearly all tokens are in many documents) makes each of its
members a candidate with the list's least class. Few is what makes a token common in the order too, so a long list comes only
from sets that have no rarer tokens to offer. Connected candidates form a group; a large group is split into blocks. In a
block, with HUBS sets of its group (the same in all blocks), overlaps are counted exactly; then the sets outside of the group's
largest component so far, and only these, meet all blocks, as the others are connected whatever else they are linked to. So a
group of near copies costs about its size, and only one of sets that meet but are not linked the square of these. Only a spanning
forest of the links comes out. Components of that forest, with the classes expanded, are the result. Nothing is dropped or capped: an order or a boundary that is badly chosen costs time, not
links. The common tokens are sent as Bloom filters, one for each step (a false hit is a token that comes later, everywhere alike); beyond
2^MAX_BITS / 8 of them the least count that makes a token common, and a list long, is raised.

Hashes: tokens, classes and lists are 64-bit hashes. Nulls: a null text, like one without words, has no set and no links. A
row without doc_id links like others but names no component. Repeated rows are copies, whether with one doc_id or several. Long
texts are hashed whole, in slices of about a megabyte of other rows or alone. Ties: of a component's rows the least doc_id
names it. Empty table: empty result. Extra columns are ignored by join() and kept by keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import Words, mixed, released, slices, windows
from .shared import WIDE, Bloom, forget, fresh, spread_join, table, written

SHINGLE, PERCENT = 3, 90
#: Common tokens of the prefixes of large sets.
SHARED = 4
#: A token in more documents than this comes last in the order; on lists of at most so many, pairs are formed.
HEAVY = 16
#: A block holds about so many tokens and sets; groups of more than two blocks are split, and all blocks get so many sets as hubs.
GROUP_TOKENS, GROUP_SETS, HUBS = 1_500_000, 8_000, 4
#: Rounds of counting tokens, at most.
ROUNDS = 2
#: What an entry of a list costs, in rows of subsets.
ENTRY_COST = 1.0
MAX_BITS = 28


def overlap(n: int, m: int, percent: int) -> int:
    """The least overlap of linked sets of these sizes: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int, shared: int = 1) -> int:
    """How many first tokens of a set of n hold so many tokens of any set linked to it."""
    return min(n, n - overlap(n, -(-percent * n // 100), percent) + shared)


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n can be linked to a different set."""
    return any(overlap(n, m, percent) <= min(n, m) for m in range(n + 1, n * 100 // percent + 2)) or any(
        overlap(n, m, percent) <= m for m in range(-(-percent * n // 100), n)
    ) or overlap(n, n, percent) < n


def token_sets(column, n: int) -> tuple[list[np.ndarray], Words]:
    """The sorted distinct tokens of each row."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at = words.window_starts(n)
    tokens = windows(hashes, n, at)
    counts = np.bincount(words.row[at], minlength=words.rows)
    ends = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for i in range(words.rows):
        if counts[i]:
            out.append(np.unique(tokens[ends[i] : ends[i + 1]]))
        elif c := int(words.counts[i]):
            out.append(windows(hashes[words.first[i] : words.first[i] + c], c, np.zeros(1, np.int64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, words


def class_of(tokens: np.ndarray) -> int:
    total = np.add.reduce(mixed(tokens), keepdims=True) + np.array([len(tokens)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(total).view(np.int64)[0])


SETS = "doc_id bigint, mark bigint, row bigint, n bigint, k bigint, tokens binary"


def row_mark() -> object:
    """A hash that tells rows of different doc_id or text apart."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def all_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, mark, row (a number of its own), n (size of the set), k (its class), tokens of every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                sets, _ = token_sets(part.column("text"), n)
                columns = [pa.array(np.arange(row, row + len(sets))), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                row += len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], [x.split()[0] for x in SETS.split(", ")])

    return docs.select("doc_id", "text", row_mark().alias("mark")).mapInArrow(run, SETS)


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of the table of sets in runs of about a megabyte, with their tokens."""
    for batch in batches:
        sizes = np.cumsum([0, *batch.column("n").to_pylist()])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + (1 << 17), side="right")) - 1)
            part = batch.slice(i, j - i)
            yield part, [np.frombuffer(t.as_buffer(), np.uint64) for t in part.column("tokens")]
            i = j


class Plan:
    """How lists are made: percent, common tokens by steps, from how many classes on a list is long, and the largest small set."""

    def __init__(self, percent: int, heavy: list[Bloom], few: int, boundary: int):
        self.percent, self.heavy, self.few, self.boundary = percent, heavy, few, boundary
        self.least_on_lists = -(-percent * (boundary + 1) // 100)
        self.linking: dict[int, bool] = {}

    def links(self, n: int) -> bool:
        if n not in self.linking:
            self.linking[n] = can_link(n, self.percent) if n * (100 - self.percent) < 200 * 100 else True
        return self.linking[n]

    def ordered(self, tokens: np.ndarray, size: int) -> np.ndarray:
        """The first tokens of the set in the global order."""
        level, at = np.zeros(len(tokens), np.int8), np.arange(len(tokens))
        for more in self.heavy:
            at = at[more.has(tokens[at])]
            level[at] += 1
        return tokens[np.argsort(level, kind="stable")[:size]]

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """The lists that a set is on: subsets of its prefix, then tokens; how many are subsets."""
        n = len(tokens)
        if not n or not self.links(n):
            return np.zeros(0, np.uint64), 0
        out, subsets = [], 0
        if n <= self.boundary:
            first = self.ordered(tokens, prefix(n, self.percent, 2))
            i, j = np.triu_indices(len(first), 1)
            a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            out.append(mixed(a * np.uint64(3) + mixed(b)))
            subsets = len(i)
        if n >= self.least_on_lists:
            out.append(mixed(self.ordered(tokens, prefix(n, self.percent, SHARED)) + np.uint64(1)))
        return np.concatenate(out), subsets


def prefix_tokens(sets: DataFrame, percent: int, order: Plan, before: Plan | None) -> DataFrame:
    """token: the first tokens by an order, a quarter more than a prefix has, without those that came first by the order before."""
    sent = sets.sparkSession.sparkContext.broadcast((order, before))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, before = sent.value
        for _, own in read_sets(batches):
            some = []
            for s in own:
                size = prefix(len(s), percent, SHARED) * 5 // 4
                first = order.ordered(s, size)
                some.append(first if before is None else first[~np.isin(first, before.ordered(s, size))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], ["token"])

    return sets.select("n", "tokens").mapInArrow(run, "token bigint")


def planned(sets: DataFrame, percent: int) -> Plan:
    """Common tokens, and the boundary from the mean length of the lists.

    Tokens are counted over all documents whose prefix they are in. Where common ones go to the end of the order, others come
    into the prefixes, which are counted next, until a round finds few that are common. Rounds beyond save time, not links.
    """
    spark = sets.sparkSession
    order, before, counts, known = Plan(percent, [], HEAVY, 0), None, None, 0
    for _ in range(ROUNDS):
        new = prefix_tokens(sets, percent, order, before).groupBy("token").agg(F.count("*").alias("c"))
        old = counts
        if old is not None:
            new = new.unionByName(old).groupBy("token").agg(F.sum("c").alias("c"))
        counts = written(spark, new.where(F.col("c") > 1), "tokens")  # a token in one document makes no list
        if old is not None:
            forget(old)
        total = counts.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("c") <= HEAVY, F.col("c") * F.col("c"))).alias("scans"), *[F.sum((F.col("c") > HEAVY * 4**i).cast("bigint")).alias(f"over{i}") for i in range(20)]).first()
        level = next(i for i in range(20) if 8 * (total[f"over{i}"] or 0) <= 1 << MAX_BITS or i == 19)
        few, found = HEAVY * 4**level, total[f"over{level}"] or 0
        order, before = Plan(percent, [bloom(counts.where(F.col("c") > HEAVY * 4**i), "token") for i in range(level, 20) if total[f"over{i}"]], few, 0), order
        if found <= known * 1.01:
            break
        known = found
    heavy = order.heavy
    mean = (total["scans"] or 0) / max(1, total["all"] or 0)
    boundary = 0
    while True:
        pairs, entries = prefix(boundary + 1, percent, 2), prefix(boundary + 1, percent, SHARED)
        if pairs * (pairs - 1) / 2 > entries * (1 + mean) * ENTRY_COST:
            return Plan(percent, heavy, few, boundary)
        boundary += 1


def listed(sets: DataFrame, plan: Plan, wanted: Bloom | None) -> DataFrame:
    """list, k, n, w of every entry of the lists, or of those that the filter has; w: for how many common entries it stands."""
    sent = sets.sparkSession.sparkContext.broadcast((plan, wanted))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, wanted = sent.value
        for part, own in read_sets(batches):
            keys = [plan.keys(s) for s in own]
            sizes = np.array([len(x) for x, _ in keys])
            out = np.concatenate([x for x, _ in keys])
            row = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            w = np.where(place < np.array([c for _, c in keys], np.int64)[row], SHARED, 1)
            if wanted is not None:
                some = wanted.has(out)
                out, row, w = out[some], row[some], w[some]
            k, n = part.column("k").to_numpy(), part.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(k[row]), pa.array(n[row]), pa.array(w)], ["list", "k", "n", "w"])

    return sets.select("n", "k", "tokens").mapInArrow(run, "list bigint, k bigint, n bigint, w bigint")


def bloom(keys: DataFrame, column: str) -> Bloom:
    return Bloom.of(keys, column, min(MAX_BITS, max(16, (8 * keys.count()).bit_length())))


def only_rows(sets: DataFrame, wanted: Bloom) -> DataFrame:
    """k, row, tokens of the rows whose hashed number the filter has."""
    sent = sets.sparkSession.sparkContext.broadcast(wanted)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column("id").to_numpy().view(np.uint64)))).drop_columns(["id"])

    return sets.select("k", "row", "tokens", F.xxhash64("row").alias("id")).mapInArrow(run, "k bigint, row bigint, tokens binary")


def forest(sets: list[np.ndarray], percent: int, dense: int = 12_000_000) -> np.ndarray:
    """Of each set the first set of its component, by links among these sets.

    The overlaps of a set with all others are counted, set by set; only sets that lie in the component which is largest by then
    may be left out at the end, as all links of the others are known and theirs among themselves change nothing. So a group of
    near copies of one set costs one row of overlaps, and one more for each set that is not linked to it.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.arange(m)
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    common = counts > 1
    number = np.cumsum(common) - 1
    keep = common[inverse]
    cols, rows = number[inverse[keep]], owner[keep]
    width = int(common.sum())
    if not width:
        return label

    def linked(i: int, both: np.ndarray) -> None:
        nonlocal label
        js = np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & (label != label[i]) & (both > 0))
        if len(js):
            every = np.unique(np.append(label[js], label[i]))
            label = np.where(np.isin(label, every[1:]), every[0], label)

    matrix, lists, ends, begins = None, None, None, None
    if m * width <= dense:
        matrix = np.zeros((m, width), np.float32)
        matrix[rows, cols] = 1
    else:  # add up the lists of each set's tokens
        order = np.argsort(cols, kind="stable")
        lists, ends = rows[order], np.concatenate(([0], np.cumsum(np.bincount(cols, minlength=width))))
        begins = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=m))))
    done, most, step = np.zeros(m, bool), max(1, 2_000_000 // m), 1
    while True:
        largest = np.bincount(label, minlength=m).argmax()
        left = np.flatnonzero(~done & (label != largest))[:step]
        if not len(left):
            return label
        if matrix is not None:
            for i, both in zip(left, (matrix[left] @ matrix.T).astype(np.int64), strict=True):
                linked(i, both)
        else:
            for i in left:
                at = cols[begins[i] : begins[i + 1]]
                linked(i, np.bincount(np.concatenate([lists[ends[c] : ends[c + 1]] for c in at]) if len(at) else at, minlength=m))
        done[left] = True
        step = min(most, 2 * step)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: classes; a forest with the components of all links between different sets."""
    spark = sets.sparkSession
    plan = planned(sets, percent)
    # Lists that more than one class is on.
    counted = listed(sets, plan, None).groupBy("list").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("list")
    counted = written(spark, counted, "lists")
    rows = listed(sets, plan, bloom(counted, "list")).groupBy("list", "k").agg(F.first("n").alias("n"), F.first("w").alias("w"))
    entries = written(spark, rows, "entries")
    lists = entries.groupBy("list").agg(F.count("*").alias("c"), F.min("k").alias("pivot")).where("c > 1")
    rows = written(spark, entries.join(lists, "list"), "shared-entries")
    forget(counted, entries)
    # A short list is one small array; its pairs are formed there.
    few = rows.where(F.col("c") <= plan.few).groupBy("list").agg(F.collect_list(F.struct("k", "n", "w")).alias("on"))
    fits = f"x.k < y.k and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    met = F.expr(f"flatten(transform(`on`, x -> transform(filter(`on`, y -> {fits}), y -> struct(x.k as k, y.k as k2, x.n as n, y.n as n2, x.w as w))))")
    pairs = few.select(F.inline(met)).groupBy("k", "k2").agg(F.sum("w").alias("common"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    pairs = pairs.where(F.expr(f"common >= least({SHARED}, ({percent} * (n + n2) + {99 + percent}) div {100 + percent})"))
    stars = rows.where((F.col("c") > plan.few) & (F.col("k") != F.col("pivot"))).select(F.col("k").alias("a"), F.col("pivot").alias("b"))
    groups = components(pairs.select(F.col("k").alias("a"), F.col("k2").alias("b")).unionByName(stars)).select(F.col("component").alias("pivot"), F.col("node").alias("k"))
    firsts = sets.where("n > 0").groupBy("k").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    members = written(spark, groups.join(firsts, "k"), "members")
    weights = members.groupBy("pivot").agg(
        F.greatest(F.ceil(F.sum("n") / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_SETS)).cast("bigint").alias("blocks"),
        *[f(F.struct(F.xxhash64("k", F.lit(i)), "k", "row")).alias(f"hub{i}{f.__name__}") for i in range(HUBS // 2) for f in (F.min, F.max)],
    )
    size = F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")).cast("bigint")
    weights = weights.withColumn("blocks", size)
    dealt = written(spark, members.join(weights.select("pivot", "blocks"), "pivot").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))), "dealt")
    wanted = bloom(members.select(F.xxhash64("row").alias("id")).distinct(), "id")
    chosen = written(spark, only_rows(sets, wanted), "chosen", WIDE)  # and a few others, which no group asks for
    # Each block alone, and with the hubs of its group where that has more blocks.
    hubs = weights.where("blocks > 1").select("pivot", "blocks", F.explode(F.array(*[c for c in weights.columns if c.startswith("hub")])).alias("hub"))
    hubs = hubs.select("pivot", "hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    first = dealt.select("pivot", "block", "k", "row").unionByName(hubs.select("pivot", "block", F.col("hub.k").alias("k"), F.col("hub.row").alias("row"))).distinct()
    found = written(spark, linked_within(first, ["pivot", "block"], chosen, percent), "block-links")
    large = dealt.where("blocks > 1").drop("n")
    if large.isEmpty():
        return found
    # Of a large group the sets outside its largest component meet every block.
    parts = components(found)
    owned = large.join(parts, large["k"] == parts["node"], "left").select("pivot", "blocks", "block", "k", "row", F.coalesce("component", "k").alias("part"))
    owned = written(spark, owned, "large-groups")
    largest = owned.groupBy("pivot", "part").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max(F.struct("c", "part")).alias("x"))
    rest = owned.join(largest.select("pivot", F.col("x.part").alias("most")), "pivot").where("part <> most").select("pivot", "blocks", "k", "row")
    sizes = rest.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP_SETS).cast("bigint").alias("others"))
    rest = rest.join(sizes, "pivot").select("pivot", "k", "row", F.pmod(F.xxhash64("k"), F.col("others")).alias("other"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    every = owned.join(sizes, "pivot").select("pivot", "k", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("other"), "block")
    return found.unionByName(linked_within(rest.unionByName(every).distinct(), ["pivot", "other", "block"], chosen, percent))


def linked_within(dealt: DataFrame, keys: list[str], chosen: DataFrame, percent: int) -> DataFrame:
    """a, b: a forest with the components of all links inside each of the groups that sets (k, row) were dealt to."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        k = group["k"].to_numpy()
        label = forest([np.frombuffer(t.as_buffer(), np.uint64) for t in group["tokens"]], percent) if len(k) > 1 else np.arange(len(k))
        other = np.flatnonzero(label != np.arange(len(k)))
        return pa.table({"a": pa.array(k[other]), "b": pa.array(k[label[other]])})

    return dealt.join(chosen, ["k", "row"]).groupBy(*keys).applyInArrow(run, "a bigint, b bigint")


def placed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, component_id, mark, k (class), part (component, by its classes) of every row, and the written sets that this reads."""
    if percent <= 50:
        raise ValueError("percent must be above 50")
    spark = docs.sparkSession
    sets = written(spark, all_sets(docs, n), "sets", WIDE)
    keys = sets.drop("tokens", "row")
    own = written(spark, keys.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    nodes = components(links(sets, percent))
    # The classes with links, each with the least doc_id of its component; others are a component alone.
    with_links = nodes.join(own, F.col("node") == F.col("k")).select("k", "component", "first")
    least = with_links.groupBy("component").agg(F.min("first").alias("least"))
    far = with_links.join(least, "component").select("k", "component", "least")
    ends = written(spark, own.join(far, "k", "left").select("k", "copies", F.coalesce("least", "first").alias("least"), F.coalesce("component", "k").alias("part")), "ends")
    found = spread_join(keys.where("n > 0"), ends, "k", "copies", keys.count(), "inner").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "mark", "k", "part")
    alone = keys.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "mark", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("part"))
    return found.unionByName(alone), sets


def join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return placed(docs, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, of rows that share it one of the least class; a row
    without doc_id only where the component has no other. Of rows equal in doc_id and text one stays. Rows without words stay."""
    spark = docs.sparkSession
    found, sets = placed(docs, n, percent)
    found = written(spark, found, "components")
    forget(sets)
    first = found.where("n_shingles > 0").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k", "mark")).alias("x"))
    (mark,) = fresh(docs.columns, "mark")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(has_words).withColumn(mark, row_mark()).join(first.select(F.col("x.mark").alias(mark)), mark, "left_semi").dropDuplicates([mark])
    return rows.select(*docs.columns).unionByName(docs.where(~has_words))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
