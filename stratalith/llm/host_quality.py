"""Quality rules by host: each document's own counts, then failure rates of hosts under an empirical beta prior.

Counts of a document come from one pass of array functions over its words, without a shuffle. They are written as a narrow
table (no texts), which then gives the failure rate of each host (source) by a pre-aggregated group-by. A beta prior fitted
by moments to the rates of all hosts shrinks each rate: few documents say little about a host. A host whose shrunken rate
minus two posterior deviations is above max_rate is refused with all its documents.

Nulls: a null text has no words (so it fails for its length); rows without a source are judged alone. Empty texts likewise.
Repeated rows count each. Ties: a host exactly at max_rate is kept. Long texts are one array of words and one of window hashes
of their row. Hosts with more than a thousandth of all rows get their verdict by broadcast (there are at most a thousand), so
that a host with a third of all rows lies in no single task. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread_join, table, written

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT, MAX_RATE = 50, 50, 0.5


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every document."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", "source", text.alias("text")).withColumn("words", F.array_remove(F.split("text", BLANK + "+"), ""))
    words = words.withColumn("n_words", F.size("words").cast("bigint"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # A key of a window: the high bits of its hash, then its place; sorted, equal windows are neighbours.
    keys = """if(n_words < 3, array(), transform(sequence(0, size(words) - 3), i ->
        shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), length(bin(n_words))) | cast(i as bigint)))"""
    keyed = words.select("*", F.expr("length(bin(n_words))").alias("bits"), lines.alias("lines"), F.sort_array(F.expr(keys).cast("array<bigint>")).alias("keys"))
    # Places of windows equal to a neighbour (the words are compared again), in order; then the words that they cover.
    same = "(shiftright(x, bits) = shiftright(keys[j{0}], bits) and slice(words, cast(x & (shiftleft(1L, bits) - 1) as int) + 1, 3) = slice(words, cast(keys[j{0}] & (shiftleft(1L, bits) - 1) as int) + 1, 3))"
    near = " or ".join(f"(j + {d} >= 0 and j + {d} < size(keys) and {same.format(f' + {d}')})" for d in (-1, 1, -2, 2))
    found = keyed.select("*", F.expr(f"array_sort(transform(filter(keys, (x, j) -> {near}), x -> x & (shiftleft(1L, bits) - 1)))").alias("found"))
    covered = F.expr("aggregate(found, named_struct('n', 0L, 'last', -3L), (s, p) -> named_struct('n', s.n + least(3L, p - s.last), 'last', p), s -> s.n)")
    return found.select(
        "doc_id",
        "source",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The counts of every document, base_failed, kept, and the host's failure rate after shrinking."""
    spark = docs.sparkSession
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    own = written(spark, counts(docs).withColumn("base_failed", failed), "quality")
    hosts = own.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("w"))
    # Of the variance between hosts, chance alone makes m * (1 - m) / n; what is left fits the prior's weight.
    real = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("w"), F.lit(1e-6))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("m") * (1 - F.col("m")) / real - 1))
    prior = moments.select(F.struct((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b")).alias("prior"))
    shrunk = hosts.withColumn("prior", prior.scalar()).select("source", "n", (F.col("bad") + F.col("prior.a")).alias("a"), (F.col("n") - F.col("bad") + F.col("prior.b")).alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    verdicts = shrunk.select("source", "n", F.round(mean, 9).alias("host_rate"), (mean - 2 * spread > max_rate).alias("refused"))
    return spread_join(own, verdicts, "source", "n", own.count()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("refused", F.lit(False))).alias("kept"), "host_rate"
    )


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
