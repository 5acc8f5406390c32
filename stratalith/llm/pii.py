"""Personal data: values found by pattern, and terms that give such values away, by what the corpus says.

Values (emails, IP addresses, cards, phones) are found by pattern, and secrets (keys, tokens, hashes) by their own information:
a run of letters and digits that holds at least SECRET_BITS by the frequencies of its own characters. Each value is a protected
entity e. Terms t (words) of the documents that hold it, wherever they stand, are counted over the corpus; PMI(t; e) =
log2(p(t, e) / (p(t) p(e))) says how much of e's information IC(e) = -log2 p(e) a reader of t learns. A term with PMI >=
disclosure * IC that stands with e in at least min_support different texts (copies of a text count once for this) is a
disclosing term: it is marked in every document that holds e, and removed where it gives away all of IC, else generalised to
its kind. Probabilities are over documents; all documents are counted, copies too.

The texts are read twice. The first pass writes a narrow table: the values, a hash of the text and the words of each document
that holds a value, and how many documents of each slice of rows hold each word. All counts come from that table. The second
pass marks (and replaces). Only values in min_support texts or more can have disclosing terms, and only terms in min_support to
N^(1 - disclosure) n(e)^disclosure documents can reach the threshold; both bounds are applied before pairs are formed, with the
counts of the KNOWN most frequent values and terms (a fixed number; all others are in at most so many documents as the least of
these); what passes is counted exactly. The pairs that disclose go out in blocks of a fixed number of rows, one block a pass.

Nulls: a null text has no spans. Empty texts have none. Equal rows count as documents each, but as one text. Ties: spans with
one start are ordered by kind. Long texts are searched whole; what is held is their words' hashes. Empty table: empty result.
Extra columns are ignored by spans() and kept by sanitise(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gated_lm import most_frequent
from .kernel import Lookup, Words, released, slices
from .shared import Bloom, fresh, table, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behind and the possessive first part change no match, but keep long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")
#: A run of letters and digits with so many bits is no word and no number.
SECRET_BITS = 45.0

MIN_SUPPORT, DISCLOSURE = 3, 0.9
#: Of so many of the most frequent values and terms each task knows the counts.
KNOWN = 1 << 18
#: Pairs of values and terms that leave a task at once.
PAIRS_AT_ONCE = 1 << 17
BLOCK_PAIRS = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as the local part goes; so runs without an @ cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every value, in order."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def bits(run: str) -> float:
    """The information in a run of characters, by their frequencies in it."""
    return sum(n * math.log2(len(run) / n) for n in Counter(run).values())


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans, and the secrets that none of them touches, in order."""
    base = base_spans(text)
    out = list(base)
    for m in RUN.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and bits(run) >= SECRET_BITS and not any(a < m.end() and m.start() < b for a, b, _ in base):
            out.append((m.start(), m.end(), 4))
    return sorted(out, key=lambda s: (s[0], s[2])) if len(out) > len(base) else base


def entity(kind: int, value: str) -> int:
    """A hash of a value; cards and phones by their digits alone, secrets as they are."""
    value = NOT_DIGIT.sub("", value) if kind in (2, 3) else value.lower() if kind < 2 else value
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


class Terms:
    """The words of one text, with code points and hashes of their lower-case forms."""

    def __init__(self, text: str):
        self.words = Words(pa.array([text]), lower=True)
        self.hashes = self.words.hashes()
        if text.isascii():
            self.starts, self.ends = self.words.starts, self.words.ends
        else:
            points = np.concatenate(([0], np.cumsum((self.words.raw & 0xC0) != 0x80)))
            self.starts, self.ends = points[self.words.starts], points[self.words.ends]

    def free(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """The words that no span touches."""
        out = np.ones(len(self.starts), bool)
        for a, b, _ in spans:
            i, j = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.starts, b, side="left")
            out[i:j] = False
        return out


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


GATHERED = "entities array<bigint>, copy bigint, terms array<bigint>, n array<bigint>"


def gathered(docs: DataFrame) -> DataFrame:
    """Two kinds of rows. entities, copy (a hash of the text) and terms (the words outside of spans) of each document that holds
    a value; terms and n: in how many documents of a slice each word stands."""
    lists = pa.list_(pa.int64())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                column = part.column("text")
                words = Words(column, lower=True)
                hashes = words.hashes()
                each = [np.unique(hashes[i:j]) for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
                terms, n = np.unique(np.concatenate(each), return_counts=True)
                rows = [(None, None, terms.view(np.int64), n)]
                for value in column:
                    text = value.as_py() or ""
                    found = all_spans(text)
                    if found:
                        own = Terms(text)
                        free = np.unique(own.hashes[own.free(found)])
                        rows.append((sorted({entity(k, text[a:b]) for a, b, k in found}), text_hash(text), free.view(np.int64), None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], lists if i != 1 else pa.int64()) for i in range(4)], ["entities", "copy", "terms", "n"])

    return docs.select("text").mapInArrow(run, GATHERED)


class Counts:
    """Counts of the KNOWN most frequent keys; of any other key a count that it does not exceed."""

    def __init__(self, counts: DataFrame, key: str, most: int):
        top = most_frequent(counts.select(F.col(key).alias("token"), F.col("n").alias("c")), most)
        self.lookup, self.n = Lookup(top["token"].to_numpy().view(np.uint64)), top["c"].to_numpy()
        self.rest = int(self.n.min()) if top.num_rows else counts.agg(F.max("n")).first()[0] or 0

    def at_most(self, hashes: np.ndarray) -> np.ndarray:
        at = self.lookup.find(hashes)
        return np.where(at >= 0, self.n[np.maximum(at, 0)], self.rest) if len(self.n) else np.full(len(hashes), self.rest)

    def at_least(self, hashes: np.ndarray) -> np.ndarray:
        """Counts, 0 for keys that are not known."""
        at = self.lookup.find(hashes)
        return np.where(at >= 0, self.n[np.maximum(at, 0)], 0) if len(self.n) else np.zeros(len(hashes), np.int64)


def together(holders: DataFrame, values: Counts, held: Bloom, terms: Counts, copied: Bloom, total: int, disclosure: float) -> DataFrame:
    """entity, term, copy (a hash of the text if it may be there twice): the pairs of each document that may reach the threshold."""
    sent = holders.sparkSession.sparkContext.broadcast((values, held, terms, copied))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, held, terms, copied = sent.value
        e, t, c, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)), pa.array(np.concatenate(t)), pa.concat_arrays(c)], ["entity", "term", "copy"])

        for batch in batches:
            for row, copy in enumerate(batch.column("copy").to_pylist()):
                own = batch.column("entities")[row].values.to_numpy()
                own = own[held.has(own.view(np.uint64))]
                if not len(own):
                    continue
                hashes = batch.column("terms")[row].values.to_numpy().view(np.uint64)
                n = terms.at_least(hashes)
                most = total ** (1 - disclosure) * values.at_most(own.view(np.uint64)).astype(np.float64) ** disclosure * (1 + 1e-9)
                is_copied = bool(copied.has(np.array([copy]).view(np.uint64))[0])
                for k, bound in zip(own, most, strict=True):
                    some = hashes[n <= bound].view(np.int64)
                    e.append(np.full(len(some), k))
                    t.append(some)
                    c.append(pa.array(np.full(len(some), copy)) if is_copied else pa.nulls(len(some), pa.int64()))
                    size += len(some)
                    if size >= PAIRS_AT_ONCE:
                        yield out()
                        e, t, c, size = [], [], [], 0
        if size:
            yield out()

    return holders.select("entities", "copy", "terms").mapInArrow(run, "entity bigint, term bigint, copy bigint")


def sized(keys: DataFrame, column: str) -> Bloom:
    return Bloom.of(keys, column, min(27, max(16, (16 * keys.count()).bit_length())))


def disclosing(docs: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term, ratio (PMI / IC, at most 1) of the pairs at or above the threshold."""
    spark = docs.sparkSession
    seen = written(spark, gathered(docs), "pii-seen")
    holders = seen.where("entities is not null")
    each = written(spark, holders.select(F.explode("entities").alias("entity"), "copy").groupBy("entity", "copy").agg(F.count("*").alias("c")), "pii-values")
    values = each.groupBy("entity").agg(F.sum("c").alias("n"), F.count("*").alias("texts")).where(F.col("texts") >= min_support).select("entity", "n")
    values = written(spark, values, "pii-entities")
    if values.isEmpty():
        return values.select("entity", F.col("n").alias("term"), F.lit(1.0).alias("ratio"))
    total = docs.count()
    counts = seen.where("n is not null").select(F.explode(F.arrays_zip("terms", "n")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.n").alias("n"))
    terms = written(spark, counts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support), "pii-counts")
    copied = each.where("c > 1").select("copy").distinct()
    rows = together(holders, Counts(values, "entity", KNOWN), sized(values, "entity"), Counts(terms, "term", KNOWN), sized(copied, "copy"), total, disclosure)
    # A text that is there once stands for one row; copies of a text are one group and one text.
    pairs = rows.groupBy("entity", "term", "copy").agg(F.count("*").alias("c"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("c").alias("together"), F.sum(F.when(F.col("copy").isNull(), F.col("c")).otherwise(1)).alias("support"))
    counted = pairs.where(F.col("support") >= min_support).join(terms, "term").join(values.withColumnRenamed("n", "n_entity"), "entity")
    pmi = F.log2(F.col("together") * total / (F.col("n") * F.col("n_entity")))
    ic = F.log2(F.lit(float(total)) / F.col("n_entity"))
    ratio = F.when(ic > 0, F.least(F.lit(1.0), pmi / ic)).otherwise(0.0)
    return counted.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= disclosure)


FOUND = "array<struct<start:bigint,end:bigint,kind:string,whole:boolean>>"
ORDER = {k: i for i, k in enumerate((*KINDS, "term"))}


def spans(docs: DataFrame, replace: bool = False, name: str | None = None, **limits) -> DataFrame:
    """docs with _spans (or name): start, end (code points), kind (email, ip, card, phone, secret, term), whole (all of IC: remove it).

    With replace the texts are sanitised in the same pass. Each block of pairs is one more pass, whose result is written.
    """
    spark = docs.sparkSession
    name = name or "_spans"
    found = written(spark, disclosing(docs, **limits), "pii-terms")
    n = max(1, -(-found.count() // BLOCK_PAIRS))
    out = docs.withColumn(name, F.lit(None).cast(FOUND))
    for k in range(n):
        got = found.where(F.pmod("entity", F.lit(n)) == k).orderBy("entity", "term").toArrow()  # about BLOCK_PAIRS rows
        block = spark.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("entity", "term", "ratio")))

        @released
        def run(batches: Iterator[pa.RecordBatch], block=block, first=k == 0, last=k == n - 1) -> Iterator[pa.RecordBatch]:
            entities, terms, ratios = block.value
            at = {int(e): (int(i), int(i + c)) for e, i, c in zip(*np.unique(entities, return_index=True, return_counts=True), strict=True)}
            for whole in batches:
                for batch in slices(whole, "text", 4 << 20):
                    lists = [marked(v.as_py() or "", at, terms, ratios, [] if first else old.as_py()) for v, old in zip(batch.column("text"), batch.column(name), strict=True)]
                    put = {name: pa.array(lists, batch.schema.field(name).type)}
                    if replace and last:
                        texts = [replaced(v.as_py(), marks) if marks else v.as_py() for v, marks in zip(batch.column("text"), lists, strict=True)]
                        put["text"] = pa.array(texts, batch.schema.field("text").type)
                    yield pa.RecordBatch.from_arrays([put.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
        if k < n - 1:
            out = written(spark, out, "pii-marked")
            block.unpersist()
    return out


def replaced(text: str, marks: list[dict]) -> str:
    out, done = [], 0
    for x in marks:
        a, b = max(x["start"], done), x["end"]
        if a >= b:
            continue  # inside a span before it
        word = f"[{x['kind'].upper()}]" if x["kind"] != "term" else "" if x["whole"] else generalised(text[a:b])
        out += [text[done:a], word]
        done = b
    return "".join(out) + text[done:]


def marked(text: str, at: dict, terms: np.ndarray, ratios: np.ndarray, old: list[dict]) -> list[dict]:
    base = all_spans(text)
    out = {(a, b, KINDS[k]): False for a, b, k in base} | {(x["start"], x["end"], x["kind"]): x["whole"] for x in old}
    here = [at[e] for e in {entity(k, text[a:b]) for a, b, k in base} if e in at] if at else []
    if here:
        own = np.concatenate([terms[i:j] for i, j in here])
        whole = np.concatenate([terms[i:j][ratios[i:j] >= 1] for i, j in here])
        all_terms = Terms(text)
        hashes = all_terms.hashes.view(np.int64)
        for w in np.flatnonzero(all_terms.free(base) & np.isin(hashes, own)):
            key = (int(all_terms.starts[w]), int(all_terms.ends[w]), "term")
            out[key] = out.get(key, False) or bool((whole == hashes[w]).any())
    return [{"start": a, "end": b, "kind": k, "whole": v} for (a, b, k), v in sorted(out.items(), key=lambda x: (x[0][0], ORDER[x[0][2]]))]


def report(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans."""
    found = spans(docs.select("doc_id", "text"), **limits)
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_spans", said), ",").alias("spans"), count("secret"), count("term"), F.size("_spans").cast("bigint").alias("n_spans"),
    )


def generalised(word: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """docs with each value replaced by its kind, each term that tells all removed and other disclosing terms generalised."""
    (name,) = fresh(docs.columns, "spans")
    return spans(docs, replace=True, name=name, **limits).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
