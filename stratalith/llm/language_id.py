"""Language identification in two steps: the language family first, then linear support vector machines, one against one,
between the languages of that family.

Features are shares of hashed character 1- to 4-grams of the lower-case text; all of the text counts. The machines (squared
hinge loss, accelerated gradient steps on the whole sample) are fitted on the driver on a sample of at most max_rows
(MAX_SAMPLE) labelled rows, as many of each language as of any other where there are so many: those whose hash of doc_id and
text is least. So at most max_rows languages are learned, those with most rows. The sample comes as sparse feature vectors of
bounded size, not as texts. Prediction is one pass without a shuffle; the weights are a few hundred KB whatever the input.

Nulls and texts without a letter: lang 'und', score 0. Rows without lang are predicted but not learned from. Without any
labelled row every text is 'und'; with one language all texts with a letter are that language. Ties: of languages with equally
many duels won the one with the larger sum of margins, then the first by name. Rows equal in doc_id, lang and text are sampled
once and each predicted. Long texts are read whole, in pieces of CHUNK characters. Empty table: empty result. Extra columns are
ignored by predict() and kept by keep_known(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import released, slices
from .shared import fresh, table

LOG2_FEATURES = 13
GRAMS = (1, 2, 3, 4)
MAX_SAMPLE = 2400
FOLDS, HELD = 5, 0
CHUNK = 1 << 18
#: Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "finnic": "et fi",
    "indo-aryan": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, in bounded pieces (each gram lies in one piece)."""
    text = text.lower()
    for i in range(0, len(text), CHUNK):
        part = text[max(0, i - max(GRAMS) + 1) : i + CHUNK]
        skip = i - max(0, i - max(GRAMS) + 1)  # characters that were in the piece before
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        key = np.zeros(len(points), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(points) < n:
                break
            key = key[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                own = key[max(0, skip - n + 1) :] if skip else key
                h = own * np.uint64(0x9E3779B97F4A7C15)
                yield (h >> np.uint64(64 - LOG2_FEATURES)).astype(np.int64)


def vector(text: str) -> np.ndarray:
    """Shares of the features; they sum to 1."""
    out = np.zeros(1 << LOG2_FEATURES, np.float64)
    for g in grams(text):
        out += np.bincount(g, minlength=len(out))
    return (out / max(1.0, out.sum())).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise |w|^2 / 2 + c * mean(max(0, 1 - y (xw + b))^2), classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    norm = max(1e-12, float(np.einsum("ij,ij->i", x, x).max()))
    rate = 1.0 / (1.0 + 2 * c * (norm + 1.0))
    for t in range(steps):
        m = (np.maximum(0.0, 1.0 - y * (x @ vw + vb)) * y * weight).astype(np.float32)
        gw, gb = vw - 2 * c * (m @ x), -2 * c * m.sum()
        nw, nb = vw - np.float32(rate) * gw, vb - rate * gb
        k = np.float32(t / (t + 3.0))
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


class Model:
    """Columns of weights: one machine per pair of families, then one per pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], own: bool = False):
        """own: x is scaled where it is, so that the sample is not held twice."""
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family(lang), []).append(lang)
        scale = np.sqrt(np.einsum("ij,ij->j", x, x) / max(1, len(x))) + np.float32(1e-4)  # rare grams weigh as much as common ones
        x = np.divide(x, scale, out=x if own else None)
        mean = np.float32(max(1e-12, np.sqrt(np.einsum("ij,ij->i", x, x)).mean())) if len(x) else np.float32(1)
        scale = scale * mean
        x /= mean  # rows of a mean length of 1
        labels, kin = np.array(langs), np.array([family(v) for v in langs])
        self.pairs: list[tuple[str, str]] = []
        columns, offsets = [], []
        groups = [(kin, sorted(self.families))] + [(labels, v) for v in self.families.values()]
        for names, options in groups:
            for i, a in enumerate(options):
                for b in options[i + 1 :]:
                    rows = (names == a) | (names == b)
                    w, off = fit_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0), 100.0)
                    self.pairs.append((a, b))
                    columns.append(w)
                    offsets.append(off)
        self.weights = np.zeros((1 << LOG2_FEATURES, len(columns)), np.float32)
        if columns:
            self.weights = (np.stack(columns, 1) / scale[:, None]).astype(np.float32)
        self.offsets = np.array(offsets, np.float32)
        self.at = {p: i for i, p in enumerate(self.pairs)}

    def decide(self, options: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The option with most duels won (of equals the larger sum of margins, then the first), and how sure its duels are."""
        if len(options) == 1:
            return options[0], 1.0
        wins, sums, sure = dict.fromkeys(options, 0), dict.fromkeys(options, 0.0), dict.fromkeys(options, 1.0)
        for i, a in enumerate(options):
            for b in options[i + 1 :]:
                m = float(margins[self.at[a, b]])
                wins[a if m >= 0 else b] += 1
                p = 1.0 / (1.0 + np.exp(-np.clip(4.0 * m, -30, 30)))
                sums[a] += m
                sums[b] -= m
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(options, key=lambda o: (wins[o], sums[o]))
        return best, float(sure[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.families:
            return "und", 0.0
        counts = np.zeros(len(self.weights), np.float64)
        for g in grams(text):
            counts += np.bincount(g, minlength=len(counts))
        margins = counts @ self.weights / max(1.0, counts.sum()) + self.offsets
        kin, p = self.decide(sorted(self.families), margins)
        lang, q = self.decide(self.families[kin], margins)
        return lang, p * q


def sample(docs: DataFrame, max_rows: int = MAX_SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most max_rows labelled rows outside the held-out fold, the languages as even as they can be."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD)).select("doc_id", "lang", "text")
    key = F.xxhash64("doc_id", "text")
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return np.zeros((0, 1 << LOG2_FEATURES), np.float32), []
    each = max_rows // len(sizes)
    few = None  # of each language about 2 * each + 40 rows by their hash, of which the least are taken
    for lang, n in sizes.items():
        rule = (F.col("lang") == lang) & (F.pmod("key", F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * (2 * each + 40) / n) + 1))
        few = rule if few is None else few | rule
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "key"))
    chosen = labelled.select("lang", key.alias("key")).where(few).distinct().withColumn("rank", rank).where(F.col("rank") <= each).drop("rank")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, v, vector(t)) for d, v, t in zip(*(batch.column(n).to_pylist() for n in ("key", "lang", "text")), strict=True) if has_letter(t)]
            at = [np.flatnonzero(x).astype(np.int32) for _, _, x in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([d for d, _, _ in rows], pa.int64()),
                    "lang": pa.array([v for _, v, _ in rows], pa.string()),
                    "at": pa.array(at, pa.list_(pa.int32())),
                    "share": pa.array([x[i] for (_, _, x), i in zip(rows, at, strict=True)], pa.list_(pa.float32())),
                }
            )

    once = labelled.withColumn("key", key).join(F.broadcast(chosen), ["lang", "key"]).dropDuplicates(["lang", "key"])  # at most max_rows rows
    got = once.select("key", "lang", "text").mapInArrow(run, "key bigint, lang string, at array<int>, share array<float>").toArrow()
    rows = sorted(zip(*(got[n].to_pylist() for n in ("key", "lang")), range(got.num_rows), strict=True))
    x = np.zeros((len(rows), 1 << LOG2_FEATURES), np.float32)
    for k, (_, _, i) in enumerate(rows):
        x[k, got["at"][i].values.to_numpy()] = got["share"][i].values.to_numpy()
    return x, [r[1] for r in rows]


def fit(docs: DataFrame, max_rows: int = MAX_SAMPLE) -> Model:
    return Model(*sample(docs, max_rows), own=True)


def with_language(docs: DataFrame, model: Model, lang: str = "_lang", score: str = "_score") -> DataFrame:
    """docs with the language and the score, in columns of these names."""
    out = docs.withColumns({lang: F.lit(None).cast("string"), score: F.lit(None).cast("double")})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                said = [own.predict(v.as_py()) for v in batch.column("text")]
                put = {lang: pa.array([s[0] for s in said], pa.string()), score: pa.array([s[1] for s in said], pa.float64())}
                yield pa.RecordBatch.from_arrays([put.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return out.mapInArrow(run, out.schema)


def predict(docs: DataFrame, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD
    return with_language(docs.select("doc_id", "text"), fit(docs, max_rows)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_known(docs: DataFrame, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """docs whose language can be told: those of 'und' go, which are the texts without a letter. Without labels all others stay."""
    model = fit(docs, max_rows)
    if model.families:
        lang, score = fresh(docs.columns, "lang", "score")
        return with_language(docs, model, lang, score).where(F.col(lang) != "und").select(*docs.columns)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(v.as_py()) for v in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
