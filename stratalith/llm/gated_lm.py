"""Log-likelihood of documents under a gated recurrent language model in numpy.

Tokens are lower-case words and one end per document. Counts of all training tokens are grouped over the whole corpus. The
softmax is factored by classes, p(token) = p(class | state) p(token | class, state):
- the HOT most frequent tokens lie in CLASSES classes by frequency, and have scores of their own that depend on the state;
- every other word, seen or not, lies in one of OTHERS classes by how it ends (its last two bytes), and in one of LEAVES leaves of
  that class by the two bytes before: p(token | class, state) = p(leaf | class, state) p(token | leaf). Only the last factor, by
  which a word follows its count plus one among those that share its leaf, does not depend on the state.
So the state tells the words of the whole vocabulary apart by class and leaf, and the frequent ones by themselves; the count
tables, which all words have, grow with the corpus. Inputs are the same: the frequent tokens, and the leaves of all others.

The state is a gated recurrent unit. Training is truncated back-propagation: documents run side by side in lanes, window by
window of STEPS tokens, and the state goes on across windows until its document ends. The training documents are dealt into
shards of about SHARD_TOKENS tokens by a hash of id and text, and lie in a shard in the order of that hash; both depend on the
table alone. ROUNDS rounds each train on their share of the shards, every shard from the weights that the round before left;
the round's weights are the mean over its shards, added as integers, so that no order of tasks changes them. The model is a
function of the table, however its rows are partitioned. Every training document is trained on once.

Texts are read twice: tokens are counted, then written as codes (two bytes each), from which the network trains and scores.
Scoring carries the state through the whole document, so a score is the log-likelihood of the complete text. Counts of the KNOWN
most frequent tokens are broadcast (a fixed number; of equally frequent ones those of the least hash); occurrences of other
tokens are joined with the table of counts.

Nulls: a null text is an empty one, its only token the end; a row without doc_id is trained on. Repeated rows count each.
Ties: equally frequent tokens are ranked by their hash. Long texts are scored whole; a document lies in one lane. Without
training rows every base score is 0 and the model is its start. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Lookup, Words, mixed, released, slices
from .shared import table, written

HOT, CLASSES, OTHERS, HIDDEN = 512, 16, 48, 16
#: Leaves of each of the OTHERS classes.
LEAVES = 32
KNOWN = 1 << 18
STEPS, LANES, RATE = 16, 384, 0.3
SHARD_TOKENS, ROUNDS = 1 << 22, 3
#: Weights are added as integers of this scale; a sum over 2^24 shards of weights below 64 fits.
SCALE = 1 << 32
#: Logits are cut at this, so that no sum of exponentials overflows.
TOP = 60.0
CHUNK_TOKENS = 1_000_000
#: Rows of one class that are multiplied at once.
TILE = 64
#: A lane is at least about so long, so that little data still makes many steps.
LANE_TOKENS = 2048
FOLDS, HELD = 7, 2
_ROOTS = {"gates": 0.1, "turn": 0.1, "words": 0.05, "classes": 0.05}


def _bytes(words: Words, i: int) -> np.ndarray:
    """Of each word the byte that is the i-th from its end and the one before it, 0 where it has none."""
    one, two = (np.where(words.ends - words.starts > k, words.data[np.maximum(words.ends - 1 - k, 0)], 0).astype(np.uint64) for k in (i, i + 1))
    return one << np.uint64(8) | two


def endings(words: Words) -> np.ndarray:
    """Of each word the class of its last two bytes."""
    return (mixed(_bytes(words, 0)) % np.uint64(OTHERS)).astype(np.int64)


def leaves(words: Words) -> np.ndarray:
    """Of each word its leaf among those of all classes: its class, then the two bytes before the last two."""
    return endings(words) * LEAVES + (mixed(_bytes(words, 2) + np.uint64(1)) % np.uint64(LEAVES)).astype(np.int64)


class Vocabulary:
    """hashes, counts and endings of the KNOWN most frequent words (most frequent first), N, V, the count of the ends, and of
    each ending the tokens and the distinct words in training; leaf: the leaf of each word, and the same of each leaf. Without it
    words are told apart by their endings only."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, total: int, distinct: int, ends: int, by_ending: np.ndarray, hot: int | None = None, leaf: tuple[np.ndarray, np.ndarray] | None = None):
        self.lookup, self.counts, self.total, self.distinct = Lookup(hashes), counts, total, distinct
        self.hot = min((hot or HOT) - 1, len(hashes))  # words; the end comes after them, then the endings
        self.end = self.hot
        own = np.append(counts[: self.hot], ends).astype(np.float64)
        order = np.argsort(-own, kind="stable")
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        # Frequent tokens in the order of their frequency; each class has as many as the next (the last may have fewer).
        self.size = -(-len(own) // min(CLASSES, self.hot + 1))
        self.classes = -(-len(own) // self.size)
        self.place = rank  # of a frequent token: its row among the output words
        self.own = own[order]
        # Of each code (frequent tokens, endings, none): its class.
        self.class_of = np.concatenate((rank // self.size, self.classes + np.arange(OTHERS), [self.classes + OTHERS]))
        rest = by_ending.astype(np.float64)  # (OTHERS, 2): tokens, distinct words
        np.subtract.at(rest, classes[: self.hot], np.stack([counts[: self.hot], np.ones(self.hot)], 1))
        self.rest = np.maximum(rest, 0)
        self.leaf = None
        if leaf is not None:
            self.leaf = leaf[1].astype(np.float64)  # (OTHERS * LEAVES, 2)
            np.subtract.at(self.leaf, leaf[0][: self.hot], np.stack([counts[: self.hot], np.ones(self.hot)], 1))
            self.leaf = np.maximum(self.leaf, 0)

    def light(self) -> Vocabulary:
        """What a network needs of it: all but the table of counts."""
        out = copy(self)
        out.lookup = out.counts = None
        return out

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + self.distinct + 1.0))

    def shares(self) -> np.ndarray:
        """Of each leaf log10 of (N + V + 1) over the same for its words that are not frequent: what turns a base score into one within the leaf."""
        return math.log10(self.total + self.distinct + 1.0) - np.log10(self.leaf.sum(1) + 1.0)

    def codes(self, known: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Numbers of frequent words; after these and the end the leaves."""
        return np.where((known >= 0) & (known < self.hot), known, self.hot + 1 + leaf)


class Network:
    """Inputs: the code of the token before (frequent tokens, the end, endings, leaves), or the start of a document."""

    def __init__(self, v: Vocabulary):
        rnd = np.random.default_rng(20)
        self.v, h = v.light(), HIDDEN
        self.inputs = v.hot + 1 + OTHERS + (0 if v.leaf is None else OTHERS * LEAVES) + 1
        normal = lambda n, *shape: (rnd.standard_normal(shape) * _ROOTS[n]).astype(np.float32)
        rows = v.size * v.classes
        share = np.full(rows, -20.0)
        share[: len(v.own)] = np.log(v.own + 1)
        by_class = np.append(np.array([np.logaddexp.reduce(share[i * v.size : (i + 1) * v.size]) for i in range(v.classes)]), np.log(v.rest[:, 0] + 1))
        self.p = {
            "gates": normal("gates", self.inputs, 3 * h),
            "turn": normal("turn", h, 3 * h),
            "words": normal("words", rows, h),
            "word_bias": share.astype(np.float32),
            "classes": normal("classes", h, v.classes + OTHERS),
            "class_bias": (by_class - by_class.max()).astype(np.float32),
        }
        if v.leaf is not None:
            mass = np.log(v.leaf[:, 0] + 1).reshape(OTHERS, LEAVES)
            self.p["leaves"] = normal("words", OTHERS, h, LEAVES)
            self.p["leaf_bias"] = (mass - mass.max(1, keepdims=True)).astype(np.float32)
        self.grads: dict[str, tuple] = {}  # of the last window: rows and their gradients
        self.full = STEPS  # tokens of a window with all lanes
        self.squares = {k: np.full_like(x, 1e-4) for k, x in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def whole(self) -> np.ndarray:
        """The weights as integers."""
        return np.rint(self.flat().astype(np.float64).clip(-63, 63) * SCALE).astype(np.int64)

    def again(self) -> Network:
        """A network of the same weights that has not trained yet."""
        out = Network(self.v)
        out.load(self.flat())
        return out

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, state: np.ndarray, train: bool, leaf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x, y (steps, lanes): codes of inputs and of targets (-1: none); fresh: where documents start; leaf: of targets that are
        not frequent, their leaf within the class.

        Returns ln p(class), for a frequent token and ln p(token | class), with leaf for any other and ln p(leaf | class), of each
        target and the state after the last step; trains if asked to.
        """
        p, v, h = self.p, self.v, HIDDEN
        steps, lanes = x.shape
        kept = p["gates"].dtype
        pre = p["gates"].take(x, 0)
        before, zr_all, n_all = (np.empty((steps, lanes, k), kept) for k in (h, 2 * h, h))
        states = np.ones((steps, lanes, h + 1), kept)  # the last column is for the biases
        u_gate, u_new = -p["turn"][:, : 2 * h], p["turn"][:, 2 * h :]
        anew = fresh.any(1)
        for t in range(steps):
            if anew[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            zr, n = zr_all[t], n_all[t]
            np.subtract(state @ u_gate, pre[t, :, : 2 * h], out=zr)
            np.minimum(zr, TOP, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.add(pre[t, :, 2 * h :], (zr[:, h:] * state) @ u_new, out=n)
            np.tanh(n, out=n)
            before[t] = state
            state = state - n
            state *= zr[:, :h]
            state += n
            states[t, :, :h] = state
        hidden = states.reshape(-1, h + 1)
        target = y.ravel()
        used = target >= 0
        kind = v.class_of[target].astype(np.uint16)  # of none: a class after all others
        told = np.where(used, kind, 0).astype(np.int64)
        flat = np.arange(len(target)) * (v.classes + OTHERS) + told
        scale = 1.0 / max(1, self.full)  # of a full window: a window with few lanes left weighs little
        weights = np.concatenate((p["classes"], p["class_bias"][None]))
        e, out, total = self._softmax(hidden, weights, flat, self._bound(weights))
        if train:
            # Rows of e are a total times too large; what they are multiplied with is so much smaller.
            e.reshape(-1)[flat] -= total
            each = (np.where(used, scale, 0) / total).astype(kept)[:, None]
            d = (hidden * each).T @ e
            grads = {"classes": d[:h], "class_bias": d[h]}
            d_hidden = e @ p["classes"].T
            d_hidden *= each
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], [v.classes, v.classes + OTHERS])
        own = order[: cuts[0]]
        weights = np.concatenate((p["words"].reshape(v.classes, v.size, h).transpose(0, 2, 1), p["word_bias"].reshape(v.classes, 1, v.size)), 1)
        ln, back = self._within(hidden[own], kind[own].astype(np.int64), v.place[target[own]] % v.size, weights, scale if train else None)
        out[own] += ln
        if train:
            d, d_own = back
            grads |= {"words": d[:, :h].transpose(0, 2, 1).reshape(-1, h), "word_bias": d[:, h].reshape(-1)}
            d_hidden[own] += d_own
        if leaf is not None:
            own = order[cuts[0] : cuts[1]]
            weights = np.concatenate((p["leaves"], p["leaf_bias"][:, None]), 1)
            ln, back = self._within(hidden[own], kind[own].astype(np.int64) - v.classes, leaf.ravel()[own], weights, scale if train else None)
            out[own] += ln
            if train:
                d, d_own = back
                grads |= {"leaves": d[:, :h], "leaf_bias": d[:, h]}
                d_hidden[own] += d_own
        out[~used] = 0
        if train:
            self._back(x, fresh, before, zr_all, n_all, d_hidden.reshape(steps, lanes, h), grads)
        return out.reshape(steps, lanes), state

    @staticmethod
    def _bound(weights: np.ndarray) -> float:
        """What no logit exceeds, as states lie in (-1, 1). The last of the weights are biases."""
        return (np.abs(weights[..., :-1, :]).sum(-2) + weights[..., -1, :]).max()

    @staticmethod
    def _softmax(hidden: np.ndarray, weights: np.ndarray, flat: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of the logits, ln p of the places asked for (of all logits in a row), sums of the rows."""
        logits = hidden @ weights
        if bound > TOP:
            np.minimum(logits, TOP, out=logits)
        ln = logits.reshape(-1).take(flat)
        e = np.exp(logits, out=logits)
        total = (e @ np.ones(e.shape[-1], e.dtype)).reshape(-1)
        return e, ln - np.log(total[flat // e.shape[-1]]), total

    @classmethod
    def _within(cls, near: np.ndarray, kind: np.ndarray, at: np.ndarray, weights: np.ndarray, scale: float | None) -> tuple[np.ndarray, tuple | None]:
        """ln p(member | class) of rows in the order of their classes, and with a scale the gradients of the weights and of the rows.

        weights: (classes, states and bias, members). Rows of a class lie in tiles of TILE, the last of them filled up, so that
        one product of many small matrices does for all classes.
        """
        classes, width, members = weights.shape
        if not len(kind):
            return np.zeros(0), None if scale is None else (np.zeros_like(weights), near[:, :-1])
        n = np.bincount(kind, minlength=classes)
        tiles = -(-n // TILE)
        slot = np.arange(len(kind)) + ((np.cumsum(tiles) - tiles) * TILE - (np.cumsum(n) - n))[kind]
        own = np.repeat(weights, tiles, 0)
        rows = np.zeros((len(own) * TILE, width), near.dtype)
        rows[slot] = near
        flat = slot * members + at
        e, ln, total = cls._softmax(rows.reshape(-1, TILE, width), own, flat, cls._bound(weights))
        if scale is None:
            return ln, None
        e.reshape(-1)[flat] -= total[slot]
        each = np.zeros((len(rows), 1), near.dtype)
        each[slot, 0] = scale / total[slot]
        rows *= each
        of_tile = rows.reshape(-1, TILE, width).transpose(0, 2, 1) @ e
        is_of = (np.repeat(np.arange(classes), tiles) == np.arange(classes)[:, None]).astype(near.dtype)
        grads = (is_of @ of_tile.reshape(len(own), -1)).reshape(weights.shape)
        d = (e @ own[:, :-1].transpose(0, 2, 1)).reshape(-1, width - 1)
        return ln, (grads, d[slot] * each[slot])

    def _back(self, x, fresh, before, zr_all, n_all, d_hidden, grads) -> None:
        p, h = self.p, HIDDEN
        steps, lanes = x.shape
        u_gate, u_new = p["turn"][:, : 2 * h].T, p["turn"][:, 2 * h :].T
        z, r = zr_all[:, :, :h], zr_all[:, :, h:]
        to_new, to_z, to_r = (1 - z) * (1 - n_all * n_all), (before - n_all) * z * (1 - z), before * r * (1 - r)
        d_pre = np.empty((steps, lanes, 3 * h), before.dtype)
        d_state, anew = np.zeros((lanes, h), before.dtype), fresh.any(1)
        for t in range(steps - 1, -1, -1):
            d = d_hidden[t] + d_state
            dn = d * to_new[t]
            d_rs = dn @ u_new
            d_pre[t, :, :h] = d * to_z[t]
            d_pre[t, :, h : 2 * h] = d_rs * to_r[t]
            d_pre[t, :, 2 * h :] = dn
            d *= z[t]
            d_rs *= r[t]
            d += d_rs
            d += d_pre[t, :, : 2 * h] @ u_gate
            d_state = d
            if anew[t]:
                d_state[fresh[t]] = 0
        s_all = before.reshape(-1, h)
        flat = d_pre.reshape(-1, 3 * h)
        grads["turn"] = np.concatenate((s_all.T @ flat[:, : 2 * h], (r.reshape(-1, h) * s_all).T @ flat[:, 2 * h :]), 1)
        ids = x.ravel().astype(np.uint16)  # few bits, so that they are sorted by their digits
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
        touched = ids[order[first]]  # rows of inputs that were there; the others do not change
        pairs = flat.take(order, 0).view(np.result_type(flat, np.complex64))  # two numbers are added at once
        self._step("gates", touched, np.clip(np.add.reduceat(pairs, first, axis=0).view(flat.dtype), -1, 1))
        np.clip(grads["turn"], -1, 1, out=grads["turn"])
        # Gradients of the output weights lie in [-1, 1]: a mean over tokens, of which no token's is larger.
        for k, g in grads.items():
            self._step(k, slice(None), g)

    def _step(self, k: str, at, g: np.ndarray) -> None:
        """One Adagrad step of some rows of a weight."""
        self.grads[k] = (at, g)
        step = g * g
        step += self.squares[k][at]
        self.squares[k][at] = step
        np.sqrt(step, out=step)
        np.divide(g, step, out=step)
        step *= np.float32(RATE)
        self.p[k][at] -= step

    def run(self, codes: np.ndarray, lengths: np.ndarray, train: bool, leaf: np.ndarray | None = None) -> np.ndarray:
        """ln p of every token (see window()) of documents of these lengths, in order. leaf: of tokens that are not frequent, of
        all leaves."""
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        x = np.empty_like(codes)
        x[1:] = (codes if leaf is None else np.where(codes > self.v.end, self.v.end + 1 + OTHERS + leaf, codes))[:-1]
        x[starts] = self.inputs - 1
        # Documents to lanes, longest first, each to the lane that is shortest so far.
        lanes = int(max(1, min(LANES, len(lengths), len(codes) // LANE_TOKENS)))
        heap = [(0, i) for i in range(lanes)]
        queue: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            n, i = heapq.heappop(heap)
            queue[i].append(d)
            heapq.heappush(heap, (n + int(lengths[d]), i))
        order = sorted(range(lanes), key=lambda i: -sum(int(lengths[d]) for d in queue[i]))
        stream = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for i in order for d in queue[i]])
        full = np.array([sum(int(lengths[d]) for d in queue[i]) for i in order])
        begin = np.concatenate(([0], np.cumsum(full)))[:-1]
        is_start = np.zeros(len(codes), bool)
        is_start[starts] = True
        out = np.zeros(len(codes), np.float64)
        self.full = lanes * STEPS
        state = np.zeros((lanes, HIDDEN), np.float32)
        t = 0
        while t < full[0]:
            active = int(np.searchsorted(-full, -t, side="left"))
            # Scores do not depend on windows: where few lanes are left, as after one long text, one is longer, but ends with a lane.
            steps = STEPS if train else max(STEPS, min(STEPS * (lanes // active), int(full[active - 1]) - t))
            place = t + np.arange(steps)[:, None]
            inside = place < full[:active]
            at = stream[np.where(inside, begin[:active] + place, 0)]
            wide = np.where(inside, codes[at], -1)
            got, state = self.window(np.where(inside, x[at], self.inputs - 1), wide, is_start[at] & inside, state[:active], train, None if leaf is None else leaf[at] % LEAVES)
            out[at[inside]] = got[inside]
            t += steps
        return out

    def run_fine(self, codes: np.ndarray, lengths: np.ndarray, train: bool) -> np.ndarray:
        """run() for codes of frequent tokens and leaves."""
        leaf = np.maximum(codes - self.v.end - 1, 0)
        return self.run(np.where(codes > self.v.end, self.v.end + 1 + leaf // LEAVES, codes), lengths, train, leaf)


def chunks(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple]:
    """Documents in runs of about CHUNK_TOKENS tokens: rows; known numbers (-1: not known, -3: the end), codes and hashes of all tokens with the ends; lengths."""
    parts, size = [], 0

    def out() -> tuple:
        return [p for p, *_ in parts], *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))

    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), lower=True)
            hashes, at = words.hashes(), words.first[1:]
            known = v.lookup.find(hashes)
            parts.append((part, np.insert(known, at, -3), np.insert(v.codes(known, leaves(words)), at, v.end), np.insert(hashes, at, np.uint64(0)), words.counts + 1))
            size += len(parts[-1][1])
            if size >= CHUNK_TOKENS:
                yield out()
                parts, size = [], 0
    if size:
        yield out()


def in_training() -> object:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """token, c, leaf over all rows; each run of rows is counted before it is shuffled."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words = Words(part.column("text"), lower=True)
                tokens, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n), pa.array(leaves(words)[first].astype(np.int32))], ["token", "c", "leaf"])

    return docs.select("text").mapInArrow(run, "token bigint, c bigint, leaf int").groupBy("token").agg(F.sum("c").alias("c"), F.min("leaf").alias("leaf"))


def most_frequent(counts: DataFrame, most: int, fill: bool = False) -> pa.Table:
    """The tokens from the least step of counts on of which no more than so many are there; with fill also, by their hash, a
    share of those in the step below, so that about as many come. No task gets them all."""
    return _frequent(counts, most, fill).toArrow().sort_by([("c", "descending"), ("token", "ascending")])


def _frequent(counts: DataFrame, most: int, fill: bool) -> DataFrame:
    """The rows of most_frequent(). However many steps there are, a row is compared with the least of them only."""
    step = F.floor(F.log2("c") * 16).cast("int")
    left, least, share = most, None, 0
    for r in counts.where(step.isNotNull()).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        if r["count"] > left:
            below, share = r["step"], int((1 << 20) * 0.95 * left / r["count"]) if fill else 0
            break
        left -= r["count"]
        least = r["step"]
    wanted = F.lit(False) if least is None else step >= least
    if share:
        wanted = wanted | ((step == below) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < share))
    return counts.where(wanted)


ENCODED = "row bigint, doc_id bigint, train boolean, shard bigint, place bigint, n_tokens bigint, n_known bigint, base double, score double, codes binary, token bigint, n bigint"


def encoded(docs: DataFrame, sent: Broadcast, ends: int, shards: int) -> DataFrame:
    """Two kinds of rows. Of every document: row, doc_id, whether it is trained on, shard, place (its order there), n_tokens;
    n_known, base and score as far as the known tokens and what the network does not tell make them; codes (two bytes a token,
    with the end). Of its tokens that are not known: row, token, n."""
    kinds = {n: {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[k] for n, k in (x.split() for x in ENCODED.split(", "))}
    given = ("doc_id", "train", "shard", "place")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def batch(size: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: columns[k] if k in columns else pa.nulls(size, kind) for k, kind in kinds.items()})

        v = sent.value
        shares = v.shares()
        row = TaskContext.get().partitionId() << 40
        for parts, known, codes, hashes, lengths in chunks(batches, v):
            at = np.concatenate(([0], np.cumsum(lengths)))
            add = lambda x, first=at[:-1]: np.add.reduceat(x, first)
            c = np.where(known >= 0, v.counts[np.maximum(known, 0)] if len(v.counts) else 0, np.where(known == -3, ends, 0))
            far, other = known == -1, codes > v.end
            base = np.where(far, 0.0, v.base(c))
            score = np.where(other, base + shares[np.where(other, codes - v.end - 1, 0)], 0.0)
            small = codes.astype(np.uint16)
            ids = np.arange(row, row + len(lengths))
            row += len(lengths)
            own = {k: pa.concat_arrays([p.column(k) for p in parts]) for k in given}
            own |= {"n_tokens": pa.array(lengths), "n_known": pa.array(add((c > 0).astype(np.int64))), "base": pa.array(add(base)), "score": pa.array(add(score))}
            yield batch(len(ids), row=pa.array(ids), codes=pa.array([small[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), **own)
            where = np.flatnonzero(far)
            owner, token = np.repeat(ids, lengths)[where], hashes[where]
            order = np.lexsort((token, owner))
            owner, token = owner[order], token[order]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])))) if len(where) else where
            yield batch(len(new), row=pa.array(owner[new]), token=pa.array(token[new].view(np.int64)), n=pa.array(np.diff(np.append(new, len(where)))))

    place = F.xxhash64("doc_id", "text")
    return docs.select("text", "doc_id", in_training().alias("train"), F.pmod(place, F.lit(shards)).alias("shard"), F.shiftrightunsigned(place, 8).alias("place")).mapInArrow(run, ENCODED)


def shard_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """shard and documents, in runs of about CHUNK_TOKENS tokens; where they are cut depends on the shard alone."""
    now, docs, size = None, [], 0
    for batch in batches:
        for shard, codes in zip(batch.column("shard").to_pylist(), batch.column("codes"), strict=True):
            if docs and (shard != now or size >= CHUNK_TOKENS):
                yield now, docs
                docs, size = [], 0
            now = shard
            docs.append(np.frombuffer(codes.as_buffer().to_pybytes(), np.uint16))
            size += len(docs[-1])
    if docs:
        yield now, docs


def trained(codes: DataFrame, v: Vocabulary, shards: int) -> Network:
    """The network after ROUNDS rounds over the shards of all training documents."""
    spark = codes.sparkSession
    network = Network(v)
    rounds = min(ROUNDS, shards)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(network)

        @released
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            last, own, n = None, None, 0
            total = np.zeros(len(sent.value.flat()), np.int64)
            for shard, docs in shard_chunks(batches):
                if shard != last:
                    if own is not None:
                        total += own.whole()
                    last, own, n = shard, sent.value.again(), n + 1
                own.run_fine(np.concatenate(docs).astype(np.int64), np.array([len(d) for d in docs]), True)
            if own is not None:
                total += own.whole()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, n))], ["i", "x"])

        dealt = codes.where(F.col("train") & (F.col("shard") % rounds == k)).select("shard", "place", "codes").repartition("shard").sortWithinPartitions("shard", "place", "codes")
        got = dealt.mapInArrow(run, "i bigint, x bigint").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if got.num_rows:
            sums = np.empty(got.num_rows, np.int64)
            sums[got["i"].to_numpy()] = got["x"].to_numpy()
            network.load(sums[:-1] / (float(SCALE) * sums[-1]))
        sent.unpersist()
    return network


def scored(codes: DataFrame, network: Network) -> DataFrame:
    """row, doc_id, n_tokens, n_known, base, score of every document, with the network's share of the score."""
    sent = codes.sparkSession.sparkContext.broadcast(network)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            lengths = whole["n_tokens"].to_numpy()
            every = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in whole["codes"]]).astype(np.int64)
            ln = np.add.reduceat(sent.value.run_fine(every, lengths, False), np.concatenate(([0], np.cumsum(lengths)))[:-1])
            score = pa.array(whole["score"].to_numpy() + ln / math.log(10))
            return pa.RecordBatch.from_arrays([score if n == "score" else whole[n].combine_chunks() for n in names], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            size += int(batch.column("n_tokens").to_numpy().sum())
            if size >= CHUNK_TOKENS:
                yield out()
                parts, size = [], 0
        if parts:
            yield out()

    documents = codes.where("codes is not null").select(*names, "codes")
    return documents.mapInArrow(run, documents.drop("codes").schema)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    learn = slim.where(in_training())
    counts = written(spark, word_counts(learn), "counts")
    ends = learn.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, KNOWN, fill=True)
    by_leaf = np.zeros((OTHERS * LEAVES, 2), np.int64)
    for r in counts.groupBy("leaf").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # OTHERS * LEAVES rows at most
        by_leaf[r["leaf"]] = r["c"], r["n"]
    leaf = top["leaf"].to_numpy()
    v = Vocabulary(top["token"].to_numpy().view(np.uint64), top["c"].to_numpy(), leaf // LEAVES, total + ends, distinct + (ends > 0), ends, by_leaf.reshape(OTHERS, LEAVES, 2).sum(1), leaf=(leaf, by_leaf))
    del top
    vocabulary = spark.sparkContext.broadcast(v)
    v = v.light()
    shards = max(1, v.total // SHARD_TOKENS)
    codes = written(spark, encoded(slim, vocabulary, ends, shards), "codes")
    vocabulary.unpersist()
    found = written(spark, scored(codes, trained(codes, v, shards)), "scores")
    far = codes.where("token is not null").select("row", "token", "n").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    rest = far.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("far_known"), F.sum(F.col("n") * F.log10((c + 1.0) / float(v.total + v.distinct + 1))).alias("far_base"))
    own = found.join(rest, "row", "left")
    more = F.coalesce("far_base", F.lit(0.0))
    return own.select(
        "doc_id",
        (~F.coalesce(in_training(), F.lit(True))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(v.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op5_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
