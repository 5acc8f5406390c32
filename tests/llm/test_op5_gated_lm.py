import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F
from stratalith.llm import gated_lm
from stratalith.llm.gated_lm import Network, Vocabulary, scores

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(texts):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(t for x, h in zip(texts, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in enumerate(texts)}


def check(docs, texts):
    got = {r["doc_id"]: r for r in scores(docs).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in want.items():
        assert tuple(got[i])[1:5] == w[:4]
        assert got[i]["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert got[i]["score"] < 0 and math.isfinite(got[i]["score"])
    return got


@pytest.mark.parametrize("known", [1 << 18, 40, 0])
def test_documents(spark, monkeypatch, known):
    monkeypatch.setattr(gated_lm, "KNOWN", known)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(frame(spark, texts), texts)


def test_the_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score, n = scores(docs).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert score > base + 0.1 * n


def test_the_model_does_not_depend_on_how_rows_are_partitioned(spark, monkeypatch):
    monkeypatch.setattr(gated_lm, "SHARD_TOKENS", 9_000)
    monkeypatch.setattr(gated_lm, "CHUNK_TOKENS", 4_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in scores(docs.repartition(k)).collect()} for k in (1, 8))
    assert len(one) == 200 and all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def plain_scores(net, text_codes):
    """ln p of each token of one document, one at a time, in double precision."""
    p, v, h = {k: x.astype(float) for k, x in net.p.items()}, net.v, gated_lm.HIDDEN
    state, x, out = np.zeros(h), net.inputs - 1, []
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for y in text_codes:
        pre = p["gates"][x]
        z, r = sigmoid(pre[:h] + state @ p["turn"][:, :h]), sigmoid(pre[h : 2 * h] + state @ p["turn"][:, h : 2 * h])
        new = np.tanh(pre[2 * h :] + (r * state) @ p["turn"][:, 2 * h :])
        state = z * state + (1 - z) * new
        logits = state @ p["classes"] + p["class_bias"]
        kind = v.class_of[y]
        ln = logits[kind] - np.log(np.exp(logits).sum())
        if y <= v.end:
            own = slice(kind * v.size, (kind + 1) * v.size)
            s = p["words"][own] @ state + p["word_bias"][own]
            ln += s[v.place[y] - kind * v.size] - np.log(np.exp(s).sum())
        out.append(ln)
        x = y
    return np.array(out)


def test_scores_equal_a_plain_scorer():
    rnd = np.random.default_rng(4)
    net = network()
    codes = rnd.integers(0, net.v.end + gated_lm.OTHERS, 900)
    lengths = np.array([1, 300, 7, 90, 2, 500])
    net.run(codes, lengths, True)
    got, at = net.run(codes, lengths, False), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_scores(net, codes[at : at + n]), atol=1e-3)
        at += n


def test_document_probabilities_sum_to_one_over_words(spark):
    """Of a document of one word: over all seen words, and all unseen ones by their endings, the probabilities sum to one."""
    seen = ["aa ab ac", "aa aa", "ab ad zz", "q"]
    words = ["aa", "ab", "ac", "ad", "zz", "q"]
    rows = [(i, x) for i, x in zip((i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2), seen)]
    held = [i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame(rows + list(zip(held, [*words, ""])), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in scores(docs).collect()}
    first = [10 ** got[i]["score"] for i in held[: len(words)]]
    assert 0 < sum(first) < 1 and all(got[i]["n_known"] == 2 for i in held[: len(words)])


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")] * 3 + [(2, "a", "x", "y")], "doc_id bigint, text string, shard string, place string")
    got = scores(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_a_vocabulary_of_equal_counts_is_not_empty(spark):
    counts = spark.range(4000).selectExpr("id * 7919 as token", "cast(5 as bigint) as c")
    assert gated_lm.most_frequent(counts, 1000).num_rows == 0
    assert 800 < gated_lm.most_frequent(counts, 1000, fill=True).num_rows <= 1000


def test_edge_cases_and_empty_table(spark, edge, edge_texts, empty):
    check(edge, edge_texts)
    assert scores(empty).count() == 0


def test_no_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = scores(spark.createDataFrame([(i, "some text") for i in held], "doc_id bigint, text string")).collect()
    assert [(r["base_score"], r["n_known"], r["train_tokens"]) for r in rows] == [(0.0, 0, 0)] * 3


def network(hot=12):
    n = np.arange(60, 21, -1)
    by_ending = np.stack([np.full(gated_lm.OTHERS, 90), np.full(gated_lm.OTHERS, 9)], 1)
    v = Vocabulary(np.arange(1, 40, dtype=np.uint64) * np.uint64(7919), n, np.arange(39) % gated_lm.OTHERS, 3000, 50, 20, by_ending, hot)
    return Network(v)


def test_probabilities_sum_to_one():
    net = network()
    state = np.ones((1, gated_lm.HIDDEN), np.float32) * 0.3
    p = [net.window(np.zeros((1, 1), int), np.array([[t]]), np.zeros((1, 1), bool), state, False)[0][0, 0] for t in range(net.v.end + 1 + gated_lm.OTHERS)]
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_lanes_or_windows(monkeypatch):
    rnd = np.random.default_rng(0)
    lengths = np.array([1, 5, 90, 33, 2, 17, 64, 1])
    codes = rnd.integers(0, 12 + gated_lm.OTHERS, lengths.sum())
    want = None
    for lanes, steps in ((1, 1), (3, 7), (8, 16)):
        monkeypatch.setattr(gated_lm, "LANES", lanes)
        monkeypatch.setattr(gated_lm, "STEPS", steps)
        got = network().run(codes, lengths, False)
        want = got if want is None else want
        assert np.allclose(got, want, atol=1e-4)


def test_gradients_are_those_of_finite_differences():
    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 20, (5, 3)), rnd.integers(-1, 12 + gated_lm.OTHERS, (5, 3))
    y[0], y[1, 0] = (0, 5, 11), -1
    fresh = rnd.random((5, 3)) < 0.2
    state = rnd.standard_normal((3, gated_lm.HIDDEN)).astype(np.float32)
    net = network()
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    before = {k: p.copy() for k, p in net.p.items()}
    net.full = 15
    loss = lambda: -net.window(x, y, fresh, state, False)[0].sum() / net.full
    net.window(x, y, fresh, state, True)
    grads = {k: np.zeros_like(p) for k, p in before.items()}
    for k, (rows, g) in net.grads.items():
        grads[k][rows] = g
    for k, p in before.items():
        net.p = {n: q.copy() for n, q in before.items()}
        for _ in range(12):
            at = tuple(int(rnd.integers(0, n)) for n in p.shape)
            if k == "gates":
                at = (int(x[rnd.integers(0, 5), rnd.integers(0, 3)]), at[1])
            net.p[k][at] = p[at] + 1e-5
            up = loss()
            net.p[k][at] = p[at] - 1e-5
            down = loss()
            net.p[k][at] = p[at]
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-4), k


def leafy(hot=12):
    """A network that tells words of one ending apart by their leaves."""
    n, each = np.arange(60, 21, -1), gated_lm.LEAVES
    leaf = np.arange(39) % gated_lm.OTHERS * each
    by_leaf = np.stack([np.full(gated_lm.OTHERS * each, 3), np.full(gated_lm.OTHERS * each, 1)], 1)
    by_ending = by_leaf.reshape(gated_lm.OTHERS, each, 2).sum(1)
    return Network(Vocabulary(np.arange(1, 40, dtype=np.uint64) * np.uint64(7919), n, leaf // each, 9000, 1500, 20, by_ending, hot, (leaf, by_leaf)))


def test_probabilities_of_leaves_sum_to_one_and_do_not_depend_on_the_lanes(monkeypatch):
    net, rnd = leafy(), np.random.default_rng(6)
    codes = net.v.end + 1 + gated_lm.OTHERS * gated_lm.LEAVES
    lengths = np.array([1, 400, 9, 33, 2])
    text = rnd.integers(0, codes, lengths.sum())
    net.run_fine(text, lengths, True)
    one = net.run_fine(np.arange(codes), np.ones(codes, int), False)
    assert np.exp(one).sum() == pytest.approx(1, abs=1e-4)
    want = net.run_fine(text, lengths, False)
    for lanes, tile in ((1, 1), (3, 7)):
        monkeypatch.setattr(gated_lm, "LANES", lanes)
        monkeypatch.setattr(gated_lm, "TILE", tile)
        monkeypatch.setattr(gated_lm, "LANE_TOKENS", 20)
        assert np.allclose(net.run_fine(text, lengths, False), want, atol=1e-4)


def test_gradients_of_leaves_are_those_of_finite_differences():
    net, rnd = leafy(), np.random.default_rng(7)
    x, y = rnd.integers(0, net.inputs, (4, 5)), net.v.end + 1 + rnd.integers(0, 3, (4, 5))
    leaf, fresh, state = rnd.integers(0, gated_lm.LEAVES, (4, 5)), np.zeros((4, 5), bool), np.zeros((5, gated_lm.HIDDEN))
    net.p, net.full = {k: p.astype(np.float64) for k, p in net.p.items()}, 20
    before = {k: p.copy() for k, p in net.p.items()}
    net.window(x, y, fresh, state, True, leaf)
    grads = {k: g for k, (_, g) in net.grads.items()}
    for k in ("leaves", "leaf_bias", "turn", "classes"):
        for at in list(zip(*np.nonzero(np.abs(grads[k]) > 1e-3)))[:12]:
            up, down = ({n: q.copy() for n, q in before.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            loss = []
            for net.p in (up, down):
                loss.append(-net.window(x, y, fresh, state, False, leaf)[0].sum() / net.full)
            assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-4), k


def test_words_that_are_not_frequent_follow_the_context(spark, monkeypatch):
    """Words of one ending: which of them comes depends on the text before, not on their counts alone."""
    monkeypatch.setattr(gated_lm, "HOT", 4)  # the words: the, of, and
    rnd = np.random.default_rng(8)
    train, held = ([i for i in range(5000) if (zlib.crc32(str(i).encode()) % 7 != 2) == t] for t in (True, False))
    pairs = ["the of and aa xring", "the of and bb yling"]
    rows = [(i, " ".join(pairs[k] for k in rnd.integers(0, 2, 20))) for i in train[:1500]]
    docs = spark.createDataFrame(rows + list(zip(held, ["aa xring", "aa yling", "bb xring", "bb yling"])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in scores(docs).collect()}
    right_a, wrong_a, wrong_b, right_b = (got[i] for i in held[:4])
    assert right_a - wrong_a > 0.3 and right_b - wrong_b > 0.3


@pytest.mark.parametrize("fill", [False, True])
def test_the_most_frequent_are_found_by_one_comparison(spark, fill):
    """However many steps of counts there are; a term for each would fill the driver with the plan."""
    counts = spark.range(1, 3000).selectExpr("id * 7919 as token", "id * id as c")
    got = gated_lm.most_frequent(counts, 2500, fill)
    assert 2300 < got.num_rows <= 2500 and got["c"].to_pylist()[:2300] == [i * i for i in range(2999, 699, -1)]
    plan = gated_lm._frequent(counts, 2500, fill)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("log2") + plan.lower().count("floor") <= 4
