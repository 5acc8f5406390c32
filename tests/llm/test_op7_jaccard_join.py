import random
import re

import numpy as np
import pytest
from conftest import frame
from stratalith.llm import jaccard_join
from stratalith.llm.components import components
from stratalith.llm.jaccard_join import can_link, forest, join, keep_first, overlap, prefix

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, percent):
    sets = [shingles(x, n) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def check(docs, texts, n=3, percent=90):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(docs, n, percent).collect()}
    assert got == brute(texts, n, percent)


def near(seed, sizes=(1, 2, 3, 8, 12, 25, 60, 150)):
    rnd = random.Random(seed)
    texts = []
    for size in sizes:
        base = [f"W{rnd.randrange(400)}" for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(size)] = rnd.choice(["x", "y", f"z{rnd.randrange(50)}"])
            texts.append(" ".join(own[: size - rnd.randrange(0, 2)]))
    line = "this very common line is in many documents that have nothing else in common"
    texts += [line + " " + " ".join(f"q{rnd.randrange(900)}" for _ in range(rnd.randrange(5, 90))) for _ in range(60)]
    rnd.shuffle(texts)
    return texts + texts[:10] + [None, ""]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 60)])
def test_against_brute_force(spark, n, percent):
    texts = near(n)
    check(frame(spark, texts), texts, n, percent)


@pytest.mark.parametrize("heavy,sets,cost,bits", [(3, 8_000, 1, 28), (256, 5, 1, 28), (2, 3, 0, 28), (2, 8_000, 20, 28), (2, 8_000, 1, 8)])
def test_order_blocks_and_boundary_change_no_link(spark, monkeypatch, heavy, sets, cost, bits):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", sets)
    monkeypatch.setattr(jaccard_join, "ENTRY_COST", cost)
    monkeypatch.setattr(jaccard_join, "MAX_BITS", bits)
    texts = near(7)
    check(frame(spark, texts), texts, 3, 80)


def test_edge_cases_and_documents(spark, edge, edge_texts):
    check(edge, edge_texts)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(frame(spark, texts), texts)
    check(frame(spark, texts), texts, 5, 80)


def test_null_ids_link_but_name_nothing(spark):
    rows = [(5, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "A b c d")]
    got = join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 2), (None, 2, 2), (None, 1, None), (2, 2, 2)], key=str)


def test_prefixes_and_sizes():
    for percent in (60, 80, 90):
        for n in range(1, 60):
            linked = [m for m in range(1, 120) if 100 * min(n, m) >= percent * max(n, m)]
            assert all(overlap(n, m, percent) == min(o for o in range(n + m) if 100 * o >= percent * (n + m - o)) for m in linked)
            assert prefix(n, percent) == min(n, max(n - overlap(n, m, percent) + 1 for m in linked))
            assert can_link(n, percent) == any(overlap(n, m, percent) <= min(n, m) and (m != n or overlap(n, m, percent) < n) for m in linked)


def test_sparse_and_dense_counts_agree():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, 28).astype(np.uint64)) for _ in range(50)]
    want = forest(sets, 42)
    assert 1 < len(set(want.tolist())) < 50 and forest(sets, 42, dense=0).tolist() == want.tolist()
    links = [(i, j) for i in range(50) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 42 * len(np.union1d(sets[i], sets[j]))]
    label = list(range(50))
    for _ in range(50):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert label == want.tolist()


def test_groups_of_near_copies_cost_few_rows_of_overlaps():
    rnd = np.random.default_rng(3)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.unique(np.append(np.delete(base, rnd.integers(0, 100, 2)), np.uint64(1000 + i % 7))) for i in range(400)]
    sets += [np.arange(5000 + 200 * i, 5100 + 200 * i, dtype=np.uint64) for i in range(5)] + [sets[0][:50]]
    for dense in (0, 12_000_000):
        label = forest(sets, 90, dense)
        assert set(label[:400]) == {0} and label[400:].tolist() == list(range(400, 406))


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_first(spark, empty):
    texts = near(3)
    docs = frame(spark, texts)
    want = {i for i, (_, c) in brute(texts, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in keep_first(docs).collect()} == want
    again = keep_first(docs.union(docs)).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in again} == want and all(r["count"] == (1 if texts[r["doc_id"]] else 2) for r in again)
    named = docs.selectExpr("*", "1 as _mark", "2 as mark", "3 as _n", "4 as _k", "5 as _rows")
    assert {r["doc_id"] for r in keep_first(named).where("_mark = 1 and mark = 2 and _n = 3 and _k = 4 and _rows = 5").collect()} == want
    assert keep_first(empty).count() == 0 and join(empty).count() == 0


def test_keep_first_of_repeated_ids_with_different_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept([(5, text("a")), (5, text("b")), (9, text("c"))]) == [(5, text("a")), (5, text("b")), (9, text("c"))]
    assert kept([(3, text("a")), (5, text("a") + " end"), (5, text("b"))]) == [(3, text("a")), (5, text("b"))]


def test_keep_first_of_null_and_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a") + " end"), (4, text("b")), (None, text("b") + " end"), (7, text("c")), (7, text("d")), (3, text("d") + " end"), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id bigint, text string, k string")
    got = sorted(((r["doc_id"], r["text"]) for r in keep_first(docs).collect()), key=str)
    ends = [x for x in got if x[0] is None and x[1]]
    assert len(ends) == 1 and ends[0][1] in (text("a"), text("a") + " end")
    assert [x for x in got if x not in ends] == sorted([(4, text("b")), (7, text("c")), (3, text("d") + " end"), (7, None), (None, "")], key=str)
