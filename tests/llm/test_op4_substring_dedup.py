import hashlib
import random
import re

import pytest
from conftest import frame
from stratalith.llm.substring_dedup import dedup, difference_cover

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ids, texts, window):
    first, out = {}, []
    words = [W.findall(x or "") for x in texts]
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    for i, w in zip(ids, words, strict=True):
        gone = {p + d for p in range(len(w) - window + 1) if i is not None and first[tuple(w[p : p + window])] < i for d in range(window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31])
def test_covers(period):
    d = difference_cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))
    assert period != 31 or len(d) == 6


def passages(seed):
    rnd = random.Random(seed)
    shared = [" ".join(f"s{j}_{i}" for i in range(n)) for j, n in enumerate((9, 10, 11, 30, 80))]
    texts = []
    for _ in range(120):
        parts = [" ".join(rnd.choices("abcde", k=rnd.randrange(0, 25))) for _ in range(rnd.randrange(1, 4))]
        if rnd.random() < 0.6:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(shared))
        texts.append(rnd.choice([" ", "\n", "  \t"]).join(parts))
    return texts + texts[:15] + [None, ""]


@pytest.mark.parametrize("window,period,bloom", [(10, 7, 10**7), (10, 1, 10**7), (6, 3, 10**7), (10, 7, 0)])
def test_against_brute_force(spark, window, period, bloom):
    texts = passages(window)
    rnd = random.Random(1)
    ids = rnd.sample(range(1000), len(texts) - 6) + [3, 3, None, None, 1001, 1001]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    assert sorted(map(tuple, dedup(docs, window, period, max_bloom=bloom).collect()), key=str) == brute(ids, texts, window)


@pytest.mark.parametrize("bloom", [10**7, 0])
def test_unequal_texts_of_one_id(spark, bloom):
    passage = " ".join(f"p{i}" for i in range(12))
    ids, texts = [1, 2, 2], ["a " + passage, " ".join(f"f{i}" for i in range(90)) + " " + passage, "x y z"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").coalesce(1)
    assert sorted(map(tuple, dedup(docs, 10, 7, max_bloom=bloom).collect()), key=str) == brute(ids, texts, 10)


def test_edge_cases_and_documents(spark, edge, edge_texts):
    assert sorted(map(tuple, dedup(edge).collect()), key=str) == brute(range(len(edge_texts)), edge_texts, 50)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, dedup(frame(spark, texts)).collect()), key=str) == brute(range(len(texts)), texts, 50)


def test_text_that_stays(spark, empty):
    passage = " ".join(f"w{i}" for i in range(50))
    got = {r["doc_id"]: r["kept"] for r in dedup(frame(spark, ["a " + passage, "x\n" + passage + "  y", passage]), with_text=True).collect()}
    assert got == {0: "a " + passage, 1: "x y", 2: ""}
    assert dedup(empty).count() == 0
