import re
from collections import Counter

from conftest import frame
from stratalith.llm.host_quality import counts, judge

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def check(docs, texts):
    got = {r["doc_id"]: tuple(r)[2:] for r in counts(docs).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)}


def test_counts_of_edge_cases(edge, edge_texts):
    check(edge, edge_texts)


def test_counts_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(frame(spark, [r["text"] for r in rows]), [r["text"] for r in rows])


def test_bad_host_goes_whole_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, good, "en", f"host{i % 8}", 0) for i in range(400)]
    rows += [(1000 + i, bad if i < 95 else good, "en", "spam", 0) for i in range(100)]
    rows += [(2000, bad, "en", "tiny", 0), (2001, good, "en", "tiny", 0), (3000, good, None, None, None)]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert not any(got[i]["kept"] for i in range(1000, 1100))
    assert all(got[i]["kept"] for i in range(400))
    assert not got[2000]["kept"] and got[2001]["kept"] and got[3000]["kept"]


def test_empty_table(empty):
    assert judge(empty).count() == 0
