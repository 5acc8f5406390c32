import hashlib
import random
import re

from conftest import frame
from stratalith.llm import decontaminate
from stratalith.llm.decontaminate import contaminated, remove

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for item, x in items:
        t = words(x)
        if not t:
            continue
        n = min(window, len(t))
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams]
        hit |= {i + d for i in at for d in range(n)}
        if at and item is not None:
            found.add(str(item))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def check(spark, docs, texts, items, window=10):
    got = {r["doc_id"]: tuple(r)[1:] for r in contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), window).collect()}
    assert got == {i: brute(x, items, window) for i, x in enumerate(texts)}


def fixture():
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choices("abcd", k=rnd.randrange(1, 9)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "A-b a,B"), (43, items[3][1]), (100, "ÉTÉ été a"), (None, "c c c c c c")]
    texts = [" ".join(rnd.choices("abcdX", k=rnd.randrange(0, 60))) for _ in range(60)]
    return items, texts


def test_small_alphabets_against_brute_force(spark):
    items, texts = fixture()
    for window in (1, 3, 5):
        check(spark, frame(spark, texts), texts, items, window)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, texts = fixture()
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (200,))
    check(spark, frame(spark, texts), texts, items, 4)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    check(spark, frame(spark, texts), texts, items, 4)


def test_five_blocks_are_one_stage(spark, monkeypatch):
    items, texts = fixture()
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (sum(len((x or "").encode()) for _, x in items) * 2 // 5 + 1,))
    found = decontaminate.spans(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(list(decontaminate.blocks(spark.createDataFrame(items, "item_id bigint, text string"), 4))) == 5
    assert plan.count("MapInArrow") == 1


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five", "a", "b", "c"), (1, "x one two three y and more words", "d", "e", "f")], "doc_id bigint, text string, _words string, _hits string, _items string")
    got = remove(docs, spark.createDataFrame([(1, "one two three")], "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "x \n y and more words", "d", "e", "f")]


def test_edge_cases(spark, edge, edge_texts):
    items = [(1, "same LINE same line same"), (2, edge_texts[-6]), (3, "漢字 kana"), (4, "w1"), (5, None)]
    check(spark, edge, edge_texts, items)


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    texts = [r["text"] for r in rows]
    check(spark, frame(spark, texts), texts, items)


def test_empty_tables(spark, empty, edge):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(empty, none).count() == 0
    assert contaminated(edge, none).where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_remove_cuts_spans_and_drops_covered_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["é start here " + item.upper() + " and a long rest of words that is clean and stays as it was before", item, "clean", None]
    got = {r["doc_id"]: r["text"] for r in remove(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {0: "é start here \n and a long rest of words that is clean and stays as it was before", 2: "clean", 3: None}
