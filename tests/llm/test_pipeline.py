import hashlib
import os
import re

import corpus_pipeline as cp
from stratalith.llm.decontaminate import Automaton, merged
from stratalith.llm.language_id import has_letter
from stratalith.llm.pii import base_spans
from test_op2_bpe import library
from test_op7_jaccard_join import brute as components
from test_op8_decontaminate import brute as contaminated
from test_op8_decontaminate import words as item_words

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage against a plain version of it, on its own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    names, n = docs.columns, 0
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DIR)
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows) == docs.count()
        ids = sorted(before)
        if name == "language":
            assert set(rows) == {i for i in ids if has_letter(before[i]["text"])} and all(rows[i] == before[i] for i in rows)
        elif name == "near_duplicates":
            want = components([before[i]["text"] for i in ids], 5, 80)
            assert set(rows) == {ids[k] for k, (_, c) in want.items() if c == k} and all(rows[i] == before[i] for i in rows)
        elif name == "benchmark":
            for i in ids:
                words, hit, *_ = contaminated(before[i]["text"], items, 10)
                assert (i in rows) == (hit <= 0.5 * words)
                if i in rows:
                    assert (rows[i]["text"] == before[i]["text"]) == (hit == 0)
                    assert len(item_words(rows[i]["text"])) == words - hit
        elif name == "personal_data":
            assert set(rows) == set(before)
            for i in ids:
                text, want, done = before[i]["text"], "", 0
                for a, b, k in base_spans(text):
                    if max(a, done) < b:
                        want += text[done : max(a, done)] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k]
                        done = b
                want += text[done:]
                if rows[i]["text"] != want:  # other terms went too
                    assert re.search(r"\[(TERM|NAME|NUMBER)\]", rows[i]["text"]) or len(rows[i]["text"]) < len(want)
        else:
            lib = library()
            for i in ids:
                got = lib.encode(before[i]["text"], add_special_tokens=False).ids
                assert rows[i]["ids"] == got and rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, got)).encode()).hexdigest()
        if name != "tokens":
            assert docs.columns == names
        n += 1
    assert n == 5 and Automaton([], 10).walk([]) == ([], set()) and merged([]) == []


def test_empty_documents(spark, empty, tmp_path):
    os.makedirs(tmp_path / "d")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    empty.write.parquet(str(tmp_path / "d/documents.parquet"))
    assert cp.run(spark, str(tmp_path / "d")).count() == 0


def test_edge_cases(spark, edge, tmp_path):
    os.makedirs(tmp_path / "d")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    edge.write.parquet(str(tmp_path / "d/documents.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    known = [(r["doc_id"], r["text"]) for r in edge.collect() if has_letter(r["text"])]
    groups = components([x for _, x in known], 5, 80)
    kept = [known[k] for k, (n, c) in sorted(groups.items()) if c == k or n == 0]
    lib, want = library(), {}
    for i, text in kept:
        assert contaminated(text, items, 10)[1] == 0 and not base_spans(text)
        want[i] = len(lib.encode(text, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, str(tmp_path / "d")).collect()} == want


def test_rows_without_ids_and_repeated_rows(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a")), (1, text("b")), (1, text("b")), (1, text("c")), (2, text("b") + " end"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "d/documents.parquet"))
    got = cp.run(spark, str(tmp_path / "d")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(library().encode(x, add_special_tokens=False).ids)) for i, x in ((None, text("a")), (1, text("b")), (1, text("c"))))
