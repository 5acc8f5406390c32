import zlib

import numpy as np
from conftest import frame
from pyspark.sql import functions as F
from stratalith.llm import language_id
from stratalith.llm.language_id import family, fit, has_letter, keep_known, predict, sample, vector

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = predict(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97


def test_prediction_reads_the_text_alone(spark):
    docs = spark.read.parquet(DOCS)
    model = fit(docs)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("?")})
    a = {r["text"]: r["_lang"] for r in language_id.with_language(docs, model).collect()}
    b = {r["text"]: r["_lang"] for r in language_id.with_language(other, model).collect()}
    assert a == b


def test_pieces_of_long_texts_count_each_gram_once(monkeypatch):
    text = "abc déf ghi " * 50
    whole = vector(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert np.allclose(vector(text), whole)


def test_edge_cases(spark, edge, edge_texts):
    got = {r["doc_id"]: r for r in predict(edge).collect()}
    assert len(got) == len(edge_texts)
    for i, text in enumerate(edge_texts):
        assert (got[i]["lang_pred"] == "und") == (not has_letter(text))
        if has_letter(text):
            assert got[i]["lang_pred"] == "en" and got[i]["score"] == 1.0  # the only language learned
    kept = keep_known(edge)
    assert kept.columns == edge.columns and kept.count() == sum(map(has_letter, edge_texts))


def test_no_labels_and_empty_table(spark, empty):
    assert predict(empty).count() == 0
    none = frame(spark, ["some words", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predict(none).collect()} == {"und"}


def test_no_labels_keep_texts_with_letters(spark):
    none = frame(spark, ["some words", None, "12 34", "été"]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in keep_known(none).collect()} == {0, 3}


def test_a_family_of_its_own_for_languages_not_listed(spark):
    texts = ["xq zx qq xz " * 5, "the and of to " * 5, "der die und das " * 5] * 40
    langs = ["qx", "en", "de"] * 40
    docs = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, langs, strict=True))], "doc_id bigint, text string, lang string")
    assert all(r["lang_pred"] == langs[r["doc_id"]] for r in predict(docs).collect())


def plain_prediction(model, text):
    """The two steps written out: every duel counted on its own, with plain sums over the features."""
    if not has_letter(text):
        return "und", 0.0
    x = vector(text).astype(float)
    margin = {p: sum(x[i] * float(model.weights[i, k]) for i in np.flatnonzero(x)) + float(model.offsets[k]) for k, p in enumerate(model.pairs)}

    def winner(options):
        table = {o: [0, 0.0, 1.0] for o in options}
        for (a, b), m in margin.items():
            if a in table and b in table:
                p = 1 / (1 + np.exp(-4 * m))
                table[a if m >= 0 else b][0] += 1
                for o, sign, q in ((a, 1, p), (b, -1, 1 - p)):
                    table[o][1] += sign * m
                    table[o][2] = min(table[o][2], q)
        best = sorted(table, key=lambda o: (-table[o][0], -table[o][1], o))[0]
        return best, table[best][2]

    kin, p = winner(sorted({family(v) for options in model.families.values() for v in options}))
    lang, q = winner(model.families[kin])
    return lang, p * q


def test_predictions_equal_plain_duels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs)
    for r in predict(docs).join(docs, "doc_id").collect():
        lang, score = plain_prediction(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_the_sample_is_bounded_and_even(spark):
    docs = spark.read.parquet(DOCS)
    x, langs = sample(docs, 80)
    assert len(x) == len(langs) == 80 and {langs.count(v) for v in set(langs)} == {80 // len(set(langs))}
    many = frame(spark, ["some words here"] * 500).withColumn("doc_id", F.lit(2).cast("bigint"))
    assert len(sample(many.withColumn("lang", F.lit("en")), 80)[1]) == 1  # rows equal in all count once


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", "a", "b")] * 3 + [(2, "12", "en", "a", "b")], "doc_id bigint, text string, lang string, _lang string, _score string")
    assert len(predict(docs).collect()) == 4
    assert [tuple(r) for r in keep_known(docs).collect()] == [(1, "the and of", "en", "a", "b")] * 3
