import random

import pytest

#: Columns of documents that bear the operators' own names.
OWN = ("_lang", "_score", "_spans", "_words", "_hits", "_items", "_rows", "_n", "_k", "_x", "_mark", "mark", "tokens", "text_", "copies", "source_")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, kind=KIND, **more):
    """documents of the given texts; doc_id counts from 0."""
    rows = [(i, x, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 2}", 0) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, ties, repeats, other scripts, odd blanks, symbols and one long text."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "straße", "a", "the", "x1"]
    prose = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 3, 4, 9, 10, 49, 50, 51, 120)]
    long = " ".join(f"w{rnd.randrange(900)}" for _ in range(30_000))
    return [
        None, "", " ", "\t\n\x0b\x0c\r", "one", "same line\nsame line\nsame line", "a b c a b c a b c", *prose, prose[-1], prose[-1] + " end",
        "Ünïcödé 漢字 kana かな nbsp  em", "#*$%&|<> ## x", "x\x00y \x1c z", "🙂 emoji 👩‍👩‍👧 text", long, None, "A" * 70_000,
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_texts):
    """The table of the edge cases, with extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    docs = frame(spark, edge_texts)
    return docs.withColumns({n: F.lit("clash") for n in ("words", "n_words", "size", "shard", "row", "h", "k", "kind", "spans", "score", "kept", "id", "n", "_key", "_arc", "bits", "keys", "lines", "found", *OWN)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
