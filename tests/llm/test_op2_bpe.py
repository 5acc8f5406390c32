import hashlib
import random

from conftest import frame
from stratalith.llm.bpe import codec, tokens, vocabulary_path
from tokenizers import Tokenizer


def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def hostile():
    rnd = random.Random(11)
    some = ["a", "e", "th", "ing", " ", "  ", "\n", "'", "'s", "é", "ß", "1", "99", "-", "=", "<|endoftext|>", "<", "漢", "🙂", "՘", "\x1c", "\xa0", " ", "​", "ÿ", "—", "’", "€"]
    return ["".join(rnd.choices(some, k=rnd.randrange(1, 40))) for _ in range(1500)] + ["a" * 3000, "=" * 999, " " * 500 + "x", "ab" * 700, "<|endoftext|>" * 3]


def test_ids_are_those_of_the_library():
    own, lib = codec(vocabulary_path()), library()
    texts = hostile()
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decimal = own.encode(text)
        assert ids.tolist() == want.ids, text
        assert decimal == ",".join(map(str, want.ids))
        assert own.decode(ids).decode() == lib.decode(want.ids, skip_special_tokens=False) == text


def test_backtracking_alone_equals_the_merges():
    own, lib = codec(vocabulary_path()), library()
    rnd = random.Random(3)
    for _ in range(3000):
        piece = "".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 24)))
        want = lib.encode(piece, add_special_tokens=False).ids
        assert own.encode_piece(piece.encode()) == want


def check(docs, texts):
    lib = library()
    got = {r["doc_id"]: r for r in tokens(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (text or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_cases(edge, edge_texts):
    check(edge, edge_texts)


def test_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(frame(spark, texts), texts)


def test_empty_table(empty):
    assert tokens(empty).count() == 0


def test_long_texts_without_blanks_and_repeated_rows(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choices("abcdefgh漢字", k=60_000))
    texts = [long, long, "x" * 200_000]
    check(frame(spark, texts), texts)
    own = codec(vocabulary_path())
    own.packed.clear()
    own.encode(long)
    assert all(len(k) <= 48 for k in own.packed)
