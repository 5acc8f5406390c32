"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest tokens of a piece of text. A sequence of tokens is what the
merges give exactly if each neighbouring pair is compatible: no merge across its border would have come before the merges
inside the two tokens. The encoder takes the longest token at each place, falls back to the next shorter one that is a
prefix of it, and steps back when none is left; a place once given up is never tried again, so the time is linear.
Decoding gathers the bytes of all tokens from one table at computed offsets.

Nulls: a null text is encoded as an empty one. Empty texts have no tokens. Repeated rows are encoded one by one; an empty
table gives an empty result; extra columns are ignored. Long texts, with or without blanks, are encoded whole in linear time;
the answers that a worker keeps are bounded in number and length. Ties: there is one sequence that the merges give. The text of
a special token becomes that token, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import released
from .shared import table

#: The contractions that the pattern of the vocabulary splits off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pieces and pairs of tokens whose answers a worker keeps; a longer piece than KEPT_CHARS is not kept.
MAX_PIECES, MAX_PAIRS, KEPT_CHARS = 150_000, 300_000, 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept(dict):
    """Answers for the pieces asked last: the younger half, and the older half as it was when the younger one was full."""

    def __init__(self, answer):
        super().__init__()
        self.answer, self.old = answer, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.answer(piece)
            if len(piece) > KEPT_CHARS:
                return got
        if len(self) >= MAX_PIECES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path, encoding="utf-8"))
        self.symbols = byte_symbols()
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(self.symbols[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        # rank: when a token's merge comes; single bytes come first. parts: what the merge joins.
        self.rank = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.joins[left, right] = n
            if self.rank[whole] < 0 and len(self.bytes_of[whole]) > 1:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1) for i, b in self.bytes_of.items()}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        top = max([*self.bytes_of, *self.special.values()]) + 1
        pieces = [self.bytes_of.get(i, b"") for i in range(top)]
        for s, i in self.special.items():
            pieces[i] = s.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.fits: dict[int, bool] = {}
        self.packed = Kept(lambda piece: array("i", self.encode_piece(piece.encode("utf-8", "surrogateescape"))).tobytes())
        self.decimal = list(map(str, range(top)))
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = {s[0] for s in self.special}
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is not a byte-level vocabulary without normaliser")
        self.library = ByteLevel(add_prefix_space=split["add_prefix_space"], use_regex=split["use_regex"])
        self.pattern, self.plain = self._pattern()

    def _pattern(self):
        """The pattern for texts of common characters, whose classes are asked of the library's own splitter."""
        classes: dict[str, list[str]] = {"L": [], "N": [], "S": [], "O": []}
        pieces = lambda s: len(self.library.pre_tokenize_str(s))
        common = [chr(c) for c in (*range(0x530), *range(0x2010, 0x2028), 0x20AC, 0x2122)]
        for c in common:
            classes["L" if pieces("a" + c) == 1 else "N" if pieces("1" + c) == 1 else "O" if pieces("!" + c) == 1 else "S"].append(re.escape(c))
        k = {n: "".join(v) for n, v in classes.items()}
        some = f"{CONTRACTIONS}| ?[{k['L']}]+| ?[{k['N']}]+| ?[{k['O']}]+|[{k['S']}]+(?![{k['L']}{k['N']}{k['O']}])|[{k['S']}]+"
        return re.compile(some), re.compile(f"[{''.join(map(re.escape, common))}]*\\Z")

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens; merges never cross their borders."""
        if text.isascii() or self.plain.match(text):
            return self.pattern.findall(text)
        return [bytes(self.symbols[c] for c in s).decode() if s.isascii() else self._text(s) for s, _ in self.library.pre_tokenize_str(text)]

    def _text(self, symbols: str) -> str:
        return bytes(self.symbols[c] for c in symbols).decode("utf-8", "surrogateescape")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges give a then b for the bytes of both: they never join what lies on both sides of the border."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both sides from the last to the first. A join of the two parts at the border that comes before
        # the merge which next takes one of them up (at equal rank the left one comes first) would have happened.
        limit = (len(self.joins) + 1, 0)
        while True:
            n = self.joins.get((a, b))
            if n is not None and (n, 0) < limit:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                limit, a = (self.rank[a], 0), self.parts[a][1]
            else:
                limit, b = (self.rank[b], 1), self.parts[b][0]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None:
            return [whole]
        text, n, fits, long = data.decode("latin-1"), len(data), self.fits, self.automaton.iter_long
        out: list[int] = []
        greedy = long(text)  # the longest token at each border, as long as each is taken
        last = at = 0
        for end, i in greedy:
            if out and not (fits.get(last << 32 | i) or self.compatible(last, i)):
                break
            out.append(i)
            last, at = i, end + 1
        else:
            return out
        size, shorter, closed = self.size, self.shorter, bytearray(n + 1)
        while at < n:
            while i >= 0:
                end = at + size[i]
                if not closed[end] and (not out or fits.get(out[-1] << 32 | i) or self.compatible(out[-1], i)):
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at = end
                if at < n:
                    i = next(long(text, at))[1]
            else:
                closed[at] = 1
                i = out.pop()
                at -= size[i]
                i = shorter[i]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, as an array and in decimal."""
        parts = self.splitter.split(text) if any(m in text for m in self.marks) else [text]
        packed = []
        for n, part in enumerate(parts):
            if n % 2:
                packed.append(array("i", [self.special[part]]).tobytes())
            elif part:
                packed += map(self.packed.__getitem__, self.pieces(part))
        ids = np.frombuffer(b"".join(packed), np.int32)
        return ids, ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: place k of the result is taken from the table at its token's offset."""
        out = []
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[part] - (ends - n), n)].tobytes())
        return b"".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokens(docs: DataFrame, path: str | None = None, text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text (if wanted), and the SHA-256 of the decimal ids and of the decoded text."""
    path = path or vocabulary_path()
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * text

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            yield from encoded(own, batches)
        finally:
            _CODECS.clear()  # an idle worker holds no vocabulary

    def encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for value in part.column("text"):
                    ids, decimal = own.encode(value.as_py() or "")
                    back = own.decode(ids).decode("utf-8", "replace")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if text:
                        all_ids.append(ids)
                        decoded.append(back)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if text:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"), text=False)
