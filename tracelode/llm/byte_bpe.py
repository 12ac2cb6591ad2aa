"""Byte-level BPE with a model serialised from a rank file.

The vocabulary of ranks becomes a sentencepiece BPE model: each byte is written as one character, each token as
the characters of its bytes, and its score is the negative rank, so that the model merges by rank. The
normaliser is the identity. Texts are split into pre-tokens by the pattern of the vocabulary; each pre-token is
encoded by itself. Decoding maps ids back to bytes.

Defined cases: null text is empty and has no ids; repeated rows are encoded one by one; whole texts of any length
are encoded.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Byte b is written as this character plus b: no white space, no letter of another role.
FIRST_CHAR = 0x100
#: Entries after which a task's caches start anew; they change speed only.
CACHE_SIZE = 400_000
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def as_text(data: bytes) -> str:
    return "".join([chr(FIRST_CHAR + b) for b in data])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model: one piece per token, scored by negative rank, and an unknown piece at the end."""
    pieces = [
        _block(1, _block(1, as_text(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
        for rank, token in enumerate(tokens)
    ]
    unknown = _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    # Trainer: BPE, size, unknown id, no begin, end or padding piece. Normaliser: identity, nothing added or removed.
    none = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(
        _number(field, none) for field in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Texts to packed ids, by pre-token. Words that recur are looked up."""

    #: A single space between two characters that no definition of white space holds: pre-tokens never cross it.
    CLEAN = re.compile(r"(?<=\S) (?=\S)")
    DOUBTFUL = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """The text in parts whose pre-tokens are those of the text; all but the first begin with a space."""
        parts = text.split(" ") if not self.DOUBTFUL.search(text) else self.CLEAN.split(text)
        return parts[:1] + [" " + part for part in parts[1:]]

    def learn(self, segments: Iterable[str]) -> None:
        """Encode segments that are new."""
        new = [s for s in set(segments) if s not in self.known]
        found = [self.find(s) for s in new]
        pre = list({p for some in found for p in some})
        raw = [p.encode() for p in pre]
        hard = [i for i, r in enumerate(raw) if r not in self.rank]
        ids = {p: [self.rank[r]] for p, r in zip(pre, raw, strict=True) if r in self.rank}
        for i, out in zip(hard, self.model.encode([as_text(raw[i]) for i in hard], num_threads=1), strict=True):
            ids[pre[i]] = out
        for s, some in zip(new, found, strict=True):
            flat = [i for p in some for i in ids[p]]
            self.known[s] = struct.pack(f"<{len(flat)}I", *flat)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_SIZE:
            self.known = {}
        split = [self.segments(t) for t in texts]
        self.learn(s for some in split for s in some)
        return [b"".join(map(self.known.__getitem__, some)) for some in split]


def slices(lengths: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `limit` characters; a longer one stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_batches(batches: Iterable[pa.RecordBatch], make: Callable[[], Encoder]) -> Iterator[pa.RecordBatch]:
    encoder = make()
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            ids = encoder.encode(texts[a:b])
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
            ], ["doc_id", "n_tokens", "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    token = tokens.__getitem__
    for batch in batches:
        decoded = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])


def _maker(vocabulary: str, pattern: str) -> tuple[list[bytes], Callable[[], Encoder]]:
    tokens = read_ranks(vocabulary)
    model = serialise(tokens)
    return tokens, lambda: Encoder(model, tokens, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the ids, packed as little-endian unsigned 32-bit integers."""
    _, make = _maker(vocabulary, pattern)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(lambda batches: encode_batches(batches, make), ENCODED)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of `encode` with the bytes that their ids stand for."""
    tokens = read_ranks(vocabulary)
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(lambda batches: decode_batches(batches, tokens), DECODED)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """`decode(encode(docs))` in one pass."""
    tokens, make = _maker(vocabulary, pattern)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(lambda batches: decode_batches(encode_batches(batches, make), tokens), DECODED)
