"""Compressed exchange of fingerprints between chunks of rows and the owners of fingerprint ranges.

A chunk sends each owner the sorted distinct fingerprints of the owner's range, coded as Golomb-Rice
differences. An owner decodes what all chunks sent it for one range, finds which fingerprints are shared, and
answers each chunk with one value per fingerprint, in the order sent. Chunks and ranges are sized by the
caller, so that neither side holds more than a fixed share of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "shard int, chunk long, data binary"
REPLY = "chunk long, shard int, data binary"
#: The owner's range of a fingerprint is its top bits.
MAX_SHARD_BITS = 24


def shard_bits(total: int, each: int) -> int:
    """Top bits that deal `total` fingerprints into ranges of about `each`."""
    return min(MAX_SHARD_BITS, max(3, int(max(1, total / each) - 1).bit_length()))


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Rice-coded differences: header, unary quotients, packed remainders."""
    n = len(values)
    if n == 0:
        return np.zeros(4, np.uint64).tobytes()
    gaps = np.diff(values)
    mean = max(1, int(values[-1] - values[0]) // max(1, n - 1))
    k = mean.bit_length() - 1
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n > 1 else 0, np.uint8)
    unary[ends] = 0
    unary = np.packbits(unary)
    planes = np.empty((k, n - 1), np.uint8)
    for j in range(k):
        planes[j] = (gaps >> np.uint64(j)).astype(np.uint8) & 1
    head = np.array([n, k, len(unary), values[0]], np.uint64)
    return head.tobytes() + unary.tobytes() + np.packbits(planes.ravel()).tobytes()


def rice_decode(data: bytes, start: int = 0) -> tuple[np.ndarray, int]:
    """The values of `rice_encode` and where they end in `data`."""
    head = np.frombuffer(data, np.uint64, 4, start)
    n, k, length = int(head[0]), int(head[1]), int(head[2])
    at = start + 32
    if n <= 1:
        return head[3:3 + n].copy(), at
    unary = np.unpackbits(np.frombuffer(data, np.uint8, length, at))
    ends = np.flatnonzero(unary == 0)[: n - 1]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64)
    gaps -= np.uint64(1)
    gaps <<= np.uint64(k)
    at += length
    packed = -(-k * (n - 1) // 8)
    planes = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=k * (n - 1)).reshape(k, n - 1)
    for j in range(k):
        gaps |= planes[j].astype(np.uint64) << np.uint64(j)
    out = np.empty(n, np.uint64)
    out[0] = head[3]
    out[1:] = gaps
    return np.cumsum(out, dtype=np.uint64), at + packed


def ranges(sorted_values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners that sorted fingerprints belong to, and where each owner's part begins (with the end)."""
    owner = (sorted_values >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[starts], np.append(starts, len(sorted_values))


def messages(chunk: int, values: np.ndarray, bits: int, extra: np.ndarray | None = None) -> pa.Table:
    """One message for each owner: the coded fingerprints, then the bytes in `extra` aligned with them."""
    owner, starts = ranges(values, bits)
    data = [
        rice_encode(values[a:b]) + (b"" if extra is None else extra[a:b].tobytes())
        for a, b in zip(starts[:-1], starts[1:], strict=True)
    ]
    return pa.table({
        "shard": pa.array(owner, pa.int32()), "chunk": pa.array([chunk] * len(owner), pa.int64()),
        "data": pa.array(data, pa.binary()),
    })


def replies(answers: DataFrame | pa.Table, skip: int = -1) -> dict[int, bytes]:
    """An owner's answers by shard; `skip` marks rows that are something else."""
    return {s: d for s, d in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True) if s != skip}


def own(sent: DataFrame, answer: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray], coder: Callable) -> DataFrame:
    """Let the owner of each range answer.

    `answer(values, chunk, rest)` gets all fingerprints of the range, the chunk of each and what followed the
    coded values in each message; it returns one value per fingerprint. `coder` turns a chunk's part to bytes.
    Messages come in ascending order of chunk.
    """

    def act(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, parts, rest = table["chunk"].to_pylist(), [], []
        for blob in table["data"]:
            blob = blob.as_py()
            values, end = rice_decode(blob)
            parts.append(values)
            rest.append(blob[end:])
        counts = [len(p) for p in parts]
        values = np.concatenate(parts)
        found = answer(values, np.repeat(np.array(chunks, np.int64), counts), rest)
        cuts = np.cumsum(counts)[:-1]
        return pa.table({
            "chunk": pa.array(chunks, pa.int64()), "shard": table["shard"],
            "data": pa.array([coder(x) for x in np.split(found, cuts)], pa.binary()),
        })

    return sent.groupBy("shard").applyInArrow(act, REPLY)


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def unpack(answers: dict[int, bytes], values: np.ndarray, bits: int, read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
    """The owners' answers for a chunk's sorted fingerprints, in their order."""
    owner, starts = ranges(values, bits)
    parts = [read(answers[int(o)], int(b - a)) for o, a, b in zip(owner, starts[:-1], starts[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def read_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n)
