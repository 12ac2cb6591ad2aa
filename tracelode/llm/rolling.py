"""Words of many texts as index arrays, and Rabin-Karp hashes of their windows, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Odd bases of the two hash lanes; their inverses modulo 2^64 exist because they are odd.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


class _Vocabulary(dict):
    """Words to indexes, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        index = self[word] = len(self)
        return index


def index_words(texts: Iterable[str | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Index of every word, words per text, and the vocabulary. White space is `[\\x20\\x09-\\x0D]`; null has none."""
    vocabulary = _Vocabulary()
    get, parts, counts = vocabulary.__getitem__, [], []
    for text in texts:
        data = (text or "").encode()
        found = (data.translate(FOLD) if fold else data).split()
        counts.append(len(found))
        parts.append(np.fromiter(map(get, found), np.int32, len(found)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64), list(vocabulary)


def digests(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in vocabulary), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all bits, so that its top bits deal evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def roll(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Rabin-Karp hash of each `width` consecutive values: differences of a running sum, moved to one origin."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    base = BASES[lane]
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), dtype=np.uint64, out=running[1:])
    return mix((running[width:] - running[:-width]) * _powers(pow(base, -1, 1 << 64), n - width + 1))


def inside(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and that text's place."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(text) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1:])
    return starts, text[starts]
