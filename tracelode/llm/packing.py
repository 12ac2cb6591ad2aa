"""Documents packed into sequences of bounded length by linear grouping.

Lengths are whole numbers up to the capacity, so their histogram, of at most that many rows, describes the
corpus exactly. From it the driver makes the plan: large lengths, in order, form groups of equal cardinality and
are rounded up to the largest of their group; configurations of these few sizes are optimised by column
generation; actual lengths take the places of rounded ones; small ones, and what the configurations leave over,
go where they fit best. The plan is a list of runs of like sequences, as long as there are different lengths, not
documents; tasks look up each piece by its length and its rank among pieces of that length.

Defined cases: null text is empty (one id); pieces longer than the capacity are cut, all but the last to full
length; equal rows are packed one by one; an empty table gives an empty plan.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm import rolling
from tracelode.llm.byte_bpe import slices
from tracelode.llm.common import row_key
from tracelode.session import cut

CAPACITY = 2048
END_ID = 0
#: Large lengths are above capacity / LARGE; they form GROUPS groups of equal cardinality.
LARGE = 8
GROUPS = 48
#: Tables of the rank offsets have at most this many parts for each length.
RANK_PARTS = 256
CACHE_SIZE = 400_000
PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_characters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids of words without white space, as the tokenizer gives them.

    Lower-case letters, digits and signs below U+0250 need no normalisation but lower case, so their pre-tokens
    go to the tokenizer's model directly; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile(r"[!-~¡-ɏ]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.characters = byte_characters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, pre: str) -> bytes:
        found = self.parts.get(pre)
        if found is None:
            text = pre if pre.isascii() else "".join([self.characters[b] for b in pre.encode()])
            found = self.parts[pre] = array("I", [token.id for token in self.model.tokenize(text)]).tobytes()
        return found

    def ids(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text) and "<|" not in text and "İ" not in text:
            text = text.lower()
            return self.part(text) if text.isalpha() else b"".join([self.part(pre) for pre in self.split(text)])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        if len(self.known) > CACHE_SIZE or len(self.parts) > CACHE_SIZE:
            self.known, self.parts = {}, {}
        out = list(map(self.known.get, vocabulary))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.known[vocabulary[i]] = self.ids(vocabulary[i])
        return np.frombuffer(b"".join(out), np.uint32), np.array(list(map(len, out)), np.int64) // 4


def token_ids(texts: list[str], words: WordIds) -> list[np.ndarray]:
    """The ids of each text, followed by the end id."""
    index, counts, vocabulary = rolling.index_words(texts)
    flat, lengths = words.of(vocabulary)
    begin = np.cumsum(lengths) - lengths
    n = lengths[index]
    total = np.cumsum(n)
    ids = flat[np.repeat(begin[index] - (total - n), n) + np.arange(int(n.sum()))] if len(index) else flat[:0]
    ends = np.append(0, total)[np.cumsum(counts)]
    end = np.array([END_ID], np.uint32)
    return [np.append(x, end) for x in np.split(ids, ends[:-1])]


def piece_batches(batches: Iterable[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    words = WordIds(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in slices([len(t) for t in texts], 4 << 20):
            rows = []
            for key, doc, ids in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), token_ids(texts[a:b], words), strict=True):
                rows += [
                    (key, doc, i // capacity, i, len(part := ids[i:i + capacity]), zlib.crc32(part.astype("<u4").tobytes()))
                    for i in range(0, len(ids), capacity)
                ]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and checksum of ids of every piece."""
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: piece_batches(batches, tokenizer, capacity), PIECES)


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The fullest-valued multiset of sizes that fits: an unbounded knapsack over all capacities."""
    best = np.zeros(capacity + 1)
    steps = []
    for s, v in zip(sizes, value, strict=True):
        rows = -(-(capacity + 1) // s)
        grid = np.full(rows * s, -np.inf)
        grid[: capacity + 1] = best
        grid = grid.reshape(rows, s) - np.arange(rows)[:, None] * v
        best = (np.maximum.accumulate(grid, 0) + np.arange(rows)[:, None] * v).ravel()[: capacity + 1]
        steps.append(best)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        before = steps[k - 1] if k else np.zeros(capacity + 1)
        while room >= sizes[k] and steps[k][room] > before[room] + 1e-12:
            counts[k] += 1
            room -= sizes[k]
    return counts, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns of few sizes and how often to use each, rounded down: the linear relaxation by column generation."""
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    use = demand / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        pattern, value = best_pattern(sizes, np.maximum(dual, 0), capacity)
        if value <= 1 + 1e-9:
            break
        column = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        use = np.maximum(use - step * column, 0)
        use[leave] = step
        basis[:, leave] = pattern
    return [(basis[:, j].round().astype(np.int64), int(use[j] + 1e-9)) for j in range(k) if use[j] >= 1]


class Plan:
    """Runs of like sequences: each has a first sequence, a count, and the lengths placed so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.taken: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.placed.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if not self.room[room]:
                insort(self.rooms, room)
            self.room[room].append((sequence, count))

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def fit(self, length: int, count: int) -> None:
        """Place `count` pieces of one length, each where the least room is left; open sequences for the rest."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                bins = -(-count // each)
                self.leave(self.capacity, self.open(bins), bins)
                continue
            room = self.rooms[at]
            sequence, n = self.room[room].pop()
            if not self.room[room]:
                self.rooms.pop(at)
            each = min(room // length, -(-count // n))
            if count < n:
                self.leave(room, sequence + count, n - count)
                n, each = count, 1
            elif each * n > count:
                each = count // n
            for i in range(each):
                self.put(length, n, sequence, self.capacity - room + i * length)
            count -= each * n
            self.leave(room - each * length, sequence, n)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> Plan:
    """Which ranks of which lengths go to which sequences, and where."""
    out, left = Plan(capacity), dict(histogram)
    if full := left.pop(capacity, 0):
        out.put(capacity, full, out.open(full), 0)
    big = sorted((n for n in left if n > capacity // large), reverse=True)
    total = sum(left[n] for n in big)
    if total:
        # Groups of equal cardinality; one length may be in several.
        bound = np.unique(np.linspace(0, total, min(groups, total) + 1).round().astype(np.int64))
        members: list[list[list[int]]] = [[] for _ in range(len(bound) - 1)]
        at = g = 0
        for n in big:
            m = left[n]
            while m:
                part = min(m, int(bound[g + 1]) - at)
                members[g].append([n, part])
                at, m = at + part, m - part
                g += at == bound[g + 1]
        # Groups with the same largest length are one size.
        merged: dict[int, list[list[int]]] = defaultdict(list)
        for some in members:
            merged[some[0][0]] += some
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(m for _, m in merged[s]) for s in sizes], float)
        for pattern, times in configurations(sizes, demand, capacity):
            places = [int(s) for s, m in zip(sizes, pattern, strict=True) for _ in range(m)]
            sequence = out.open(times)
            runs = [(sequence, times, 0)]
            for size in places:
                queue, after = merged[size], []
                for first, n, offset in runs:
                    while n and queue:
                        length, m = queue[0]
                        part = min(n, m)
                        out.put(length, part, first, offset)
                        after.append((first, part, offset + length))
                        first, n, queue[0][1] = first + part, n - part, m - part
                        left[length] -= part
                        if not queue[0][1]:
                            queue.pop(0)
                    if n:
                        after.append((first, n, offset))
                runs = after
            for first, n, offset in runs:
                out.leave(capacity - offset, first, n)
    for length in sorted((n for n in left if left[n]), reverse=True):
        out.fit(length, left[length])
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Each piece's rank among the pieces of its length, counted by parts so that no length meets in one task."""
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("row_key"), F.lit(RANK_PARTS)))
    counts = parts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    return parts.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("own")).drop("part", "own", "before", "row_key")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence that holds it and its offset there."""
    pieces = cut(cut_pieces(docs, tokenizer, capacity))
    # At most `capacity` rows, and the plan has a few runs for each of them.
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    made = plan({r["length"]: r["n"] for r in rows}, capacity)
    table = np.array(sorted(made.placed), np.int64).reshape(-1, 5)
    wide = 1 << 48

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(table[:, 0] * wide + table[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    return ranked(pieces).withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
