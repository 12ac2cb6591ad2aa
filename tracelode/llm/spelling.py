r"""Spelling variants: words one letter apart, found in tries of letter counts.

Words are counted natively. Each word's letters are counted by group (code point modulo GROUPS); the counts, one
after the other, are its path in a trie whose leaves hold the words of equal counts. An inserted letter is a surplus
of one in one group, a deleted one a deficit of one, a replaced one both or, within a group, neither. So a depth-first
search with a budget of one surplus and one deficit reaches every word one letter apart; the words of its leaves are
verified letter by letter.

The first levels (the word's length and its first TOP_GROUPS counts) are a key that Spark deals the words by. A word
is looked for at the keys that its budget reaches, 21 of them, with the budget that is left; below, a task
searches the rest of the trie, for all keys of its shard. A key of many words is split into parts of PART_WORDS words, each of which meets each
part of the key's searches. What leaves a task is one row per search: how many words are near, and the largest of
them. So no pairs are listed, and no task holds more than parts of a fixed size.

Defined cases: null and empty texts have no runs; a null doc_id counts as empty text before the colon; a repeated row
counts each time; an empty table gives no rows. Columns other than doc_id and text are not read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import pieces, whole
from tracelode.llm.license_scan import LOWER, UPPER
from tracelode.session import cut

NOT_LETTER = r"[^A-Za-zÀ-ÿ]+"
DELETE_EVERY, MIN_LETTERS, MIN_OCCURRENCES, FORM_FACTOR = 199, 6, 5, 5
GROUPS, TOP_GROUPS = 16, 3
PART_WORDS = 20_000
SEARCH = "cell string, word string, n long, surplus int, deficit int, rest binary"
NEAR = "word string, n_near long, best_n long, best string"
#: Forms are more frequent by a factor each time, so chains are short; each round doubles what is followed.
MAX_ROUNDS = 64


def runs(text: Column) -> Column:
    """Maximal runs of letters, in lower case where they are of A-Z."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_LETTER), "")


def with_deletions(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DELETE_EVERY == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: words of enough letters and occurrences. Counted in each task before the shuffle."""
    # An outer explode: before the plain one Spark tests the array's size, which would split each text twice.
    each = docs.select("doc_id", F.explode_outer(runs(whole("text"))).alias("run")).where(F.length("run") >= MIN_LETTERS)
    counted = each.select(with_deletions(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return cut(counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_OCCURRENCES))


def letter_counts(word: str) -> tuple[int, ...]:
    counts = [0] * GROUPS
    for letter in word:
        counts[ord(letter) % GROUPS] += 1
    return tuple(counts)


def reached(length: int, top: tuple[int, ...]) -> list[tuple]:
    """Keys (length, counts) within the budget, and the surplus and deficit that are left below."""
    out = []
    for longer in (0, 1, -1):
        # What the words differ by in length fixes the budget: neither or both, one surplus, one deficit.
        surplus, deficit = longer >= 0, longer <= 0
        states = [((), surplus, deficit)]
        for count in top:
            ahead = []
            for path, s, d in states:
                ahead.append(((*path, count), s, d))
                if s:
                    ahead.append(((*path, count + 1), False, d))
                if d and count:
                    ahead.append(((*path, count - 1), s, False))
            states = ahead
        out += [(length + longer, path, s, d) for path, s, d in states]
    return out


def name_of(length: int, top: tuple[int, ...]) -> str:
    return ".".join(map(str, (length, *top)))


def deal(batches, search: bool):
    """Each word at its key; or, for a search, at every key that its budget reaches."""
    for batch in batches:
        out = []
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            counts = letter_counts(word)
            top, rest = counts[:TOP_GROUPS], np.array(counts[TOP_GROUPS:], "<u4").tobytes()
            if search:
                out += [(name_of(size, path), word, n, int(s), int(d), rest) for size, path, s, d in reached(len(word), top)]
            else:
                out.append((name_of(len(word), top), word, n, 0, 0, rest))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = [x.split()[0] for x in SEARCH.split(", ")]
        for start in range(0, max(len(out), 1), 10_000):
            yield pa.record_batch([pa.array(c[start:start + 10_000], k) for c, k in zip(columns, kinds, strict=True)], names)


def counts_of(data: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(data, "<u4").tolist())


def plant(cells: list[str], words: list[str], sizes: list[int], rests: list[bytes]) -> dict:
    """The trie: the cell first, then the counts below it; a leaf is a list of (word, n)."""
    root: dict = {}
    for cell, word, n, rest in zip(cells, words, sizes, rests, strict=True):
        node, path = root.setdefault(cell, {}), counts_of(rest)
        for count in path[:-1]:
            node = node.setdefault(count, {})
        node.setdefault(path[-1], []).append((word, n))
    return root


def leaves(node, path: tuple[int, ...], surplus: int, deficit: int, level: int = 0):
    """Depth-first: the leaves that differ from the path by at most the surplus and the deficit."""
    if level == len(path):
        yield node
        return
    count = path[level]
    if count in node:
        yield from leaves(node[count], path, surplus, deficit, level + 1)
    if surplus and count + 1 in node:
        yield from leaves(node[count + 1], path, 0, deficit, level + 1)
    if deficit and count - 1 in node:
        yield from leaves(node[count - 1], path, surplus, 0, level + 1)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def one_apart(word: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of words of one length, those that are the word but for one inserted, deleted or replaced code point."""
    short, long = sorted((len(word), others.shape[1]))
    if short == long:
        return np.flatnonzero((others != word).sum(axis=1) == 1)
    # The longer one, without its first or its last code point, agrees up to the place and after it.
    heads, tails = (others[:, :short] == word[:short]), (others[:, -short:] == word[-short:])
    before = np.logical_and.accumulate(heads, axis=1).sum(axis=1)
    after = np.logical_and.accumulate(tails[:, ::-1], axis=1).sum(axis=1)
    return np.flatnonzero(before + after >= short)


def search(words: pa.Table, searches: pa.Table) -> pa.Table:
    """For each search that meets a near word: how many, and the most frequent (ties: first in code-point order)."""
    trie = plant(*(words[c].to_pylist() for c in ("cell", "word", "n", "rest")))
    found: list[tuple] = []
    reach: dict = {}
    columns = (searches[c].to_pylist() for c in ("word", "cell", "rest", "surplus", "deficit"))
    for word, *state in zip(*columns, strict=True):
        # Words of equal counts share a search.
        known = reach.get(key := tuple(state))
        if known is None:
            cell, rest, surplus, deficit = state
            reached_words = [x for leaf in leaves(trie.get(cell, {}), counts_of(rest), surplus, deficit) for x in leaf]
            known = reach[key] = (reached_words, letters([w for w, _ in reached_words]) if reached_words else None)
        if known[0]:
            near = [(-known[0][i][1], known[0][i][0]) for i in one_apart(letters([word])[0], known[1])]
            if near:
                n, best = min(near)
                found.append((word, len(near), -n, best))
    names, kinds = [x.split()[0] for x in NEAR.split(", ")], (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.table({name: pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)})


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n_near, best_n and best: near words counted, and the one of largest n."""
    dealt = cut(words.mapInArrow(lambda batches: deal(batches, False), SEARCH))
    sizes = cut(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_words).cast("long").alias("parts")))
    asked = words.mapInArrow(lambda batches: deal(batches, True), SEARCH)
    # Cells are dealt to shards of about as many words as a part has.
    shards = pieces(words.count(), part_words, 8)

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        # A key's words by part, and its searches by part: each part of one meets each of the other.
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        split = rows.join(sizes.select(F.col("cell"), F.col("parts").alias("parts")), "cell")
        split = split.select(*rows.columns, F.pmod(F.xxhash64("word"), "parts").alias(own), every.alias(other))
        split = split.withColumn("cell", F.concat_ws("/", "cell", "words_part", "searches_part"))
        # Small searches are long work, so the number of tasks follows the shards, not their bytes.
        return split.select(*rows.columns, F.pmod(F.xxhash64("cell"), F.lit(shards)).alias("shard")).repartition(shards, "shard")

    left, right = spread(dealt, "words_part", "searches_part"), spread(asked, "searches_part", "words_part")
    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select(
        "word", "n_near", (-F.col("x.minus")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) followed to the last, twice as far in each round."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n."""
    words = vocabulary(docs)
    is_form = F.col("best_n") >= FORM_FACTOR * F.col("n")
    judged = cut(words.join(near_words(words, part_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    last = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
