"""Exact Jaccard join of documents by their word n-grams, with prefix trees.

1. Documents of the same words are one text; its smallest key stands for the copies.
2. The document frequency of every n-gram is counted by an exchange of sorted hashes. It gives the global order:
   n-grams of one text alone come first, then by frequency class and hash.
3. Only a text's first `n - ceil(t n) + 1` n-grams can be the first that it shares with a partner. Texts whose
   prefix no other text has are done; for the rest the shared n-grams are stored in global order.
4. Texts that share a prefix n-gram are tested against a hub of it, in a few rounds with other hubs. Then only
   texts remain that share one and are not yet in one component. What hangs together by such n-grams is cut into
   blocks, and blocks are tested against each other.
5. A test puts a block into a prefix tree. A probe walks it: n-grams common to all sets below a node are matched
   once, and a subtree is left as soon as what is left can't reach the overlap needed.

So copies near to their hub cost one test each, not one per pair, and no link between components is missed.
Hashes have 58 bits and decide alone; n-grams that differ are taken for equal about once in 10^17 comparisons.

Defined cases: null or empty texts have no n-grams and link with nothing; texts shorter than the n-gram have
their whole sequence as one; a null id never names a component unless nothing else does; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import exchange, rolling
from tracelode.llm.common import content_key, measure, pieces, row_key
from tracelode.llm.components import components
from tracelode.session import cut

WIDTH = 5
PERCENT = 80
CHUNK_BYTES = 8 << 20
RANGE_SIZE = 1_000_000
#: Partners of one probe that share a prefix tree; bounds a task's memory, every block is tested.
BLOCK = 256
#: Token bytes of a block of texts that are tested against each other, about.
CELL_BYTES = 1 << 20
#: Rounds in which texts are tested against hubs before all that is left.
HUB_ROUNDS = 1
#: Bits of a token that hold its frequency class; the rest hold its hash.
CLASS_BITS = 6
NOTE = -1
PRINTS = "row_key long, doc_id long, content_key long, n_words long, node binary"
SETS = "node binary, n long, first long, tokens binary, prefix array<long>"


def text_print(text: str | None) -> tuple[bytes, int]:
    """A hash of the text's folded words, and their number."""
    found = (text or "").encode().translate(rolling.FOLD).split()
    return xxhash.xxh3_128_digest(b" ".join(found)), len(found)


def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [text_print(x.as_py()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([
            *batch.columns[:3], pa.array([n for _, n in done], pa.int64()), pa.array([p for p, _ in done], pa.binary()),
        ], ["row_key", "doc_id", "content_key", "n_words", "node"])


class Sets:
    """The n-gram sets of a chunk's texts: one text of each wanted print."""

    def __init__(self, texts: pa.Table, notes: pa.Table, width: int):
        wanted = {d for s, d in zip(notes["shard"].to_pylist(), notes["data"].to_pylist(), strict=True) if s == NOTE}
        self.nodes, chosen = [], []
        for key, text in zip(texts["row_key"].to_pylist(), texts["text"], strict=True):
            text = text.as_py()
            node, n = text_print(text)
            mark = key.to_bytes(8, "big", signed=True) + node
            if n >= width and mark in wanted:
                wanted.remove(mark)
                self.nodes.append(node)
                chosen.append(text)
        index, counts, vocabulary = rolling.index_words(chosen, fold=True)
        starts, text = rolling.inside(counts, width)
        first, _ = rolling.digests(vocabulary)
        hashes = rolling.roll(first[index], width)[starts]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = hashes[keep], text[keep]
        self.values, self.inverse, self.count = np.unique(self.hashes, return_inverse=True, return_counts=True)


def sent(texts: pa.Table, notes: pa.Table, width: int, bits: int) -> pa.Table:
    found = Sets(texts, notes, width)
    if not len(found.values):
        return pa.table({"shard": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    return exchange.messages(texts["chunk"][0].as_py(), found.values, bits, found.count.astype(np.uint32))


def frequency(values: np.ndarray, chunk: np.ndarray, rest: list[bytes]) -> np.ndarray:
    """In how many texts of the corpus each hash is."""
    counts = np.frombuffer(b"".join(rest), np.uint32).astype(np.int64)
    _, inverse = np.unique(values, return_inverse=True)
    return np.bincount(inverse, weights=counts).astype(np.int64)[inverse]


def code_frequency(found: np.ndarray) -> bytes:
    """A bitmap of what more than one text has, then the frequency class of each of those."""
    shared = found > 1
    classes = np.ceil(np.log2(found[shared])).astype(np.uint8)
    return np.packbits(shared).tobytes() + classes.tobytes()


def read_frequency(data: bytes, n: int) -> np.ndarray:
    """The frequency class of each hash, 0 where one text alone has it."""
    size = -(-n // 8)
    out = np.zeros(n, np.uint8)
    shared = np.unpackbits(np.frombuffer(data, np.uint8, size), count=n).astype(bool)
    out[shared] = np.frombuffer(data, np.uint8, -1, size)
    return out


def ordered(texts: pa.Table, notes: pa.Table, width: int, percent: int, bits: int) -> pa.Table:
    """Each text's set size; where its prefix is shared, also its shared n-grams in global order and the prefix."""
    found = Sets(texts, notes, width)
    level = exchange.unpack(exchange.replies(notes, NOTE), found.values, bits, read_frequency)[found.inverse]
    code = (level.astype(np.uint64) << np.uint64(64 - CLASS_BITS)) | (found.hashes >> np.uint64(CLASS_BITS))
    sizes = np.bincount(found.text, minlength=len(found.nodes))
    ends = np.cumsum(sizes)
    n, first, tokens, prefix = [], [], [], []
    for begin, end in zip(ends - sizes, ends, strict=True):
        size = int(end - begin)
        alone = int((level[begin:end] == 0).sum())
        length = size - -(-percent * size // 100) + 1
        n.append(size)
        first.append(alone)
        if alone >= length:
            tokens.append(None)
            prefix.append(None)
        else:
            shared = np.sort(code[begin:end][level[begin:end] > 0])
            tokens.append(shared.tobytes())
            prefix.append(shared[: length - alone].view(np.int64))
    return pa.table({
        "node": pa.array(found.nodes, pa.binary()), "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64()),
        "tokens": pa.array(tokens, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())),
    })


def needed(n: int, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of sets of n and m members that link."""
    return -(-percent * (n + m) // (100 + percent))


class Trie:
    """A prefix tree of globally ordered sets, by levels; a run of tokens without a branch is one node.

    Each node has its run of tokens (as places in `vocabulary`), its parent on the level above, the smallest and
    largest set below it and the most tokens that a set below still has.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        ranked = [sets[i] for i in order]
        common = np.zeros(len(sets) + 1, np.int64)
        for at in range(1, len(sets)):
            k = min(len(ranked[at - 1]), len(ranked[at]))
            differ = np.flatnonzero(ranked[at - 1][:k] != ranked[at][:k])
            common[at] = differ[0] if len(differ) else k
        lengths = np.array([len(s) for s in ranked])
        ranked_sizes = self.sizes[order]
        self.vocabulary = np.unique(np.concatenate(sets))
        self.levels: list[dict[str, np.ndarray]] = []
        # (first set, one past the last, depth, parent) of the nodes of a level.
        wide = [(0, len(sets), 0, 0)]
        while wide:
            nodes: dict[str, list] = {k: [] for k in ("run", "parent", "least", "most", "rest", "member", "owner", "last")}
            below = []
            for me, (low, high, depth, parent) in enumerate(wide):
                end = int(common[low + 1:high].min()) if high > low + 1 else int(lengths[low])
                end = min(end, int(lengths[low]))
                nodes["run"].append(np.searchsorted(self.vocabulary, ranked[low][depth:end]))
                nodes["last"].append(ranked[low][end - 1] if end else 0)
                nodes["parent"].append(parent)
                nodes["least"].append(ranked_sizes[low:high].min())
                nodes["most"].append(ranked_sizes[low:high].max())
                nodes["rest"].append(lengths[low:high].max() - end)
                while low < high and lengths[low] == end:
                    nodes["member"].append(order[low])
                    nodes["owner"].append(me)
                    low += 1
                if low < high:
                    cuts = [low, *(np.flatnonzero(common[low + 1:high] == end) + low + 1).tolist(), high]
                    below += [(x, y, end, me) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            run = nodes.pop("run")
            level = {k: np.array(v, np.uint64 if k == "last" else np.int64) for k, v in nodes.items()}
            level["length"] = np.array([len(r) for r in run], np.int64)
            level["tokens"] = np.concatenate(run).astype(np.int64)
            level["begin"] = np.cumsum(level["length"]) - level["length"]
            self.levels.append(level)
            wide = below

    def probe(self, tokens: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose Jaccard similarity with the probe is at least `percent` hundredths.

        Level by level: what a node's run adds to the overlap is counted once for all sets below it, and only
        below nodes that can still reach the overlap their smallest set needs.
        """
        at = np.searchsorted(self.vocabulary, tokens)
        at[at == len(self.vocabulary)] = 0
        has = np.zeros(len(self.vocabulary), bool)
        has[at[self.vocabulary[at] == tokens]] = True
        found, above, alive = [], np.zeros(1, np.int64), np.ones(1, bool)
        for x in self.levels:
            live = alive[x["parent"]] & (100 * x["most"] >= percent * size) & (percent * x["least"] <= 100 * size)
            chosen = np.flatnonzero(live)
            if not len(chosen):
                break
            n = x["length"][chosen]
            ends = np.cumsum(n)
            spots = np.repeat(x["begin"][chosen] - (ends - n), n) + np.arange(int(ends[-1]))
            hits = np.append(0, np.cumsum(has[x["tokens"][spots]]))
            overlap = np.zeros(len(live), np.int64)
            overlap[chosen] = above[x["parent"][chosen]] + hits[ends] - hits[ends - n]
            left = np.where(x["last"][chosen] > 0, len(tokens) - np.searchsorted(tokens, x["last"][chosen], "right"), len(tokens))
            reach = overlap[chosen] + np.minimum(left, x["rest"][chosen])
            live[chosen] = reach >= needed(size, x["least"][chosen], percent)
            owner = x["owner"]
            good = live[owner] & (overlap[owner] >= needed(size, self.sizes[x["member"]], percent))
            found.append(x["member"][good])
            above, alive = overlap, live
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def tested(table: pa.Table, percent: int) -> pa.Table:
    """Links of a cell: its probes against a prefix tree of its members, as few as join what is linked."""
    node, size = table["node"].to_pylist(), table["n"].to_pylist()
    label, sets = table["label"].to_pylist(), [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
    member = [i for i, x in enumerate(table["member"].to_pylist()) if x]
    group = {x: x for x in label}

    def root(x: bytes) -> bytes:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    links = []
    if member:
        tree = Trie([sets[i] for i in member], [size[i] for i in member])
        for i, probes in enumerate(table["probe"].to_pylist()):
            for j in tree.probe(sets[i], size[i], percent).tolist() if probes else ():
                a, b = root(label[i]), root(label[member[j]])
                if a != b:
                    group[a] = b
                    links.append((node[i], node[member[j]]))
    return pa.table({k: pa.array([x[i] for x in links], pa.binary()) for i, k in enumerate("ab")})


def test_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of texts b with their hubs a. The texts of one hub are dealt to cells of bounded size."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("i"), F.lit(0).alias("j")).alias("cell"))
    rows = dealt.select("cell", F.col("b").alias("node"), F.lit(True).alias("member")).union(
        dealt.select("cell", F.col("a").alias("node"), F.lit(False).alias("member")).distinct())
    rows = rows.join(sets, "node").select("cell", "node", "n", F.col("node").alias("label"), "tokens", "member", (~F.col("member")).alias("probe"))
    return rows.groupBy("cell").applyInArrow(lambda t: tested(t.drop_columns(["cell"]), percent), "a binary, b binary")


def test_all(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between texts of different components that share a prefix n-gram directly or through others.

    What hangs together by prefix n-grams forms a group; each pair of its blocks is one cell.
    """
    hubs = rows.groupBy("token").agg(F.min("node").alias("hub"))
    edges = rows.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(edges).withColumnRenamed("label", "a")
    members = cut(rows.select("node", "label").distinct().join(groups, "node").join(sets, "node"))
    parts = members.groupBy("a").agg(F.ceil(F.sum(F.octet_length("tokens")) / CELL_BYTES).alias("parts"))
    dealt = members.join(parts, "a").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select(
        F.struct("a", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).alias("cell"), "node", "n", "label", "tokens",
        (F.col("i") <= F.col("j")).alias("member"), (F.col("i") >= F.col("j")).alias("probe"))
    return cells.groupBy("cell").applyInArrow(lambda t: tested(t.drop_columns(["cell"]), percent), "a binary, b binary")


def near(n: str, m: str, percent: int):
    """The length filter."""
    return (100 * F.col(m) >= percent * F.col(n)) & (100 * F.col(n) >= percent * F.col(m))


def marked(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows with their component so far, of n-grams that are in more than one component."""
    rows = prefix.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return cut(rows.join(mixed.select("token"), "token"))


def hub_pairs(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each text with the hub of each of its prefix n-grams, unless they are in one component or lengths forbid it.

    The hub is the least text by a hash of the seed, so each round has others.
    """
    hubs = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("order"), "node", "n", "label")).alias("hub"))
    starred = rows.join(hubs.select("token", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "label")]), "token")
    kept = starred.where((F.col("label") != F.col("hub_label")) & near("n", "hub_n", percent))
    return kept.select(F.col("hub_node").alias("a"), F.col("node").alias("b")).distinct()


def labels_of(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of texts in a component of two or more."""
    sets = sets.where(F.col("tokens").isNotNull())
    tokens = sets.select("node", "n", "tokens")
    prefix = sets.select("node", "n", F.posexplode("prefix").alias("at", "token"), "first").withColumn("at", F.col("at") + F.col("first")).drop("first")
    labels = sets.select("node", F.col("node").alias("label")).limit(0)
    rows = marked(prefix, labels)
    for seed in range(HUB_ROUNDS):
        links = test_hubs(hub_pairs(rows, seed, percent), tokens, percent)
        labels = cut(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)))
        rows = marked(rows, labels)
    links = test_all(rows, tokens, percent)
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and whether it is the one of its component that stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", row_key())
    size = measure(docs)
    chunks, bits = pieces(size.text_bytes, CHUNK_BYTES), exchange.shard_bits(size.text_bytes // 6, RANGE_SIZE)
    place = F.pmod(F.xxhash64("row_key"), F.lit(chunks)).alias("chunk")
    rows = cut(docs.select("row_key", "doc_id", content_key().alias("content_key"), "text").mapInArrow(prints, PRINTS))
    some = rows.where("n_words > 0").groupBy("node").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("least"), F.first("n_words").alias("n_words"))
    notes = some.where(F.col("n_words") >= width).select(
        place, F.lit(NOTE).alias("shard"),
        F.concat(F.unhex(F.lpad(F.hex("row_key"), 16, "0")), "node").alias("data"))
    texts = docs.select(place, "row_key", "text")
    messages = texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(
        lambda t, k: sent(t, k, width, bits), exchange.MESSAGE)
    answers = exchange.own(messages, frequency, code_frequency)
    sets = cut(texts.groupBy("chunk").cogroup(notes.unionByName(answers).groupBy("chunk")).applyInArrow(
        lambda t, k: ordered(t, k, width, percent, bits), SETS))
    labels = labels_of(sets, percent)
    texts_of = cut(some.select("node", "least", "row_key").join(sets.select("node", "n"), "node", "left").join(labels, "node", "left").select(
        "node", "least", "row_key", F.coalesce("n", F.lit(1)).alias("n_shingles"), F.coalesce("label", "node").alias("label")))
    least = texts_of.groupBy("label").agg(F.min("least").alias("component_id"), F.min("row_key").alias("least_key"))
    named = texts_of.join(least, "label").select("node", "n_shingles", "component_id", "least_key")
    stays = F.when(F.col("component_id").isNull(), F.col("row_key") == F.col("least_key")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    linked = rows.where("n_words > 0").join(named, "node").select("doc_id", "n_shingles", "component_id", stays.alias("kept"), "content_key")
    empty = rows.where("n_words = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "content_key")
    return linked.unionByName(empty)
