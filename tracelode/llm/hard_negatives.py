"""Hard negatives of anchor vectors, with exact integer scores by the method of the Four Russians.

Components are rounded down to integers. Rows are packed into blocks: each group of eight dimensions gives one byte
per bit of the integers (two's complement), a bit plane. For an anchor, a table of 256 sums per group holds the sum
of the anchor's components over every subset of the group's dimensions. A row's score is then looked up plane by
plane, doubled from one plane to the next: the exact inner product without a multiplication.

The anchors are the stated query set, so every block meets every group of anchors once, as one task's share. Both
have a fixed size; their number grows with the table. A first pass scores rows of the anchor's label and keeps each
block's best, a second the other rows, whose limits come from the positives of the first. Only the best of each
block are shuffled and ranked. A label or vector that a third of the rows have is dealt over all blocks.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; shorter
vectors count as followed by zeros; a repeated row is a row, so it can be a positive of its twin; a null vec_id is no
anchor and ranks behind other ids; an empty table gives no rows. Scores beyond 64 bits count as the greatest or
smallest long. Columns other than vec_id, label and embedding are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.common import pieces
from tracelode.session import cut

#: Rows of a block, anchors of a group, and anchors whose tables are held at once.
BLOCK_ROWS, GROUP_ANCHORS, TABLE_ANCHORS = 4096, 2048, 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Tasks that all cells are dealt to, at most; a task takes them one by one.
MOST_TASKS = 20_000
SCALE = 256.0
BEST = 5
#: A negative scores at least so many percent of the positive, and no more than it.
LOWEST_PERCENT = 80
LONG = np.iinfo(np.int64)
PACKED = "block long, ids binary, nulls binary, uids binary, labels binary, dims int, width int, planes binary"
GROUPED = "team long, ids binary, uids binary, labels binary, dims int, parts binary, limits binary"
POSITIVES = "anchor_uid long, anchor_id long, positive_uid long, positive_id long, positive_score long"
NEGATIVES = "anchor_uid long, anchor_id long, positive_score long, negative_uid long, negative_id long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, label and embedding of the rows that take part; stored, so that a row keeps its uid."""
    finite = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return cut(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", moved.alias("label"), "embedding"))


def integers(table: pa.Table) -> np.ndarray:
    """The components times 256, rounded down; Python integers where 32 bits are too few."""
    lists = table["embedding"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
    large = bool(len(values)) and np.abs(values).max() >= 2**31
    # 256 x may pass the range of a double, so such components are taken as whole numbers first.
    if large:
        whole = [int(np.floor(x * SCALE)) if np.isfinite(x * SCALE) else int(x) * int(SCALE) for x in lists.flatten().to_numpy(zero_copy_only=False)]
        values = np.array(whole, object)
    else:
        values = values.astype(np.int64)
    dims = int(counts.max()) if len(counts) else 0
    out = np.zeros((len(counts), -(-max(dims, 1) // 8) * 8), values.dtype)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def bit_planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits of an integer, and bytes[plane, group, row]: one bit of eight dimensions."""
    least, most = int(values.min(initial=0)), int(values.max(initial=0))
    width = max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0) + 1
    planes = [np.packbits(((values >> p) & 1).astype(np.uint8), axis=1).T for p in range(width)]
    return width, np.ascontiguousarray(planes)


def longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64)


def _one(kind: str, values: dict) -> pa.Table:
    """One row of the given values, typed as the schema says."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([values[name]], types[form]) for name, form in (x.split() for x in kind.split(", "))})


def pack(key: tuple, table: pa.Table) -> pa.Table:
    """One block: rows in the order of their labels, as bit planes."""
    table = table.sort_by([("label", "ascending"), ("uid", "ascending")])
    width, planes = bit_planes(integers(table))
    return _one(PACKED, {
        "block": key[0].as_py(), "ids": longs(table["vec_id"]).tobytes(), "nulls": table["vec_id"].is_null().to_numpy().tobytes(),
        "uids": longs(table["uid"]).tobytes(), "labels": longs(table["label"]).tobytes(), "dims": planes.shape[1] * 8, "width": width,
        "planes": planes.tobytes(),
    })


def gather(key: tuple, table: pa.Table) -> pa.Table:
    """One group of anchors: their components, and their positives' scores (padded by the smallest long)."""
    table = table.sort_by([("label", "ascending"), ("uid", "ascending")])
    parts = integers(table)
    limits = np.full((len(table), BEST), LONG.min, np.int64)
    for row, scores in enumerate(table["scores"].to_pylist()):
        limits[row, :len(scores or [])] = scores or []
    # Components beyond 64 bits travel as text.
    data = parts.tobytes() if parts.dtype != object else b"#" + ",".join(map(str, parts.ravel())).encode()
    return _one(GROUPED, {
        "team": key[0].as_py(), "ids": longs(table["vec_id"]).tobytes(), "uids": longs(table["uid"]).tobytes(), "labels": longs(table["label"]).tobytes(),
        "dims": parts.shape[1], "parts": data, "limits": limits.tobytes(),
    })


def read_parts(row: dict) -> np.ndarray:
    data = row["parts"]
    if data[:1] == b"#" and len(data) % 8:  # all integers have eight bytes
        flat = np.array([int(x) for x in data[1:].split(b",")], object)
    else:
        flat = np.frombuffer(data, np.int64)
    return flat.reshape(-1, row["dims"])


def subset_sums(parts: np.ndarray) -> np.ndarray:
    """sums[group, byte, anchor]: of the anchor's components that the byte's bits choose (first dimension on top)."""
    anchors, dims = parts.shape
    sums = np.zeros((dims // 8, 256, anchors), parts.dtype)
    for bit in range(8):
        component = parts[:, 7 - bit::8].T[:, None, :]
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + component
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """scores[row, anchor]: looked up from the highest plane down, doubled in between; the highest one is the sign."""
    total = None
    for p in range(len(planes) - 1, -1, -1):
        looked = sums[0][planes[p, 0]]
        for group in range(1, min(len(sums), planes.shape[1])):
            looked = looked + sums[group][planes[p, group]]
        total = -looked if total is None else (total << 1) + looked
    return total


def ranked(score: np.ndarray, ids: np.ndarray, nulls: np.ndarray, uids: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places by score downwards, then id upwards, null last; the first `most`, if given."""
    place = np.arange(len(score))
    if most is not None and len(score) > 4 * most:
        place = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    if score.dtype == object:
        return np.array(sorted(place, key=lambda i: (-score[i], nulls[i], ids[i], uids[i]))[:most], np.int64)
    return place[np.lexsort((uids[place], ids[place], nulls[place], -score[place]))][:most]


class Block:
    """A block of rows and, in slices, their scores with a few anchors."""

    def __init__(self, row: dict):
        self.ids, self.uids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "uids", "labels"))
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.planes = np.frombuffer(row["planes"], np.uint8).reshape(row["width"], row["dims"] // 8, -1)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def score(self, sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = scores(sums, self.planes[:, :, rows])
        return np.clip(found, LONG.min, LONG.max) if found.dtype == object else found


def wide(parts: np.ndarray, block: Block) -> np.ndarray:
    """The parts as Python integers where a hundredfold score might pass 64 bits."""
    top = max([1, *(abs(int(x)) for x in (parts.min(initial=0), parts.max(initial=0)))])
    return parts.astype(object) if (top * parts.shape[1] * 100) << len(block.planes) >= 2**62 else parts


def shares(block: Block, team: dict, same: bool):
    """For each few anchors of one label: their places in the group, the rows of that label (or the others) and scores."""
    parts, labels = read_parts(team), np.frombuffer(team["labels"], np.int64)
    parts = wide(parts, block)
    for label in np.unique(labels):
        a, b = block.of_label(label)
        rows = np.arange(a, b) if same else np.concatenate([np.arange(a), np.arange(b, len(block.ids))])
        members = np.flatnonzero(labels == label)
        for start in range(0, len(members) if len(rows) else 0, TABLE_ANCHORS):
            few = members[start:start + TABLE_ANCHORS]
            yield few, rows, block.score(subset_sums(parts[few]), rows)


def nearest(block: Block, team: dict, uids: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """Each anchor's best rows of its label in the block."""
    out = []
    for few, rows, found in shares(block, team, True):
        for column, anchor in enumerate(few):
            other = block.uids[rows] != uids[anchor]
            mine, score = rows[other], found[other, column]
            for i in ranked(score, block.ids[mine], block.nulls[mine], block.uids[mine], BEST):
                row = mine[i]
                out.append((int(uids[anchor]), int(ids[anchor]), int(block.uids[row]), None if block.nulls[row] else int(block.ids[row]), int(score[i])))
    return out


def hardest(block: Block, team: dict, uids: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """For each distinct score of an anchor's positives: the best rows of other labels within its limits."""
    out, limits = [], np.frombuffer(team["limits"], np.int64).reshape(-1, BEST)
    for few, rows, found in shares(block, team, False):
        for column, anchor in enumerate(few):
            for top in {int(x) for x in limits[anchor] if x > LONG.min}:
                score = found[:, column]
                fits = np.flatnonzero((score <= top) & (100 * score >= LOWEST_PERCENT * top))
                mine, score = rows[fits], score[fits]
                for i in ranked(score, block.ids[mine], block.nulls[mine], block.uids[mine], BEST):
                    row = mine[i]
                    out.append((int(uids[anchor]), int(ids[anchor]), top, int(block.uids[row]), None if block.nulls[row] else int(block.ids[row]), int(score[i])))
    return out


def _meet(blocks: DataFrame, teams: DataFrame, n_blocks: int, n_teams: int, act, kind: str) -> DataFrame:
    """Every block with every group of anchors, one at a time."""
    names = [x.split()[0] for x in kind.split(", ")]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for block in map(Block, left.to_pylist()):
            for team in right.to_pylist():
                uids, ids = (np.frombuffer(team[c], np.int64) for c in ("uids", "ids"))
                found += act(block, team, uids, ids)
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)})

    # Blocks are numbered from 0, so a cell is one block and one group.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("team", every(n_teams))
    right = teams.withColumn("block", every(n_blocks))
    # Small blocks are long work, so the number of tasks follows the cells, not their bytes.
    tasks = min(n_blocks * n_teams, MOST_TASKS)
    left, right = (side.repartition(tasks, "block", "team") for side in (left, right))
    return left.groupBy("block", "team").cogroup(right.groupBy("block", "team")).applyInArrow(cell, kind)


def _first(rows: DataFrame, of: list[str], score: str, vec_id: str, uid: str) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), F.asc_nulls_last(vec_id), uid)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    rows = usable(vectors)
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    n_blocks, n_teams = pieces(counts["rows"], BLOCK_ROWS, 8), pieces(counts["anchors"], GROUP_ANCHORS)
    number = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    blocks = cut(rows.withColumn("block", number(n_blocks)).groupBy("block").applyInArrow(pack, PACKED))
    anchors = rows.where(is_anchor).withColumn("team", number(n_teams))

    teams = anchors.withColumn("scores", F.array().cast("array<bigint>")).groupBy("team").applyInArrow(gather, GROUPED)
    near = _meet(blocks, teams, n_blocks, n_teams, nearest, POSITIVES)
    positives = cut(_first(near, ["anchor_uid"], "positive_score", "positive_id", "positive_uid").drop("rank"))
    limits = positives.groupBy(F.col("anchor_uid").alias("uid")).agg(F.collect_set("positive_score").alias("scores"))
    teams = anchors.join(limits, "uid").groupBy("team").applyInArrow(gather, GROUPED)
    hard = _meet(blocks, teams, n_blocks, n_teams, hardest, NEGATIVES)
    negatives = _first(hard, ["anchor_uid", "positive_score"], "negative_score", "negative_id", "negative_uid")
    # Positives of equal score have the same negatives: at most five by five rows for an anchor.
    return positives.join(negatives.drop("anchor_id"), ["anchor_uid", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
