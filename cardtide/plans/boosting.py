"""Boosted trees by second-order histograms, one exchange of sums for each level.

Each feature is cut into bins at its quantiles once, and each partition keeps its rows as blocks: a matrix of bin
numbers, labels, weights and margins. For a level of a tree, every block adds up gradients and hessians per open node,
feature and bin; the sums of all blocks, whose size is that of the settings and not of the data, give the splits. Leaves
are worth -G / (H + l2).

All rounds run in one barrier stage, since starting a Python job for each level costs more than its sums: the tasks hold
the rows, even shares of them, and hand sums and splits to each other through small files in the checkpoint folder, which
they share. A task lost with its executor starts the stage again, with the same draws. Where such a stage cannot run
(``_gang``), each level is a job of its own over stored blocks: a block works out the nodes of its rows from the tree
itself, its margins move on by one tree a round and are kept with the block, and lineage is cut by a checkpoint every few
rounds.

Rows are drawn for each tree by a generator keyed by seed, block and round, columns by one keyed by seed and round. The
finished trees are written in Spark's own format, so that scoring is Spark's model.
"""

from __future__ import annotations

import json
import os
import pickle
import shutil
import time
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from cardtide.session import ensure_checkpoint_dir, working_folder

#: Rows of one block.
BLOCK_ROWS = 1 << 18
#: Rounds between two checkpoints of the margins. In between, a lost block is made again from the last one.
STORE_EVERY = 8
#: Partitions whose sums the driver adds up itself; more are added up on the executors first.
DIRECT_PARTITIONS = 32
#: Most tasks of the barrier stage. The first adds up the sums of all.
GANG_TASKS = 32
#: A task that waits longer than this for another one fails.
GANG_WAIT_SECONDS = 3600
#: Most rows that a task of the barrier stage holds, at about 70 bytes with the features of this model.
GANG_ROWS = 8_000_000
#: Fewest and most rows of a piece of a block, which is what is dealt to tasks. Multiples of four, as a draw's counter is.
PIECE_ROWS = (1 << 13, 1 << 16)
#: Most cells of the joint histogram of several features with few bins.
JOINT_CELLS = 512
NODE_SCHEMA = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


class Settings(NamedTuple):
    rounds: int
    depth: int
    rate: float
    row_share: float
    column_share: float
    least_hessian: float
    l2: float
    seed: int
    bins: int = 64


class Block(NamedTuple):
    """Rows of one block. ``bins`` is features x rows."""

    number: int
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


class Tree(NamedTuple):
    """A binary heap of nodes: the children of node k are 2k + 1 (bin not above ``cut``) and 2k + 2. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size))


def feature_edges(rows: DataFrame, features: str, size: int, bins: int) -> list[np.ndarray]:
    """Borders between the bins of each feature: at most ``bins`` - 1 values that occur; a value on a border is below it."""
    columns = rows.select(*[F.get(vector_to_array(features), F.lit(k)).alias(f"f{k}") for k in range(size)])
    wanted = [k / bins for k in range(1, bins)]
    found = columns.approxQuantile([f"f{k}" for k in range(size)], wanted, 0.1 / bins)
    highest = columns.agg(*[F.max(f"f{k}") for k in range(size)]).first()
    return [np.array(sorted({v for v in values if v < top}), float) for values, top in zip(found, highest, strict=True)]


def blocks_of(rows: DataFrame, features: str, label: str, weight: str, edges: list[np.ndarray]) -> RDD:
    """Blocks of the rows, partition by partition in their order. The blocks are stored, as every level reads them."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        def binned(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            values = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            bins = np.array([np.searchsorted(edge, values[:, k]) for k, edge in enumerate(edges)], np.uint8)
            numbers = [table.column(k).to_numpy().astype(float).tobytes() for k in (1, 2)]
            return pa.RecordBatch.from_pydict({"size": pa.array([table.num_rows], pa.int32()), "bins": [bins.tobytes()], "label": [numbers[0]], "weight": [numbers[1]]})

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(part.num_rows for part in waiting) >= BLOCK_ROWS:
                yield binned(waiting)
                waiting = []
        if sum(part.num_rows for part in waiting):
            yield binned(waiting)

    packed = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double"), F.col(weight).cast("double")).mapInArrow(
        pack, "size int, bins binary, label binary, weight binary"
    )
    count = len(edges)

    def unpack(item) -> Block:
        row, number = item
        label = np.frombuffer(row["label"])
        return Block(number, np.frombuffer(row["bins"], np.uint8).reshape(count, row["size"]), label, np.frombuffer(row["weight"]), np.zeros(len(label)))

    # A block's number is its place, which a repeated task gives it again.
    return packed.rdd.zipWithUniqueId().map(unpack)


def nodes_of(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels."""
    count = bins.shape[1]
    node, rows, flat = np.zeros(count, np.int64), np.arange(count), bins.reshape(-1)
    # Arrays as long as a block are used again and again, as new memory costs more than what is done with it.
    feature, cut, value = np.empty(count, np.int64), np.empty(count, np.int64), np.empty(count, np.uint8)
    for _ in range(depth):
        np.take(tree.feature, node, out=feature, mode="clip")
        np.take(tree.cut, node, out=cut, mode="clip")
        open_ = feature >= 0
        feature *= count
        feature += rows
        # A leaf has feature -1, whose place is cut off; the value is not used.
        np.take(flat, feature, out=value, mode="clip")
        np.add(node * 2 + 1, value > cut, out=node, where=open_)
    return node


def advanced(block: Block, tree: Tree, depth: int) -> Block:
    """The block with its margins after one more tree."""
    return block._replace(margin=block.margin + tree.value[nodes_of(block.bins, tree, depth)])


def _histogram(block: Block, tree: Tree, level: int, columns: np.ndarray, sizes: np.ndarray, round_: int, settings: Settings) -> np.ndarray:
    """Gradient and hessian sums: 2 x nodes of the level x bins of the drawn columns, one after the other."""
    draw = np.random.Generator(np.random.Philox(key=[settings.seed, (block.number << 24) + round_]))
    taken = draw.random(len(block.label)) < settings.row_share
    node = nodes_of(block.bins, tree, level) - ((1 << level) - 1)
    taken &= node >= 0
    # Rows that are not taken add zero to the first node.
    node = np.where(taken, node, 0)
    probability = 1 / (1 + np.exp(-block.margin))
    weight = np.where(taken, block.weight, 0.0)
    gradient = weight * (probability - block.label)
    hessian = weight * np.maximum(probability * (1 - probability), 1e-16)
    width, start = 1 << level, 0
    sums, place = np.empty((2, width, int(sizes[columns].sum()))), np.empty_like(node)
    for column in columns:
        size = int(sizes[column])
        np.multiply(node, size, out=place)
        place += block.bins[column]
        for k, values in enumerate((gradient, hessian)):
            sums[k, :, start : start + size] = np.bincount(place, values, width * size).reshape(width, size)
        start += size
    return sums


def _added(parts: RDD) -> np.ndarray:
    if parts.getNumPartitions() > DIRECT_PARTITIONS:
        return parts.treeReduce(np.add)
    return parts.reduce(np.add)


def _split_level(tree: Tree, level: int, sums: np.ndarray, columns: np.ndarray, sizes: np.ndarray, settings: Settings) -> bool:
    """Enter the best splits of the level's nodes, and the values of their children. False if there is none."""
    first, width = (1 << level) - 1, 1 << level
    starts = np.concatenate([[0], np.cumsum(sizes[columns])])
    rows, best = np.arange(width)[:, None], np.full((7, width, len(columns)), -np.inf)
    # Features with equally many bins are tried together.
    for size in np.unique(sizes[columns][sizes[columns] > 1]):
        same = np.flatnonzero(sizes[columns] == size)
        part = np.stack([sums[:, :, starts[k] : starts[k] + size] for k in same], axis=2)
        total = part.sum(axis=3)
        left = np.cumsum(part, axis=3)[..., :-1]
        right = total[..., None] - left
        with np.errstate(invalid="ignore", divide="ignore"):
            score = left[0] ** 2 / (left[1] + settings.l2) + right[0] ** 2 / (right[1] + settings.l2)
            gain = (score - (total[0] ** 2 / (total[1] + settings.l2))[..., None]) / 2
        gain = np.where((left[1] >= settings.least_hessian) & (right[1] >= settings.least_hessian), gain, -np.inf)
        cut, of = gain.argmax(axis=2), np.arange(len(same))
        for k, values in enumerate((gain, None, None, left[0], left[1], right[0], right[1])):
            if values is not None:
                best[k][:, same] = values[rows, of, cut]
        best[1][:, same], best[2][:, same] = columns[same], cut
    if not (sizes[columns] > 1).any():
        return False
    # The first of the best columns.
    best = best[:, np.arange(width), best[0].argmax(axis=1)]
    split = np.flatnonzero(best[0] > 1e-6)
    for k in split:
        node = first + k
        tree.feature[node], tree.cut[node], tree.gain[node] = best[1][k], best[2][k], best[0][k]
        for child, g, h in ((2 * node + 1, best[3][k], best[4][k]), (2 * node + 2, best[5][k], best[6][k])):
            tree.value[child], tree.cover[child] = -settings.rate * g / (h + settings.l2), h
    return len(split) > 0


def drawn_columns(count: int, round_: int, settings: Settings) -> np.ndarray:
    """The features of a round's tree."""
    drawn = np.random.default_rng([settings.seed, round_]).permutation(count)
    return np.sort(drawn[: max(1, int(settings.column_share * count))])


def _enter_root(tree: Tree, sums: np.ndarray, columns: np.ndarray, sizes: np.ndarray, settings: Settings) -> None:
    # All columns have the same totals; the root's are those of the first.
    g, h = sums[:, 0, : int(sizes[columns[0]])].sum(axis=1)
    tree.value[0], tree.cover[0] = -settings.rate * g / (h + settings.l2), h


class Bundle(NamedTuple):
    """Features that share one histogram, and its cells. A feature's bin counts ``strides`` cells."""

    columns: list[int]
    strides: list[int]
    cells: int


def bundles_of(sizes: np.ndarray, cells: int) -> list[Bundle]:
    """Every feature in one bundle, several in one as long as their bins have at most ``cells`` combinations."""
    found: list[Bundle] = []
    for column, size in enumerate(int(size) for size in sizes):
        place = next((k for k, bundle in enumerate(found) if bundle.cells * size <= cells), None)
        if place is None:
            found.append(Bundle([column], [1], size))
        else:
            bundle = found[place]
            found[place] = Bundle([*bundle.columns, column], [*bundle.strides, bundle.cells], bundle.cells * size)
    return found


class Piece:
    """Some rows of a block while all trees are grown. ``codes`` is bundles x rows: the cell of each row."""

    def __init__(self, number: int, start: int, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, bundles: list[Bundle]):
        self.number, self.start, self.label, self.weight, self.rows = number, start, label, weight, len(label)
        self.codes = np.zeros((len(bundles), self.rows), np.uint16)
        for code, bundle in zip(self.codes, bundles):
            for column, stride in zip(bundle.columns, bundle.strides):
                code += bins[column].astype(np.uint16) * np.uint16(stride)
        self.margin, self.node = np.zeros(self.rows), np.zeros(self.rows, np.uint16)

    def begin(self, round_: int, settings: Settings) -> None:
        """Draw the rows of a round, the same ones as for the whole block, and take their gradients."""
        draw = np.random.Philox(key=[settings.seed, (self.number << 24) + round_], counter=[self.start // 4, 0, 0, 0])
        weight = np.where(np.random.Generator(draw).random(self.rows) < settings.row_share, self.weight, 0.0)
        probability = 1 / (1 + np.exp(-self.margin))
        self.gradient = weight * (probability - self.label)
        self.hessian = weight * np.maximum(probability * (1 - probability), 1e-16)
        self.node[:] = 0

    def add(self, sums: list[np.ndarray | None], used: list[int], level: int, counted: np.ndarray | None, bundles: list[Bundle], room: np.ndarray) -> None:
        """Add the sums of the level's nodes, of ``counted`` ones if given, 2 x (nodes x cells) for each bundle in use."""
        width, node, codes, amounts = 1 << level, self.node, self.codes, (self.gradient, self.hessian)
        chosen = None
        if counted is not None:
            chosen = np.flatnonzero(counted[node] & (self.hessian > 0))
            node, amounts = node[chosen], (self.gradient[chosen], self.hessian[chosen])
        base, place = room[0, : len(node)], room[1, : len(node)]
        # Rows that reached a leaf have no gradient left and add zero to the first node.
        np.maximum(np.subtract(node, width - 1, out=base, dtype=np.int64), 0, out=base)
        for k in used:
            size = bundles[k].cells
            np.multiply(base, size, out=place)
            place += codes[k] if chosen is None else codes[k].take(chosen)
            if sums[k] is None:
                sums[k] = np.zeros((2, width * size))
            for total, values in zip(sums[k], amounts):
                total += np.bincount(place, values, width * size)

    def descended(self, bundle: np.ndarray, after: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The nodes after one more level. ``bundle`` is the one that a node looks at, ``after`` the next node by node and cell."""
        place, node = room[0, : self.rows], room[1, : self.rows]
        node[:] = self.node
        np.take(bundle, node, out=place, mode="clip")
        place *= self.rows
        place += np.arange(self.rows)
        node *= after.shape[1]
        node += np.take(self.codes.reshape(-1), place, mode="clip")
        return np.take(after.reshape(-1), node, mode="clip")

    def descend(self, bundle: np.ndarray, after: np.ndarray, is_leaf: np.ndarray, room: np.ndarray) -> None:
        """Move all rows by one level."""
        self.node = self.descended(bundle, after, room)
        if is_leaf.any():
            done = is_leaf[self.node]
            self.gradient[done] = 0
            self.hessian[done] = 0


def _next_nodes(tree: Tree, level: int, bundles: list[Bundle], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all nodes up to a level: the bundle of its split, and the node after it for each cell. A leaf stays."""
    count, widest = (2 << level) - 1, max(bundle.cells for bundle in bundles)
    looks, after = np.zeros(count, np.int64), np.repeat(np.arange(count, dtype=np.uint16)[:, None], widest, axis=1)
    home = {column: (k, stride) for k, bundle in enumerate(bundles) for column, stride in zip(bundle.columns, bundle.strides)}
    for node in np.flatnonzero(tree.feature[:count] >= 0):
        if node < (1 << level) - 1:
            # Rows have passed this node already.
            continue
        column = int(tree.feature[node])
        looks[node], stride = home[column]
        after[node] = 2 * node + 1 + ((np.arange(widest) // stride) % int(sizes[column]) > tree.cut[node])
    return looks, after


def _single(sums: list[np.ndarray | None], level: int, columns: np.ndarray, bundles: list[Bundle], sizes: np.ndarray) -> np.ndarray:
    """Sums by feature, 2 x nodes x bins of the drawn columns, from those by bundle."""
    width, parts = 1 << level, {}
    for bundle, joint in zip(bundles, sums):
        if joint is None:
            continue
        for column, stride in zip(bundle.columns, bundle.strides):
            size = int(sizes[column])
            split = joint.reshape(2, width, -1, size, stride)
            parts[column] = split.sum(axis=(2, 4)) if len(bundle.columns) > 1 else split.reshape(2, width, size)
    return np.concatenate([parts[int(column)] for column in columns], axis=2)


class Exchange:
    """What the tasks of a barrier stage hand to each other: files below a folder that they share, for one task memory."""

    def __init__(self, folder: str | None, rank: int, tasks: int):
        self.folder, self.rank, self.tasks, self.step = folder, rank, tasks, 0
        if tasks > 1:
            os.makedirs(folder, exist_ok=True)

    def _put(self, name: str, data: bytes) -> None:
        path = f"{self.folder}/{name}"
        with open(f"{path}.part", "wb") as file:
            file.write(data)
        # A file is there as a whole or not at all.
        os.rename(f"{path}.part", path)

    def _get(self, name: str) -> bytes:
        pause, begun = 0.0001, time.monotonic()
        while True:
            try:
                with open(f"{self.folder}/{name}", "rb") as file:
                    return file.read()
            except FileNotFoundError:
                waited = time.monotonic() - begun
                if waited > GANG_WAIT_SECONDS:
                    raise TimeoutError(f"no {name} from another task of the training") from None
                time.sleep(pause)
                pause = 0.0005 if waited < 2 else 0.02

    def added(self, sums: np.ndarray) -> np.ndarray | None:
        """In the first task the sums of all tasks, in their order."""
        if self.rank:
            self._put(f"{self.step}-{self.rank}", sums.tobytes())
            return None
        for rank in range(1, self.tasks):
            sums = sums + np.frombuffer(self._get(f"{self.step}-{rank}")).reshape(sums.shape)
            os.remove(f"{self.folder}/{self.step}-{rank}")
        if self.step and self.tasks > 1:
            # Every task has sent its sums of this step and so has read the one before.
            os.remove(f"{self.folder}/{self.step - 1}")
        return sums

    def told(self, found: tuple | None) -> tuple:
        """What the first task has found, in all tasks. Ends a step."""
        if self.tasks > 1:
            if self.rank:
                found = pickle.loads(self._get(f"{self.step}"))
            else:
                self._put(f"{self.step}", pickle.dumps(found))
        self.step += 1
        return found


def _fewer_rows(tree: Tree, level: int, node: np.ndarray) -> np.ndarray:
    """Of the two nodes below each split of a level, the one with fewer of the given rows, by node."""
    first, counts = (2 << level) - 1, np.bincount(node, minlength=(4 << level) - 1)
    left = np.arange(first, (4 << level) - 1, 2)
    counted = np.zeros(len(tree.feature), bool)
    counted[np.where(counts[left] <= counts[left + 1], left, left + 1)] = True
    return counted


def _with_siblings(sums: np.ndarray, parents: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """A level's sums from those of the counted nodes: the other node below a split has what is left of its parent."""
    width = sums.shape[1]
    others = np.flatnonzero(~counted[width - 1 : 2 * width - 1])
    result = sums.copy()
    result[:, others] = parents[:, others // 2] - sums[:, others ^ 1]
    # Rounding may leave a trace below zero where nothing is left.
    np.maximum(result[1], 0, out=result[1])
    return result


def _grow_together(pieces: list[Piece], exchange: Exchange, sizes: np.ndarray, bundles: list[Bundle], settings: Settings, halves: bool = False) -> list[Tree]:
    """All trees, in one task of several that hold the rows. With ``halves``, of two nodes below a split one is counted."""
    room = np.empty((2, max(piece.rows for piece in pieces)), np.int64)
    trees: list[Tree] = []
    for round_ in range(settings.rounds):
        columns = drawn_columns(len(sizes), round_, settings)
        used = [k for k, bundle in enumerate(bundles) if set(bundle.columns) & set(columns.tolist())]
        tree = Tree.empty(settings.depth)
        for piece in pieces:
            piece.begin(round_, settings)
        sums, counted = None, None
        for level in range(settings.depth):
            joint: list[np.ndarray | None] = [None] * len(bundles)
            for piece in pieces:
                piece.add(joint, used, level, counted, bundles, room)
            own = _single(joint, level, columns, bundles, sizes)
            first, width = (1 << level) - 1, 1 << level
            # Nodes that are open: the root, then those of which the parent was split.
            open_ = np.ones(1, bool) if not level else tree.feature[(np.arange(width) + first - 1) // 2] >= 0
            asked = open_ if counted is None else open_ & counted[first : first + width]
            added, more = exchange.added(own[:, asked]), None
            if added is not None:
                parents, sums = sums, np.zeros_like(own)
                sums[:, asked] = added
                if counted is not None:
                    sums = _with_siblings(sums, parents, counted)
                    sums[:, ~open_] = 0
                if level == 0:
                    _enter_root(tree, sums, columns, sizes, settings)
                more = _split_level(tree, level, sums, columns, sizes, settings)
                if halves and more:
                    # Which nodes have fewer rows is seen in some rows of the first task.
                    moved = pieces[0].descended(*_next_nodes(tree, level, bundles, sizes), room)
                    counted = _fewer_rows(tree, level, moved)
            tree, more, counted = exchange.told((tree, more, counted))
            if not more:
                break
            looks, after = _next_nodes(tree, level, bundles, sizes)
            is_leaf = tree.feature < 0
            # Children of this level's splits are open.
            is_leaf[(2 << level) - 1 :] = False
            for piece in pieces:
                piece.descend(looks, after, is_leaf, room)
        for piece in pieces:
            piece.margin += tree.value[piece.node]
        trees.append(tree)
    return trees


class Gang(NamedTuple):
    """How rows are dealt to the tasks of a barrier stage: ``firsts`` is the place of each block's first piece."""

    tasks: int
    rows: int
    firsts: dict[int, int]
    pieces: int
    folder: str | None


def _gang(stored: RDD, settings: Settings) -> Gang | None:
    """None where a barrier stage cannot run: its tasks must all run at once, hold all rows and share a mounted folder.

    Rows of one block need one task and no folder.
    """
    context = stored.context
    if settings.depth > 14 or (context.getConf().get("spark.dynamicAllocation.enabled") or "false").lower() == "true":
        return None
    scala = context._jsc.sc()
    slots = scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())
    # One pair of numbers for each block.
    counts = dict(stored.map(lambda block: (block.number, len(block.label))).collect())
    total, most, shared = sum(counts.values()), min(slots, GANG_TASKS), urlsplit(context.getCheckpointDir() or "")
    folder = f"{shared.path}/gang-{uuid.uuid4().hex}" if shared.scheme == "file" else None
    if folder is None:
        most = 1 if total <= BLOCK_ROWS else 0
    if not total or most < 1 or total > most * GANG_ROWS:
        return None
    least, largest = PIECE_ROWS
    rows, firsts, pieces = min(largest, max(least, total // (4 * most) // 4 * 4)), {}, 0
    for number in sorted(counts):
        firsts[number] = pieces
        pieces += -(-counts[number] // rows)
    return Gang(min(most, pieces), rows, firsts, pieces, folder)


def grow(blocks: RDD, sizes: np.ndarray, settings: Settings) -> list[Tree]:
    """All trees, one after the other, from margin 0."""
    stored, gang = blocks.persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        gang = _gang(stored, settings)
        if gang is None:
            return _grow_by_jobs(stored, sizes, settings)
        # Joint histograms and halves pay where a piece has more rows than they have cells.
        many = gang.rows == PIECE_ROWS[1]
        bundles = bundles_of(sizes, JOINT_CELLS if many else 0)

        def cut(block: Block) -> Iterator[tuple]:
            for k, start in enumerate(range(0, len(block.label), gang.rows)):
                part = slice(start, start + gang.rows)
                place = gang.firsts[block.number] + k
                yield place, (block.number, start, np.ascontiguousarray(block.bins[:, part]), block.label[part], block.weight[part])

        def together(items: Iterator[tuple]) -> Iterator[list[Tree]]:
            context = BarrierTaskContext.get()
            pieces = [(place, Piece(*given, bundles)) for place, given in items]
            held = [piece for _, piece in sorted(pieces, key=lambda item: item[0])]
            # Every attempt of the stage has a folder of its own, which its first task names.
            name = context.allGather(uuid.uuid4().hex)[0] if gang.tasks > 1 else None
            exchange = Exchange(f"{gang.folder}/{name}", context.partitionId(), gang.tasks)
            trees = _grow_together(held, exchange, sizes, bundles, settings, many)
            if exchange.rank == 0:
                yield trees

        dealt = stored.flatMap(cut).partitionBy(gang.tasks, lambda place: place * gang.tasks // gang.pieces)
        (trees,) = dealt.barrier().mapPartitions(together).collect()
        return trees
    finally:
        stored.unpersist()
        if gang is not None and gang.tasks > 1:
            shutil.rmtree(gang.folder, ignore_errors=True)


def _grow_by_jobs(blocks: RDD, sizes: np.ndarray, settings: Settings) -> list[Tree]:
    """The same with a job for each level, whose blocks need not be in memory."""
    stored, before = blocks.persist(StorageLevel.MEMORY_AND_DISK), None
    trees: list[Tree] = []
    for round_ in range(settings.rounds):
        columns = drawn_columns(len(sizes), round_, settings)
        tree = Tree.empty(settings.depth)
        for level in range(settings.depth):

            def partial(block: Block, tree=tree, level=level, columns=columns, round_=round_) -> np.ndarray:
                return _histogram(block, tree, level, columns, sizes, round_, settings)

            sums = _added(stored.map(partial))
            if level == 0:
                # This level's pass has stored the margins.
                if before is not None:
                    before.unpersist()
                _enter_root(tree, sums, columns, sizes, settings)
            if not _split_level(tree, level, sums, columns, sizes, settings):
                break
        trees.append(tree)
        if round_ + 1 < settings.rounds:
            # Stored by the first pass of the next round.
            before, stored = stored, stored.map(lambda block, tree=tree: advanced(block, tree, settings.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if len(trees) % STORE_EVERY == 0:
                stored.checkpoint()
                stored.count()
    stored.unpersist()
    return trees


def _node_rows(number: int, tree: Tree, edges: list[np.ndarray]) -> Iterator[tuple]:
    """A tree's nodes as Spark stores them, numbered level by level. Spark's margins are half log-odds."""
    kept, place = [0], {0: 0}
    for node in kept:
        if tree.feature[node] >= 0:
            for child in (2 * node + 1, 2 * node + 2):
                place[child] = len(kept)
                kept.append(child)
    for node in kept:
        cover, value, feature = float(tree.cover[node]), float(tree.value[node]) / 2, int(tree.feature[node])
        children = [place[2 * node + 1], place[2 * node + 2]] if feature >= 0 else [-1, -1]
        split = (feature, [float(edges[feature][tree.cut[node]])], -1) if feature >= 0 else (-1, [], -1)
        gain = float(tree.gain[node]) if feature >= 0 else -1.0
        yield number, (place[node], value, 0.0, [cover, cover * value, cover * value * value], max(1, round(cover)), gain, *children, split)


def as_spark_model(spark: SparkSession, trees: list[Tree], edges: list[np.ndarray], settings: Settings, features: str, label: str) -> GBTClassificationModel:
    """The trees as a model of Spark ML: its description is taken from a small fitted one, its trees are these."""
    size, folder = len(edges), working_folder(spark, "booster")
    rows = [(Vectors.dense([float(k % 2)] * size), float(k % 2)) for k in range(4)]
    estimator = GBTClassifier(
        featuresCol=features, labelCol=label, maxIter=1, maxDepth=settings.depth, stepSize=settings.rate, subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share), maxBins=settings.bins, seed=settings.seed,
    )
    estimator.fit(spark.createDataFrame(rows, [features, label])).write().save(f"{folder}/form")
    described = json.loads(spark.read.text(f"{folder}/form/metadata").first()[0])
    described["numTrees"], described["numFeatures"] = len(trees), size
    described["paramMap"]["maxIter"] = len(trees)
    form = spark.read.parquet(f"{folder}/form/treesMetadata")
    names, (_, tree_form, _) = form.columns, form.first()
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
    listed = spark.createDataFrame([(k, tree_form, 1.0) for k in range(len(trees))], form.schema).toDF(*names)
    listed.coalesce(1).write.parquet(f"{folder}/model/treesMetadata")
    nodes = [row for k, tree in enumerate(trees) for row in _node_rows(k, tree, edges)]
    # Types are right by making; checking tens of thousands of nested rows takes seconds.
    spark.createDataFrame(nodes, NODE_SCHEMA, verifySchema=False).coalesce(1).write.parquet(f"{folder}/model/data")
    return GBTClassificationModel.load(f"{folder}/model")


def trees(rows: DataFrame, features: str, label: str, weight: str, settings: Settings) -> tuple[list[np.ndarray], list[Tree]]:
    """The borders of every feature's bins, and all trees. ``rows`` should be stored, in a fixed order."""
    ensure_checkpoint_dir(rows.sparkSession)
    size = rows.select(F.size(vector_to_array(features))).first()[0]
    edges = feature_edges(rows, features, size, settings.bins)
    sizes = np.array([len(edge) + 1 for edge in edges])
    return edges, grow(blocks_of(rows, features, label, weight, edges), sizes, settings)


def fit(rows: DataFrame, features: str, label: str, weight: str, settings: Settings) -> GBTClassificationModel:
    """Boosted trees for a 0/1 label. Nulls are errors, as in Spark ML."""
    edges, grown = trees(rows, features, label, weight, settings)
    return as_spark_model(rows.sparkSession, grown, edges, settings, features, label)
