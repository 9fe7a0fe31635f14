"""Operator 8, n-gram Jaccard join: count-vector R-trees over shingle sets.

Shingles are hashed into groups. For sets of a and b shingles with Jaccard similarity of at least ``num / den``,
at most S * (den - num) / (den + num) of the S = a + b elements differ. The groups are used twice:

* **Between tasks.** With ``k`` possible differences, ``k + 1 + SPARE`` groups hold more than ``SPARE`` groups whose
  members agree exactly. Every document emits one 64-bit signature per group (for its own size interval and for
  the one below, so that any two sizes that can link meet in one); documents that share no signature cannot link.
  Signatures travel as packed arrays: each task reduces a signature to one smallest document and links its other
  documents to it, so a copy that a third of all rows share arrives once per task.
* **Within a task.** The documents that signatures connect become points of an R-tree: coordinate i counts the
  shingles of group i. The overlap with anything below a node is at most the sum over i of min(point_i, node
  maximum_i). What survives is verified on the shingles themselves.

Equal sets are reduced to one representative before the tree, and documents already in one component are not
compared again. A connected set that is larger than ``BLOCK_BYTES`` is dealt into blocks, and each pair of blocks
is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardtide.llm.components import components
from cardtide.llm.shared import materialised, shared_folder
from cardtide.llm.words import SPACED, cut, fresh, mix, row_of, sequence_hashes

SHINGLE = 3
NUM, DEN = 90, 100
#: Groups beyond the needed ones, so that no document has to emit signatures of empty groups.
SPARE = 2
#: Signatures that a task holds before it reduces and sends them.
FLUSH = 1 << 20
#: Bytes of shingles in one block of a large connected set.
BLOCK_BYTES = 16 << 20
FANOUT = 32
_U = np.uint64


class Sizes:
    """Size intervals: two sizes that can link are in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1, 2]

    def band(self, sizes: np.ndarray) -> np.ndarray:
        while self.starts[-1] <= (sizes.max() if len(sizes) else 0):
            largest = self.starts[-1] - 1
            self.starts.append(max(self.starts[-1] + 1, self.den * largest // self.num + 1))
        return np.searchsorted(self.starts, sizes, "right") - 1

    def groups(self, band: np.ndarray) -> np.ndarray:
        """Groups for pairs whose smaller set is in the band."""
        self.band(np.array([self.starts[int(band.max())] * 2 + 2]) if len(band) else band)
        largest = np.array(self.starts)[band + 1] - 1
        together = largest + self.den * largest // self.num
        return together * (self.den - self.num) // (self.den + self.num) + 1 + SPARE


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, sorted distinct shingle hashes, and their offsets per row."""
    for words in cut(column, SPACED):
        counts, offsets = words.counts, words.offsets
        values, rows = sequence_hashes(words.hashes, size), row_of(offsets)
        long = np.flatnonzero(counts[rows[: len(values)]] >= size) if len(values) else np.zeros(0, np.int64)
        long = long[rows[long] == rows[long + size - 1]] if len(long) else long
        parts, owners = [values[long]], [rows[long]]
        for few in range(1, size):
            at = np.flatnonzero(counts == few)
            if len(at):
                runs = words.hashes[offsets[at][:, None] + np.arange(few)]
                total = np.full(len(at), _U(few), _U)
                for k in range(few):
                    total = mix(total + runs[:, k] * _U(2 * k + 3))
                parts.append(total)
                owners.append(at)
        value, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield words.first, words.last, value, np.searchsorted(owner, np.arange(words.last - words.first + 1))


def set_table(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc_id``, ``n`` (shingles) and a 128-bit fingerprint of the set, of every row."""

    def narrow(batches):
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            prints = np.zeros((2, batch.num_rows), _U)
            for first, last, values, offsets in shingle_sets(batch.column(1), size):
                count[first:last] = np.diff(offsets)
                for k in range(2):
                    sums = np.concatenate([[_U(0)], np.cumsum(mix(values + _U(k + 1)), dtype=_U)])
                    prints[k, first:last] = sums[offsets[1:]] - sums[offsets[:-1]]
            columns = [batch.column(0), pa.array(count), *(pa.array(p.view(np.int64)) for p in prints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "print_a", "print_b"])

    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(narrow, "doc_id long, n long, print_a long, print_b long")


def signatures(values: np.ndarray, offsets: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Signature and row of every group that may match another document's."""
    counts = np.diff(offsets)
    rows = np.flatnonzero(counts)
    band = sizes.band(counts[rows])
    found, owners = [], []
    spread, weight = mix(values + _U(0x51ED)), mix(values + _U(0xC0DE))
    for step in (0, 1):
        own = rows[band >= step]
        interval = band[band >= step] - step
        if not len(own):
            continue
        groups = np.zeros(len(counts), np.int64)
        groups[own] = sizes.groups(interval)
        base = np.concatenate([[0], np.cumsum(groups)])
        member = row_of(offsets)
        keep = groups[member] > 0
        member = member[keep]
        cell = base[member] + ((spread[keep] >> _U(32)) % groups[member].astype(_U)).astype(np.int64)
        total = np.zeros(base[-1], _U)
        np.add.at(total, cell, weight[keep])
        filled = np.bincount(cell, minlength=base[-1])
        owner = row_of(base)
        empty = np.bincount(owner[filled == 0], minlength=len(counts))
        use = (filled > 0) | (empty[owner] > SPARE)
        level = np.zeros(len(counts), np.int64)
        level[own] = interval
        place = np.arange(base[-1]) - base[owner]
        tag = mix((level[owner] * 1_000_003 + place).astype(_U) + _U(7))
        found.append(mix(total + tag)[use])
        owners.append(owner[use])
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def stars(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest node of each signature, and distinct edges from the other nodes to it."""
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    start = np.ones(len(signature), bool)
    start[1:] = signature[1:] != signature[:-1]
    least = node[start][np.cumsum(start) - 1] if len(node) else node
    other = node != least
    pairs = np.unique(np.stack([least[other], node[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return signature[start], node[start], pairs


def candidate_edges(documents: DataFrame, key: str, text: str, size: int, num: int, den: int, shards: int) -> DataFrame:
    """Edges that connect all documents which share a signature."""

    def emit(signature, node, task):
        signature, node, pairs = stars(signature, node)
        shard = (signature >> _U(40)).astype(np.int64) * shards >> 24
        border = np.searchsorted(shard, np.arange(shards + 1))
        rows = {"shard": [], "signature": [], "node": [], "edges": []}
        for k in range(shards):
            here = slice(border[k], border[k + 1])
            edges = pairs[k::shards]
            if border[k + 1] > border[k] or len(edges):
                rows["shard"].append(k)
                rows["signature"].append(signature[here].tobytes())
                rows["node"].append(node[here].tobytes())
                rows["edges"].append(edges.tobytes())
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True)], list(rows))

    def signed(batches):
        sizes, held, count = Sizes(num, den), [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, values, offsets in shingle_sets(batch.column(1), size):
                signature, row = signatures(values, offsets, sizes)
                held.append((signature, ids[first + row].astype(np.int64)))
                count += len(signature)
                if count >= FLUSH:
                    yield from emit(*map(np.concatenate, zip(*held, strict=True)), 0)
                    held, count = [], 0
        if count:
            yield from emit(*map(np.concatenate, zip(*held, strict=True)), 0)

    def met(table):
        def joined(name, kind):
            return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)

        _, _, pairs = stars(joined("signature", _U), joined("node", np.int64))
        pairs = np.unique(np.concatenate([pairs, joined("edges", np.int64).reshape(-1, 2)]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    packed = texts.mapInArrow(signed, "shard int, signature binary, node binary, edges binary")
    return packed.groupBy("shard").applyInArrow(met, "a long, b long")


class CountTree:
    """An R-tree of count vectors, packed by size and leading coordinates, with two levels of nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        highest, small, large = self.points, self.sizes, self.sizes
        for _ in range(2):
            at = np.arange(0, len(highest), FANOUT)
            highest = np.maximum.reduceat(highest, at, axis=0)
            small, large = np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((highest, small, large))

    def _may(self, point, size, highest, small, large):
        small = np.maximum(small, -(-size * self.num // self.den))
        need = -(-self.num * (size + small) // (self.num + self.den))
        fits = (small <= large) & (small <= self.den * size // self.num)
        return fits & (np.minimum(point, highest).sum(axis=1) >= need)

    def search(self, point: np.ndarray, size: int, open_: np.ndarray) -> np.ndarray:
        """Points with ``open_`` set (by original place) whose bound on the overlap allows a link."""
        at = np.arange(len(self.levels[1][0]))
        for highest, small, large in (*self.levels[::-1], (self.points, self.sizes, self.sizes)):
            if highest is self.points:
                at = at[open_[self.order[at]]]
            at = at[self._may(point, size, highest[at], small[at], large[at])]
            if highest is not self.points:
                below = len(self.levels[0][0]) if highest is self.levels[1][0] else len(self.points)
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.order[at]


def linked(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Star edges (smallest node, node) of the components that verified links form."""
    order = np.argsort(nodes, kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    groups = int(np.clip(sizes.max() // 8, 16, 2048))
    points = np.stack([np.bincount((s >> _U(20)) % _U(groups), minlength=groups) for s in sets]).astype(np.int32)
    tree = CountTree(points, sizes, num, den)
    part = np.arange(len(sets))
    for i in range(len(sets)):
        open_ = part != part[i]
        open_[: i + 1] = False
        if not open_.any():
            continue
        for j in tree.search(points[i], sizes[i], open_):
            if part[i] != part[j]:
                place = np.minimum(np.searchsorted(sets[i], sets[j]), sizes[i] - 1)
                both = int((sets[i][place] == sets[j]).sum())
                if den * both >= num * (sizes[i] + sizes[j] - both):
                    low, high = sorted((part[i], part[j]))
                    part[part == high] = low
    other = part != np.arange(len(sets))
    return np.stack([nodes[part[other]], nodes[other]], axis=1)


def verified_edges(members: DataFrame, documents: DataFrame, key: str, text: str, size: int, num: int, den: int, shards: int) -> DataFrame:
    """Links between the members (node, cluster, n) of each cluster, as star edges."""
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    large = blocks.where("blocks > 1")
    dealt = members.join(large, "cluster", "left").select(
        "node", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
    )
    texts = documents.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))

    def sets(batches):
        for batch in batches:
            blobs = [b""] * batch.num_rows
            for first, last, values, offsets in shingle_sets(batch.column(4), size):
                for row in range(first, last):
                    blobs[row] = values[offsets[row - first] : offsets[row - first + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary())], [*batch.schema.names[:4], "shingles"])

    held = dealt.join(texts, "node").select("node", "cluster", "blocks", "block", "text")
    held = held.mapInArrow(sets, "node long, cluster long, blocks int, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    dealt = held.select("node", "cluster", "blocks", "block", "shingles", other).select(
        "node",
        "cluster",
        "shingles",
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("cluster"), F.lit(16 * shards))).otherwise(F.col("cluster")).alias("pack"),
        F.when(F.col("blocks").isNull(), -1).otherwise(F.least("block", "other")).alias("low"),
        F.when(F.col("blocks").isNull(), -1).otherwise(F.greatest("block", "other")).alias("high"),
    )

    def link(table):
        cluster = table.column("cluster").to_numpy()
        node = table.column("node").to_numpy()
        blobs = table.column("shingles").to_pylist()
        order = np.argsort(cluster, kind="stable")
        border = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order][0] - 1))
        edges = [np.zeros((0, 2), np.int64)]
        for at in np.split(order, border[1:]):
            edges.append(linked(node[at], [np.frombuffer(blobs[i], _U) for i in at], num, den))
        edges = np.concatenate(edges)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return dealt.groupBy("pack", "low", "high").applyInArrow(link, "a long, b long")


def similar_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest doc_id that links of similarity num / den or more reach. Null or empty text
    has no shingles and its own component; with fewer words than ``size`` the whole sequence is one shingle.
    Rows with null doc_id keep their shingle count and have a null component. Rows that repeat a doc_id count as
    one node with the links of all its texts. An empty table gives an empty result; other columns are not read.
    """
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = materialised(set_table(documents, key, text, size))
    named = narrow.where("n > 0 and doc_id is not null")
    same = named.groupBy("print_a", "print_b", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    same = materialised(same)
    clusters = components(candidate_edges(documents, key, text, size, num, den, shards))
    members = same.select("node", "n").join(clusters.withColumnRenamed("component", "cluster"), "node")
    many = members.groupBy("cluster").agg(F.countDistinct("node").alias("nodes")).where("nodes > 1").select("cluster")
    members = materialised(members.join(many, "cluster"))
    # A document id with several texts also joins the components of its texts.
    twice = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = named.join(twice, "doc_id", "left_semi").join(same, ["print_a", "print_b", "n"]).select("doc_id", "node").distinct()
    repeats = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a != node")
    repeats = repeats.select("a", F.col("node").alias("b"))
    links = verified_edges(members, documents, key, text, size, num, den, shards).union(repeats)
    reached = components(links)
    group = same.join(reached, "node", "left").where("copies > 1 or component is not null")
    group = materialised(group.select("print_a", "print_b", "n", F.coalesce("component", "node").alias("group_id")))
    return narrow.join(group, ["print_a", "print_b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("group_id", "doc_id").alias("component_id")
    )


def without_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id, then text digest; ids before null.

    Every row is a node, whatever its id, so rows that repeat an id or have none are linked by their texts, and
    different texts of one id stay. Texts without words are not linked: of these, only rows that repeat both id and
    text are reduced to one. The numbered rows are written to the shared folder, so that their numbers hold.
    """
    spark = documents.sparkSession
    row, kept = fresh(documents, "row", "kept")
    folder = shared_folder(spark, "rows")
    documents.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = similar_documents(rows, row, text, **settings).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    named = rows.select(F.col(row).alias("row"), F.col(key).cast("long").alias("id"), F.md5(F.col(text)).alias("digest"))
    worded = F.col("n_shingles") > 0
    groups = [
        F.when(worded, F.col("component_id")).alias("component"),
        F.when(~worded, F.col("id")).alias("own_id"),
        F.when(~worded, F.col("digest")).alias("own_digest"),
        worded.alias("linked"),
    ]
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "digest", "row"))
    chosen = found.join(named, "row").groupBy(*groups).agg(first.alias(kept)).select(kept)
    return rows.join(chosen, F.col(row) == F.col(kept), "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
