"""Operator 11, Merkle dataset manifest: one digest per row, a tree per group, a tree over the groups.

Rows are hashed where they are read, so only digests move. A range partitioning over (group, key) and the row counts
of its parts give every leaf its number inside its group. Each level is an equijoin of its nodes with themselves on
computed sibling numbers: XOR 1 where runs have two nodes, else one join for each slot offset. Nodes in slot zero then
emit the parents, which are written to the shared folder as the next level. A level has all groups' nodes, spread by
(tree, number), so a group with most of the rows is no hot key. Proofs go down the same way: a node's proof is its own
siblings before its parent's proof.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardtide.functions.once import computed_once
from cardtide.llm.shared import shared_folder

#: Rows of a level or of a table of groups that a join may broadcast; each has at most some kilobytes.
SMALL = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def encoded(values: list[Column]) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; all fields in one string."""
    texts = [value.cast("string") for value in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_of(values: list[Column]) -> Column:
    return F.unhex(F.sha2(encoded(values), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def combined(digests: Column) -> Column:
    """H of consecutive digests, which go in as hex text."""
    return F.unhex(F.sha2(shown(digests), 256))


class Manifest(NamedTuple):
    """``root`` as hex, None for an empty table. ``leaves``: the carried columns, ``leaf``, ``subroot``, ``number`` of
    the leaf in its group and of the group, and ``proof``: for each level, from the leaf to the root, the other nodes of
    its run in slot order, 32 bytes each."""

    root: str | None
    leaves: DataFrame
    arity: int
    group_levels: int


def _hint(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= SMALL else frame


def _stored(frame: DataFrame, folder: str) -> DataFrame:
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def _numbered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Add ``part`` and ``place``, the number of the row in the given order, nulls first. Equal rows are dealt to
    several parts by their place in the input."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    parts = _stored(
        spread.drop("tie").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), folder
    )
    # One row per part.
    counts = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    return parts.join(F.broadcast(offsets), "part").withColumn("place", F.col("row") + F.col("offset")).drop("row", "offset")


def _with_siblings(nodes: DataFrame, arity: int, rows: int) -> DataFrame:
    """Add ``siblings``: the digests of the other nodes of the run, in slot order."""
    slot = F.col("number") % arity
    joined = nodes
    for offset in range(1, arity):
        other = F.col("number").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("number") - slot + (slot + offset) % arity
        shifted = nodes.select(F.col("tree").alias("t"), F.col("number").alias("m"), F.col("digest").alias(f"d{offset}"))
        joined = joined.join(_hint(shifted, rows), (F.col("tree") == F.col("t")) & (other == F.col("m")), "left").drop("t", "m")
    # The node in slot s stands s - slot places on from this one.
    found = F.array(*[F.coalesce(f"d{offset}", F.lit(b"")) for offset in range(1, arity)])
    inner = [F.when(slot != s, F.get(found, (F.lit(s - 1) - slot + arity) % arity)).otherwise(F.lit(b"")) for s in range(arity)]
    return joined.withColumn("siblings", F.concat(*inner)).drop(*[f"d{offset}" for offset in range(1, arity)])


def _levels(leaves: DataFrame, rows: int, trees: int, widest: int, arity: int, folder: str) -> list[DataFrame]:
    """Nodes with siblings, level by level. ``width`` counts the nodes of the tree's level; a root has width 1."""
    levels, nodes = [], leaves
    while True:
        levels.append(_stored(_with_siblings(nodes, arity, rows), f"{folder}-{len(levels)}"))
        if widest <= 1:
            return levels
        widest, rows = -(-widest // arity), rows // arity + trees
        first = levels[-1].where((F.col("width") > 1) & (F.col("number") % arity == 0))
        nodes = first.select(
            "tree",
            F.expr(f"number div {arity}").alias("number"),
            F.expr(f"(width + {arity - 1}) div {arity}").alias("width"),
            combined(F.concat("digest", "siblings")).alias("digest"),
        )


def _roots(levels: list[DataFrame]) -> DataFrame:
    found = [level.where("width = 1").select("tree", F.lit(k).alias("level"), "digest") for k, level in enumerate(levels)]
    joined = found[0]
    for more in found[1:]:
        joined = joined.union(more)
    return joined


def _descended(levels: list[DataFrame], starts: DataFrame, rows: int, trees: int, arity: int) -> DataFrame:
    """Level 0 with ``proof`` and what ``starts`` (tree, level, proof, more) says about its tree's root."""
    carried = [name for name in starts.columns if name not in ("tree", "level", "proof")]
    heights = {row["level"] for row in starts.select("level").distinct().collect()} or {0}  # at most as many as levels
    counts = [rows]
    for _ in levels:
        counts.append(counts[-1] // arity + trees)
    above = None
    for k in reversed(range(len(levels))):
        level, both = levels[k], []
        if k in heights:
            at = starts.where(F.col("level") == k).drop("level")
            both.append(level.where("width = 1").join(_hint(at, trees), "tree"))
        if above is not None:
            parents = above.select(F.col("tree").alias("t"), F.col("number").alias("m"), "proof", *carried)
            inner = level.where("width > 1").join(
                _hint(parents, counts[k + 1]), (F.col("tree") == F.col("t")) & (F.expr(f"number div {arity}") == F.col("m"))
            )
            both.append(inner.drop("t", "m").withColumn("proof", F.concat(F.array("siblings"), "proof")))
        above = both[0] if len(both) == 1 else both[0].unionByName(both[1])
        if k:
            above = above.select("tree", "number", "proof", *carried)
    return above


def manifest(
    rows: DataFrame, group: str, order: list[str], leaf: Column, carried: dict[str, Column] | None = None, arity: int = 2
) -> Manifest:
    """Trees of the rows of each ``group`` by ``order`` (nulls first, then the leaf), and one over the groups' roots.

    While a level has more than one node, every ``arity`` consecutive ones become their H; the last run may have fewer,
    even one. Null is a group like others. Repeated rows are leaves each. An empty table has no root and no leaves. Only
    columns that the arguments name are read; ``carried`` are the columns of the result besides the tree's.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    spark, folder, carried = rows.sparkSession, shared_folder(rows.sparkSession, "manifest"), carried or {}
    hashed = _stored(
        rows.select(
            F.col(group).alias("group"),
            *[F.col(name).alias(f"order{k}") for k, name in enumerate(order)],
            leaf.alias("digest"),
            *[value.alias(f"carried_{name}") for name, value in carried.items()],
        ),
        f"{folder}/hashed",
    )
    sequence = ["group", *[f"order{k}" for k in range(len(order))], "digest"]
    placed = _numbered(hashed, sequence, f"{folder}/placed")
    # A group lies in few parts and a part holds few groups: one row for each pair that occurs.
    pieces = placed.groupBy("part", "group").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    pieces = _stored(pieces, f"{folder}/pieces")
    trees = _stored(
        pieces.groupBy("group").agg(F.min("place").alias("tree"), F.sum("n").alias("width")), f"{folder}/trees"
    )
    count, total, widest = trees.agg(F.count("*"), F.sum("width"), F.max("width")).first()
    count, total, widest = count or 0, total or 0, widest or 0
    same_group = F.col("group").eqNullSafe(F.col("g"))
    named = _hint(trees.withColumnRenamed("group", "g"), count)
    spans = pieces.select("part", "group").join(named, same_group).select(
        F.col("part").alias("p"), "g", "tree", "width"
    )
    n_pieces = pieces.count()
    leaves = placed.join(_hint(spans, n_pieces), (F.col("part") == F.col("p")) & same_group).select(
        "tree", (F.col("place") - F.col("tree")).alias("number"), "width", "digest", *[f"carried_{name}" for name in carried]
    )
    levels = _levels(leaves, total, count, widest, arity, f"{folder}/level")
    roots = _stored(_roots(levels), f"{folder}/roots")
    over = _numbered(roots.select(F.col("tree").alias("under"), F.col("level").alias("height"), "digest"), ["under"], f"{folder}/groups")
    over = over.select(
        F.lit(-1).cast("long").alias("tree"), F.col("place").alias("number"), F.lit(count).cast("long").alias("width"), "digest", "under", "height"
    )
    top = _levels(over, count, 1, count, arity, f"{folder}/top")
    root = top[-1].where("width = 1").select(shown(F.col("digest"))).first()
    start = spark.range(1 if count else 0).select(
        F.lit(-1).cast("long").alias("tree"), F.lit(len(top) - 1).alias("level"), F.array().cast("array<binary>").alias("proof")
    )
    groups = _descended(top, start, count, 1, arity).select(
        F.col("under").alias("tree"),
        F.col("height").alias("level"),
        "proof",
        F.col("digest").alias("subroot"),
        F.col("number").alias("group_number"),
    )
    groups = _stored(groups, f"{folder}/starts")
    down = _descended(levels, groups, total, count, arity)
    return Manifest(
        root[0] if root else None,
        down.select(
            *[F.col(f"carried_{name}").alias(name) for name in carried], F.col("digest").alias("leaf"), "subroot", "number", "group_number", "proof"
        ),
        arity,
        len(top) - 1,
    )


def folded(made: Manifest, leaf: Column) -> Column:
    """The root that ``leaf`` and the proof of its row give."""
    inside = F.size("proof") - made.group_levels

    def step(state: Column, siblings: Column) -> Column:
        number = F.when(state["left"] == 0, F.col("group_number")).otherwise(state["number"])
        before = ((number % made.arity) * _DIGEST).cast("int")
        run = F.concat(F.substring(siblings, F.lit(1), before), state["digest"], F.substring(siblings, before + 1, F.length(siblings)))
        return F.struct(
            combined(run).alias("digest"),
            ((number - number % made.arity) / made.arity).cast("long").alias("number"),
            (state["left"] - 1).alias("left"),
        )

    start = F.struct(leaf.alias("digest"), F.col("number").alias("number"), inside.alias("left"))
    return F.aggregate("proof", start, step, lambda state: state["digest"])


def manifest_report(documents: DataFrame, arity: int = 2) -> DataFrame:
    """Leaf, roots, proof digest and a tampering check of every row of ``documents``, a tree per language.

    Where 7 divides the CRC-32 of the decimal id, n_chars counts one more in the copy that is checked. Rows without an id
    or without n_chars have nothing to tamper with. Nulls of any column enter the leaf as ``-``. Equal ids are ordered by
    leaf; repeated rows have a leaf each; an empty table gives an empty result; other columns are not read.
    """
    known = {name: F.col(name) for name in FIELDS}
    hit = F.coalesce(F.crc32(known["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    changed = known | {"n_chars": F.when(hit, known["n_chars"] + 1).otherwise(known["n_chars"])}
    tampered = F.when(hit, leaf_of(list(changed.values())))
    made = manifest(
        documents, "lang", ["doc_id"], leaf_of(list(known.values())), {"doc_id": known["doc_id"], "tampered": tampered}, arity
    )
    checked = computed_once(made.leaves, {"folded_root": shown(folded(made, F.coalesce("tampered", "leaf")))})
    root = F.lit(made.root).cast("string")
    return checked.select(
        "doc_id",
        shown(F.col("leaf")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.array_join(F.transform("proof", shown), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
