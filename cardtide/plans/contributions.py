"""Additive contributions of each feature to a boosted-tree score.

Path-dependent Shapley values (Lundberg et al., arXiv:1802.03888). Within one leaf a value depends
only on which of the features on its path a row satisfies. With at most six distinct features on a
path there are at most 64 such patterns, so each leaf gets a table of them in advance. Leaves below one
node share most of their paths: as long as these hold few splits, the leaves' tables are added up into
one over the outcomes of all those splits. Scoring a batch is then one comparison for each split of the
model and a lookup for each such group, column by column. Leaves with longer paths are worked out one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import factorial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cardtide.operators.explanations import top_contributions
from cardtide.session import ensure_checkpoint_dir

#: Leaves with more features on their path are evaluated row by row of the batch, without a table.
TABLE_FEATURES = 6
#: Most splits on the paths of a group of leaves; its table has two to this power columns.
GROUP_SPLITS = 8


def tree_nodes(model, spark) -> DataFrame:
    """Nodes of all trees as rows, read back from Spark's own model format."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{model.uid}"
    model.write().overwrite().save(folder)
    weights = spark.read.parquet(f"{folder}/treesMetadata")
    tree, _, weight = weights.columns
    return (
        spark.read.parquet(f"{folder}/data")
        .join(F.broadcast(weights.select(F.col(tree).alias("treeID"), F.col(weight).alias("weight"))), "treeID")
        .select("treeID", "weight", "nodeData.*")
    )


def collected_nodes(model, spark) -> dict[int, dict]:
    """Nodes by tree and number. They are those of a model, not rows of a table, and are read once for each model object."""
    if getattr(model, "_collected_nodes", None) is None:
        trees: dict[int, dict] = {}
        for row in tree_nodes(model, spark).collect():
            trees.setdefault(row["treeID"], {})[row["id"]] = row
        model._collected_nodes = dict(sorted(trees.items()))
    return model._collected_nodes


def path_values(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1: last axis is the path's features, ``met`` is 1 where satisfied.

    The sum over coalitions of one size is a coefficient of the product of (share + met * x) over
    the other features, so all rows, patterns or leaves of a batch are multiplied out at once.
    """
    size = met.shape[-1]
    weights = [factorial(count) * factorial(size - count - 1) / factorial(size) for count in range(size)]
    result = np.empty(np.broadcast_shapes(met.shape, shares.shape))
    for i in range(size):
        sums = [1.0]
        for j in range(size):
            if j != i:
                stay, grow = shares[..., j], met[..., j]
                sums = [low * stay + high * grow for low, high in zip([*sums, 0.0], [0.0, *sums])]
        total = sum(weight * coefficient for weight, coefficient in zip(weights, sums))
        result[..., i] = (met[..., i] - shares[..., i]) * total
    return result


def _patterns(size: int) -> np.ndarray:
    return (np.arange(1 << size)[:, None] >> np.arange(size)) & 1


@dataclass
class Leaf:
    """Path features, their allowed intervals and shares, the leaf's value, and its table if it has one."""

    features: list[int]
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    value: float
    table: np.ndarray | None = None


@dataclass
class LeafGroup:
    """Leaves below one node: the splits of their paths, and contributions (features x outcomes of these splits)."""

    splits: list[int]
    features: list[int] = field(default_factory=list)
    table: np.ndarray | None = None


@dataclass
class LeafTables:
    """All leaves of a model and its expected margin. Bounded by rounds x 2^depth, independent of the data."""

    leaves: list[Leaf]
    expected: float
    #: Feature and border of each split of the model; a row's outcome is whether it is above the border.
    splits: list[tuple[int, float]]
    groups: list[LeafGroup]
    #: Leaves that are in no group.
    alone: list[Leaf]


def split_of(node) -> tuple[tuple[int, float], bool]:
    """Feature and border, and whether the left child has the values up to the border."""
    split = node["split"]
    if split["numCategories"] == -1:
        return (split["featureIndex"], split["leftCategoriesOrThreshold"][0]), True
    # One-hot columns: two categories, so a half-way threshold separates them.
    return (split["featureIndex"], 0.5), 0.0 in split["leftCategoriesOrThreshold"]


def _splits_below(nodes: dict) -> dict[int, set]:
    """Splits of each node and of those below it. Children have higher numbers than their parents."""
    below: dict[int, set] = {}
    for number in sorted(nodes, reverse=True):
        node = nodes[number]
        below[number] = set()
        if node["leftChild"] >= 0:
            below[number] = {split_of(node)[0]} | below[node["leftChild"]] | below[node["rightChild"]]
    return below


def _add_leaf(group: LeafGroup, leaf: Leaf, steps: list[tuple[int, bool]], splits: list[tuple[int, float]]) -> None:
    """Add a leaf's table to its group's: a feature is satisfied when all its splits on the path went the path's way."""
    outcomes = np.arange(1 << len(group.splits))
    pattern = np.zeros(len(outcomes), np.int64)
    for k, feature in enumerate(leaf.features):
        # Bits of the feature's splits, and those of them that must be set. A path never asks for both sides of a split.
        asked = wanted = 0
        for split, above in steps:
            if splits[split][0] == feature:
                bit = 1 << group.splits.index(split)
                asked, wanted = asked | bit, wanted | bit * above
        pattern += ((outcomes & asked) == wanted).astype(np.int64) << k
    for k, feature in enumerate(leaf.features):
        group.table[group.features.index(feature)] += leaf.table[pattern, k]


def leaf_tables(model, spark) -> LeafTables:
    """Read the trees once, and fill the tables of all leaves with equally long paths together."""
    trees = collected_nodes(model, spark)
    leaves, expected, numbers = [], 0.0, {}
    grouped: list[tuple[LeafGroup | None, Leaf, list]] = []
    for nodes in trees.values():
        root, below = nodes[0]["impurityStats"][0], _splits_below(nodes)
        stack = [(0, {}, [], None)]
        while stack:
            identifier, path, steps, group = stack.pop()
            node = nodes[identifier]
            if group is None:
                wanted = {numbers.setdefault(split, len(numbers)) for split in below[identifier]} | {split for split, _ in steps}
                if len(wanted) <= GROUP_SPLITS:
                    group = LeafGroup(sorted(wanted))
            if node["leftChild"] < 0:
                # Raw margins are half log-odds.
                value = 2 * node["weight"] * node["prediction"]
                expected += value * node["impurityStats"][0] / root
                names = sorted(path)
                bounds = np.array([path[name] for name in names]).reshape(-1, 3)
                leaves.append(Leaf(names, bounds[:, 0], bounds[:, 1], bounds[:, 2], value))
                grouped.append((group, leaves[-1], steps))
                continue
            (feature, edge), left_is_low = split_of(node)
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            cover = node["impurityStats"][0]
            for child, is_left in ((node["leftChild"], True), (node["rightChild"], False)):
                above = is_left != left_is_low
                interval = (max(low, edge), high) if above else (low, min(high, edge))
                portion = nodes[child]["impurityStats"][0] / cover
                step = (numbers.setdefault((feature, edge), len(numbers)), above)
                stack.append((child, {**path, feature: (*interval, share * portion)}, [*steps, step], group))
    by_size: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        by_size.setdefault(len(leaf.features), []).append(leaf)
    for size, same in by_size.items():
        if 0 < size <= max(TABLE_FEATURES, GROUP_SPLITS):
            shares = np.array([leaf.shares for leaf in same])[:, None, :]
            tables = path_values(_patterns(size)[None, :, :], shares)
            for leaf, table in zip(same, tables):
                leaf.table = leaf.value * table
    splits, groups, alone = list(numbers), {}, []
    for group, leaf, steps in grouped:
        if group is None:
            alone.append(leaf)
        elif leaf.features:
            groups.setdefault(id(group), (group, []))[1].append((leaf, steps))
    for group, members in groups.values():
        group.features = sorted({feature for leaf, _ in members for feature in leaf.features})
        group.table = np.zeros((len(group.features), 1 << len(group.splits)))
        for leaf, steps in members:
            _add_leaf(group, leaf, steps, splits)
    return LeafTables(leaves, expected, splits, [group for group, _ in groups.values()], alone)


def leaf_values(matrix: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Rows x features, leaf by leaf."""
    result = np.zeros_like(matrix)
    for leaf in leaves:
        if not leaf.features:
            continue
        columns = matrix[:, leaf.features]
        met = (columns > leaf.low) & (columns <= leaf.high)
        if leaf.table is None:
            result[:, leaf.features] += leaf.value * path_values(met.astype(float), leaf.shares)
        else:
            result[:, leaf.features] += leaf.table[met @ (1 << np.arange(len(leaf.features)))]
    return result


def contribution_values(matrix: np.ndarray, tables: LeafTables) -> np.ndarray:
    """Rows x features; every split is compared, and every group looked up, for the whole batch."""
    columns = np.ascontiguousarray(matrix.T)
    above = [(columns[feature] > edge).astype(np.int16) for feature, edge in tables.splits]
    result, found = np.zeros_like(columns), np.empty(len(matrix))
    for group in tables.groups:
        outcome = np.zeros(len(matrix), np.int16)
        for k, split in enumerate(group.splits):
            outcome += above[split] << k
        place = outcome.astype(np.intp)
        for feature, amounts in zip(group.features, group.table):
            result[feature] += np.take(amounts, place, out=found, mode="clip")
    return result.T + leaf_values(matrix, tables.alone)


def shared_tables(bundle, spark):
    """The broadcast tables of a bundle: built at first use, then the same for every batch."""
    application = spark.sparkContext.applicationId
    if bundle.tables is None or bundle.tables[0] != application:
        # Leaves that are in a group are not looked at any more.
        tables = replace(leaf_tables(bundle.pipeline.stages[-1], spark), leaves=[])
        bundle.tables = (application, spark.sparkContext.broadcast(tables))
    return bundle.tables[1]


def _explained(vectors: list, tables: LeafTables, tolerant: bool) -> tuple[list, list]:
    """Contributions and totals of each row. If ``tolerant``, a batch that fails is halved until only the failing rows get none."""
    try:
        values = contribution_values(np.stack(vectors).astype(float), tables)
        return list(values), list(values.sum(axis=1) + tables.expected)
    except Exception:  # noqa: BLE001 - an explanation never blocks a score of the stream
        if not tolerant:
            raise
        if len(vectors) == 1:
            return [None], [None]
        middle = len(vectors) // 2
        halves = [_explained(part, tables, tolerant) for part in (vectors[:middle], vectors[middle:])]
        return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]


def with_contributions(raw: DataFrame, bundle, limit: int = 6, total: str | None = None, tolerant: bool = False) -> DataFrame:
    """Add ``explanation``: the strongest contributions of each row.

    Only the feature array crosses to Python, in Arrow batches. A row that cannot be explained is an error. If
    ``tolerant``, it gets an empty list and does not stop scoring; who asks for that counts such rows, as the decision
    stream and ``explanation_failures`` do. With ``total``, also add a column of that name: all contributions of the row
    plus the expected margin.
    """
    tables = shared_tables(bundle, raw.sparkSession)

    @F.pandas_udf("struct<amounts:array<double>,total:double>")
    def contributions(features):  # type: ignore[no-untyped-def]
        import pandas as pd

        if not len(features):
            return pd.DataFrame({"amounts": [], "total": []})
        amounts, totals = _explained(list(features), tables.value, tolerant)
        return pd.DataFrame({"amounts": amounts, "total": totals})

    names = F.array(*[F.lit(name) for name in bundle.feature_names])
    zipped = F.zip_with(
        F.col("_vector"),
        F.col("_contributions.amounts"),
        lambda value, amount: F.struct(value.alias("value"), amount.alias("contribution")),
    )
    named = F.transform(
        zipped,
        lambda item, index: F.struct(
            F.get(names, index).alias("feature"),
            item["value"].cast("string").alias("value"),
            item["contribution"].alias("contribution"),
        ),
    )
    empty = F.array().cast("array<struct<feature:string,value:string,contribution:double>>")
    extra = {total: F.col("_contributions.total")} if total else {}
    return (
        raw.withColumn("_vector", vector_to_array("features"))
        .withColumn("_contributions", contributions("_vector"))
        .withColumns({"explanation": F.coalesce(top_contributions(named, limit), empty), **extra})
        .drop("_vector", "_contributions")
    )


def explanation_failures(explained: DataFrame, at) -> DataFrame:
    """Metric rows for scored rows that got no contributions."""
    failed = explained.filter(F.size("explanation") == 0)
    return failed.groupBy(at.cast("timestamp").alias("metric_time"), "model_version").agg(
        F.count("*").cast("double").alias("metric_value")
    ).select(
        "metric_time",
        F.lit("shap_explanation_failures").alias("metric_name"),
        "metric_value",
        F.to_json(F.struct("model_version", F.lit("ContributionError").alias("error_type"))).alias("labels"),
    )
