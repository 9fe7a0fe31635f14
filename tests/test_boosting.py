"""The booster against a plain loop over rows, and its Spark model against its trees."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cardtide.plans import boosting

SETTINGS = boosting.Settings(4, 3, 0.3, 1.0, 1.0, 3.0, 2.0, 42, 16)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 2, 600), rng.exponential(size=600), np.zeros(600)])
    y = (rng.random(600) < 1 / (1 + np.exp(2 - 2 * x[:, 0] - x[:, 1]))).astype(float)
    w = np.where(y == 1, 3.0, 1.0)
    rows = [(x[k].tolist(), float(y[k]), float(w[k]), k) for k in range(600)]
    frame = spark.createDataFrame(rows, "x array<double>, y double, w double, k long").withColumn("features", array_to_vector("x"))
    return x, y, w, frame.persist()


def plain(x, y, w, edges, settings):
    """Trees as nested tuples, by trying every border of every feature on the rows themselves."""
    margin, trees = np.zeros(len(y)), []

    def score(rows, g, h):
        return g[rows].sum() ** 2 / (h[rows].sum() + settings.l2)

    def grow(rows, depth, g, h):
        value = -settings.rate * g[rows].sum() / (h[rows].sum() + settings.l2)
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                for edge in edges[f]:
                    left, right = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                    if min(h[left].sum(), h[right].sum()) < settings.least_hessian:
                        continue
                    gain = (score(left, g, h) + score(right, g, h) - score(rows, g, h)) / 2
                    if gain > best[0] + 1e-12:
                        best = (gain, f, edge)
        if best[1] is None:
            margin[rows] += value
            return value
        _, f, edge = best
        return (f, edge, grow(rows[x[rows, f] <= edge], depth - 1, g, h), grow(rows[x[rows, f] > edge], depth - 1, g, h))

    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(y)), settings.depth, w * (p - y), w * p * (1 - p)))
    return trees, margin


def nested(tree, edges, node=0):
    if tree.feature[node] < 0:
        return float(tree.value[node])
    f = int(tree.feature[node])
    return (f, float(edges[f][tree.cut[node]]), nested(tree, edges, 2 * node + 1), nested(tree, edges, 2 * node + 2))


def flat(tree):
    return [tree] if isinstance(tree, float) else [*tree[:2], *flat(tree[2]), *flat(tree[3])]


def grown(frame, settings, parts=1):
    frame = frame.repartitionByRange(parts, "k").sortWithinPartitions("k")
    edges = boosting.feature_edges(frame, "features", 4, settings.bins)
    sizes = np.array([len(e) + 1 for e in edges])
    return boosting.grow(boosting.blocks_of(frame, "features", "y", "w", edges), sizes, settings), edges


@pytest.mark.parametrize("settings", [SETTINGS, SETTINGS._replace(least_hessian=40.0), SETTINGS._replace(l2=50.0, depth=2)])
def test_trees_of_a_plain_loop(spark, sample, settings, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    x, y, w, frame = sample
    trees, edges = grown(frame, settings, 3)
    expected, _ = plain(x, y, w, edges, settings)
    assert len(trees) == settings.rounds
    for tree, other in zip(trees, expected):
        assert flat(nested(tree, edges)) == pytest.approx(flat(other), abs=1e-9)
    open_nodes = [t.cover[k] for t in trees for k in range(len(t.cover)) if t.cover[k]]
    assert min(open_nodes) >= settings.least_hessian


def test_executors_add_up_the_same_sums(spark, sample, monkeypatch):
    _, _, _, frame = sample
    few, edges = grown(frame, SETTINGS, 7)
    monkeypatch.setattr(boosting, "DIRECT_PARTITIONS", 2)
    many, _ = grown(frame, SETTINGS, 7)
    assert [flat(nested(a, edges)) for a in few] == [pytest.approx(flat(nested(b, edges)), abs=1e-9) for b in many]


def test_columns_are_drawn_per_tree_and_rows_are_repeatable(spark, sample):
    _, _, _, frame = sample
    settings = SETTINGS._replace(rounds=12, row_share=0.6, column_share=0.5)
    first, edges = grown(frame, settings, 2)
    again, _ = grown(frame, settings, 2)
    assert [nested(t, edges) for t in first] == [nested(t, edges) for t in again]
    used = [{int(f) for f in t.feature if f >= 0} for t in first]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1
    other, _ = grown(frame, settings._replace(seed=1), 2)
    assert [nested(t, edges) for t in first] != [nested(t, edges) for t in other]


def test_spark_model_gives_the_trees_margins(spark, sample, tmp_path):
    x, y, w, frame = sample
    model = boosting.fit(frame, "features", "y", "w", SETTINGS)
    edges = boosting.feature_edges(frame, "features", 4, SETTINGS.bins)
    _, margin = plain(x, y, w, edges, SETTINGS)
    model.write().overwrite().save(str(tmp_path / "m"))
    for loaded in (model, type(model).load(str(tmp_path / "m"))):
        rows = loaded.transform(frame).orderBy("k").select(
            vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p")
        ).collect()
        assert [2 * r["raw"][1] for r in rows] == pytest.approx(margin.tolist(), abs=1e-9)
        assert [r["p"][1] for r in rows] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)
    assert model.numFeatures == 4 and model.getNumTrees == 4


def test_one_class_and_constant_features(spark, sample):
    _, _, _, frame = sample
    flat_rows = frame.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    model = boosting.fit(flat_rows, "features", "y", "w", SETTINGS._replace(rounds=2))
    assert model.totalNumNodes == 2
    assert model.transform(flat_rows).select("probability").distinct().count() == 1


def test_a_pass_applies_no_earlier_tree(spark, sample, monkeypatch):
    _, _, _, frame = sample
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    seldom, edges = grown(frame, SETTINGS, 2)
    monkeypatch.setattr(boosting, "STORE_EVERY", 1)
    often, _ = grown(frame, SETTINGS, 2)
    assert [nested(t, edges) for t in seldom] == [nested(t, edges) for t in often]
    tree = seldom[0]
    block = next(iter(boosting.blocks_of(frame, "features", "y", "w", edges).collect()))
    moved = boosting.advanced(block, tree, SETTINGS.depth)
    assert np.array_equal(moved.margin, tree.value[boosting.nodes_of(block.bins, tree, SETTINGS.depth)])


def test_one_stage_grows_the_trees_of_single_jobs(spark, sample, monkeypatch):
    """Rounds start no job each (F1), in pieces that are smaller than blocks and with features that share a histogram."""
    _, _, _, frame = sample
    settings = SETTINGS._replace(rounds=9, row_share=0.7, column_share=0.75)
    monkeypatch.setattr(boosting, "PIECE_ROWS", (64, 64))
    monkeypatch.setattr(boosting, "_grow_by_jobs", lambda *given: pytest.fail("a job for each level"))
    together, edges = grown(frame, settings, 2)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "_gang", lambda *given: None)
    single, _ = grown(frame, settings, 2)
    assert len(together) == settings.rounds
    assert [flat(nested(a, edges)) for a in together] == [pytest.approx(flat(nested(b, edges)), abs=1e-9) for b in single]


def test_few_rows_give_the_very_same_trees(spark, sample, monkeypatch):
    _, _, _, frame = sample
    settings = SETTINGS._replace(rounds=5, row_share=0.7)
    together, edges = grown(frame, settings, 1)
    monkeypatch.setattr(boosting, "_gang", lambda *given: None)
    single, _ = grown(frame, settings, 1)
    assert [nested(a, edges) for a in together] == [nested(b, edges) for b in single]


def test_features_share_a_histogram_while_their_combinations_are_few():
    bundles = boosting.bundles_of(np.array([64, 2, 7, 64, 2, 2]), 512)
    assert [bundle.columns for bundle in bundles] == [[0, 1, 4, 5], [2, 3]]
    assert [bundle.cells for bundle in bundles] == [512, 448] and bundles[0].strides == [1, 64, 128, 256]
