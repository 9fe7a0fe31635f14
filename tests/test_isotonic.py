"""Pooling in ranges against pooling in one pass."""

import random

import pytest

from cardtide.operators import isotonic


def minimax(points):
    """The fitted value of each point by its definition: the largest, over starts, of the smallest mean, over ends."""
    def mean(a, b):
        return sum(t for _, t, _ in points[a : b + 1]) / sum(w for *_, w in points[a : b + 1])

    return [max(min(mean(a, b) for b in range(k, len(points))) for a in range(k + 1)) for k in range(len(points))]


def cases():
    choice = random.Random(7)
    yield "falling", [(float(k), 40.0 - k, 1.0) for k in range(40)]
    yield "rising", [(float(k), float(k), 1.0) for k in range(40)]
    yield "constant", [(float(k), 1.0, 2.0) for k in range(30)]
    # One late point that pulls everything down, through every border.
    yield "dragged", [(float(k), float(k), 1.0) for k in range(39)] + [(39.0, 0.0, 1000.0)]
    for seed in range(4):
        yield f"noise {seed}", [(k / 7, float(sum(choice.random() < k / 60 for _ in range(w))), float(w)) for k in range(60) for w in [choice.randrange(1, 5)]]
    yield "one", [(0.5, 1.0, 1.0)]


@pytest.mark.parametrize("name, points", list(cases()), ids=[name for name, _ in cases()])
@pytest.mark.parametrize("ranges", [1, 5, 16])
def test_ranges_pool_across_their_borders(spark, name, points, ranges):
    frame = spark.createDataFrame(random.Random(1).sample(points, len(points)), "score double, total double, weight double")
    blocks = sorted(isotonic.pooled_blocks(frame, ranges).collect())
    means = [b["total"] / b["weight"] for b in blocks]
    assert means == sorted(set(means))
    fitted = [next(b["total"] / b["weight"] for b in blocks if b["first"] <= score <= b["last"]) for score, *_ in points]
    assert fitted == pytest.approx(minimax(points))
    assert len(spark.createDataFrame(blocks, "first double, last double, total double, weight double").transform(isotonic.block_ends).collect()) <= 2 * len(blocks)


def test_unusable_points_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, 1.0, 0.0)], "score double, total double, weight double")
    assert isotonic.pooled_blocks(frame).count() == 0
