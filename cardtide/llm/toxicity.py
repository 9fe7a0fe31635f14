"""Operator 6, toxicity: non-negative positive-unlabelled learning.

Positives are documents that the labels confirm as toxic; the other side is unlabelled text, of which an unknown part
is toxic too. With class prior p, the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)). Linear classifiers over words,
over word beginnings, and over both are trained with numpy on this risk; a score is the mean of their probabilities.

The fit uses at most ``POSITIVES`` and ``UNLABELLED`` documents, those with the smallest hash of their id. Their text
is found by a join with the list of ids, whose size these two numbers bound; everything else stays distributed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardtide.llm.shared import materialised
from cardtide.llm.words import fresh

POSITIVES = 4000
UNLABELLED = 12000
#: Features that a fit keeps: the most over-represented in positives, if at least CONTRAST deviations.
FEATURES = 4096
CONTRAST = 4.0
#: Letters of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5)
THRESHOLD = 0.7
EPOCHS = 400
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> set[str]:
    """Distinct lower-cased words, and ``beginning*`` of the longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{b}*" for b in beginnings(words)}


def beginnings(words: set[str]) -> set[str]:
    return {word[:size] for size in BEGINNINGS for word in words if len(word) > size}


class ToxicityModel(NamedTuple):
    """Weight of every feature in each classifier, and the classifiers' biases."""

    weights: dict[str, tuple[float, ...]]
    biases: tuple[float, ...]

    def score(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        weights, margins = self.weights, list(self.biases)
        found = [weights[w] for w in words if w in weights]
        found += [weights[f"{b}*"] for b in beginnings(words) if f"{b}*" in weights]
        for weight in found:
            for k, value in enumerate(weight):
                margins[k] += value
        return float(np.mean([1 / (1 + np.exp(-m)) if m > -700 else 0.0 for m in margins]))


def in_fold(key: Column, folds: int = 3, held: int = 1) -> Column:
    """True where the row is held out. A null key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held, F.lit(False))


def train_nnpu(row: np.ndarray, column: np.ndarray, positive: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk. ``row``/``column``: features present; ``positive``: which rows are positives."""
    n_pos, n_unl = positive.sum(), (~positive).sum()
    weights = np.zeros(width + 1)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    weights[-1] = np.log(prior / (1 - prior))
    for step in range(1, EPOCHS + 1):
        margin = np.bincount(row, weights[column], len(positive)) + weights[-1]
        sigmoid = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        loss_minus = np.logaddexp(0, margin)
        negative_risk = loss_minus[~positive].sum() / n_unl - prior * loss_minus[positive].sum() / n_pos
        as_positive, as_negative = -prior * (1 - sigmoid) / n_pos, np.where(positive, -prior * sigmoid / n_pos, sigmoid / n_unl)
        slope = np.where(positive, as_positive, 0) + as_negative if negative_risk >= 0 else -as_negative
        change = np.append(np.bincount(column, slope[row], width) + 1e-5 * weights[:-1], slope.sum())
        first, second = 0.9 * first + 0.1 * change, 0.999 * second + 0.001 * change**2
        weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Train from labels (doc_id, toxic) of rows that are not held out.

    A document with several labels is toxic if one says so; null ids and labels are ignored. Without a positive or
    an unlabelled document every score is that of the prior (0 without labels).
    """
    spark = documents.sparkSession
    named = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("id"), "toxic")
    truth = named.where(~in_fold(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total, toxic = truth.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(max((toxic or 0) / max(total, 1), 1e-3), 0.5)
    ids = documents.select(F.col(key).cast("long").alias("id")).where(F.col("id").isNotNull() & ~in_fold(F.col("id")))

    def smallest(rows: DataFrame, count: int, positive: bool) -> list:
        return [(r[0], positive) for r in rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(count).collect()]

    chosen = smallest(truth.where("toxic = 1").join(ids, "id", "left_semi"), POSITIVES, True) + smallest(ids, UNLABELLED, False)
    if len({positive for _, positive in chosen}) < 2:
        return ToxicityModel({}, (float(np.log(prior / (1 - prior))) if toxic else -50.0,))
    sample = F.broadcast(spark.createDataFrame(chosen, "id long, positive boolean"))
    texts = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(sample, "id")

    def split(batches):
        for batch in batches:
            found = [list(tokens(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["positive", "found"])

    held = texts.select("text", "positive").mapInArrow(split, "positive boolean, found array<string>")
    held = materialised(held.withColumn("row", F.monotonically_increasing_id()))
    n_pos, n_unl = held.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    counted = held.select("positive", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.sum(F.col("positive").cast("double")).alias("p"), F.sum((~F.col("positive")).cast("double")).alias("u")
    )
    both = (F.col("p") + F.col("u") + 1) / (n_pos + n_unl + 2)
    contrast = (F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl))
    best = counted.select("feature", contrast.alias("z")).where(F.col("z") >= CONTRAST)
    names = [r[0] for r in best.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    place = {name: k for k, name in enumerate(names)}
    vocabulary = F.broadcast(spark.createDataFrame([(k, v) for k, v in place.items()] or [("", -1)], "feature string, place int"))
    present = held.select("row", "positive", F.explode("found").alias("feature")).join(vocabulary, "feature")
    present = present.groupBy("row", "positive").agg(F.collect_list("place").alias("places"))
    rows = present.collect()
    missing = [(n_pos - sum(r["positive"] for r in rows), True), (n_unl - sum(not r["positive"] for r in rows), False)]
    places = [r["places"] for r in rows] + [[] for count, _ in missing for _ in range(int(count))]
    positive = np.array([r["positive"] for r in rows] + [kind for count, kind in missing for _ in range(int(count))], bool)
    column = np.array([p for found in places for p in found], np.int64)
    row = np.repeat(np.arange(len(places)), [len(found) for found in places])
    starred = np.array([name.endswith("*") for name in names], bool)
    weights, biases = np.zeros((len(names), 3)), []
    for k, view in enumerate((~starred, starred, np.ones(len(names), bool))):
        use = view[column] if len(column) else np.zeros(0, bool)
        weights[:, k], bias = train_nnpu(row[use], column[use], positive, len(names), prior)
        weights[~view, k] = 0
        biases.append(bias)
    return ToxicityModel({name: tuple(weights[k].tolist()) for name, k in place.items()}, tuple(biases))


def with_score(documents: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Every row and column, and the score (0 to 1) of the whole text. Null text is scored as empty."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score).astype(float)

    return documents.withColumn(name, score(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def toxicity_report(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score and verdict of each row; repeated rows get one each, an empty table gives an empty result."""
    model = fit(documents, labels, key, text)
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return with_score(rows, model).select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the rows that score at least ``THRESHOLD``."""
    (name,) = fresh(documents, "score")
    scored = with_score(documents, fit(documents, labels, key, text), text, name)
    return scored.where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in documents.columns])
