"""Operator 5, URL filters: rules first, else a logistic regression on hashed character n-grams.

The regression is trained on a small labelled table of (host, path, label), of which at most ``TRAIN_ROWS`` rows are
used: those with the smallest hash. Its n-grams carry whether they come from the host or the path. Weights are a
fixed-size array, so the model's size does not depend on the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cardtide.llm.words import UPPER

#: Verdict, host and path prefix of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Most labelled rows that a fit uses.
TRAIN_ROWS = 4096
BITS = 16
GRAMS = (3, 4, 5)
STEPS = 300
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name = F.when(fits, F.lit(f"{domain}{prefix}")).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _grams(part: str, tag: bytes) -> Iterator[int]:
    data = b"^" + part.encode() + b"$"
    for size in GRAMS:
        for at in range(max(1, len(data) - size + 1)):
            yield zlib.crc32(data[at : at + size], zlib.crc32(tag)) & ((1 << BITS) - 1)


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path."""
    return np.unique(np.fromiter((g for part, tag in ((host, b"h"), (path, b"p")) for g in _grams(part, tag)), np.int64))


class UrlModel(NamedTuple):
    weights: np.ndarray
    bias: float

    def probability(self, host: str, path: str) -> float:
        found = features(host, path)
        return float(1 / (1 + np.exp(-(self.weights[found].sum() / np.sqrt(len(found)) + self.bias))))


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> UrlModel:
    """Train from columns host, path and label (1: block). Rows with nulls are ignored, repeated rows count once.

    Without rows of both labels the weights are zero and the bias says what was seen (allow if nothing was).
    """
    chosen = labelled.select("host", "path", F.col("label").cast("int").alias("label")).dropna().distinct()
    rows = chosen.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_rows).collect()
    label = np.array([r["label"] for r in rows], float)
    weights = np.zeros(1 << BITS)
    if len(set(label.tolist())) < 2:
        return UrlModel(weights, 4.0 if len(label) and label[0] else -4.0)
    found = [features(r["host"], r["path"]) for r in rows]
    column, row = np.concatenate(found), np.repeat(np.arange(len(rows)), [len(f) for f in found])
    value = 1 / np.sqrt(np.bincount(row))[row]
    balance = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    bias, speed = 0.0, np.full(1 << BITS, 1e-6)
    for _ in range(STEPS):
        margin = np.bincount(row, value * weights[column], len(rows)) + bias
        error = balance * (1 / (1 + np.exp(-margin)) - label) / len(rows)
        slope = np.bincount(column, value * error[row], 1 << BITS) + 1e-5 * weights
        speed += slope**2
        weights -= 0.5 * slope / np.sqrt(speed)
        bias -= error.sum()
    return UrlModel(weights, bias)


def with_probability(urls: DataFrame, model: UrlModel, name: str) -> DataFrame:
    """Add the model's probability of "block" for columns host and path."""
    held = urls.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        once = lru_cache(maxsize=1 << 14)(held.value.probability)
        for host, path in batches:
            yield pd.Series([once(h, p) for h, p in zip(host, path, strict=True)], dtype=float)

    return urls.withColumn(name, score("host", "path"))


def rule_labels(pages: DataFrame) -> DataFrame:
    """The labelled URL table: hosts and paths that a rule decides, 1 for block."""
    return pages.where("rule is not null").select("host", "path", (F.col("decision") == "block").cast("int").alias("label"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """Host, path, rule, probability and verdict of each row.

    Without ``labelled``, the URLs that a rule decides are the labelled table. Null or unparsable URLs have an
    empty host and path and get the model's verdict; repeated rows are judged each; an empty table gives an empty
    result; other columns are not read.
    """
    parts = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, decision = matching_rule(F.col("host"), F.col("path"))
    parts = parts.select("*", rule.alias("rule"), decision.alias("decision"))
    model = fit(rule_labels(parts) if labelled is None else labelled)
    scored = with_probability(parts, model, "probability")
    by_model = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decision", by_model).alias("verdict"), "probability")
