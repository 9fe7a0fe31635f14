"""The language model against a plain modified Kneser-Ney, and its packing."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardtide.llm import language_model

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*SPACED.findall((text or "").translate(LOWER)), None]


class Plain:
    def __init__(self, texts, order):
        grams = Counter()
        self.raw = Counter()
        for text in texts:
            words = tokens(text)
            self.raw.update(words)
            padded = ["<s>"] * (order - 1) + words
            grams.update(tuple(padded[k : k + order]) for k in range(len(words)))
        self.order, self.counts = order, {order: grams}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(gram[1:] for gram in self.counts[n + 1])
        self.discounts, self.follow = {}, defaultdict(Counter)
        for n, grams in self.counts.items():
            of = Counter(grams.values())
            self.discounts[n] = language_model.Discounts.of(*(of[k] for k in (1, 2, 3, 4)))
            for gram, count in grams.items():
                self.follow[gram[:-1] if n > 1 else (n,)][gram[-1]] = count

    def probability(self, context, word):
        n = len(context) + 1
        follow = self.follow[context if n > 1 else (n,)]
        total, discount = sum(follow.values()), (0.0, *self.discounts[n])
        lower = self.probability(context[1:], word) if n > 1 else 1 / (len(self.raw) + 1)
        if not total:
            return lower
        kept = follow[word] - discount[min(follow[word], 3)]
        return kept / total + sum(discount[min(c, 3)] for c in follow.values()) / total * lower

    def score(self, text):
        words = tokens(text)
        padded = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.probability(tuple(padded[k : k + self.order - 1]), w)) for k, w in enumerate(words))


def made(seed):
    choice = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["É", "🎉", "x" * 300]
    rows = [(k, " ".join(words[min(int(choice.expovariate(0.15)), 27)] for _ in range(choice.randrange(40)))) for k in range(120)]
    return rows + [(500, None), (501, ""), (502, "NEVER seen"), (None, "w1 w2 w3"), (503, "w1 " * 3000), (504, rows[3][1]), (504, rows[3][1])]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_a_plain_model(spark, monkeypatch, order):
    rows = made(order)
    learned = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    plain = Plain(learned, order)
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, level string, shard string").repartition(3)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 300)
    got = language_model.perplexity_report(frame, order=order).collect()
    assert len(got) == len(rows)
    expected = defaultdict(list)
    for i, text in rows:
        expected[i].append((plain.score(text), sum(plain.raw[w] > 0 for w in tokens(text))))
    for r in got:
        assert any(r["score"] == pytest.approx(score, rel=1e-9) and r["n_known"] == known for score, known in expected[r["doc_id"]])
    assert {r["train_tokens"] for r in got} == {sum(plain.raw.values())}
    assert language_model.perplexity_report(frame.limit(0), order=order).count() == 0


def test_small_flushes_and_more_shards_change_nothing(spark):
    rows = spark.createDataFrame(made(9), "doc_id long, text string")
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.perplexity_report(rows).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        other = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.perplexity_report(rows.repartition(9)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert whole == pytest.approx(other)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_packs_are_lossless(words):
    rng = np.random.default_rng(words)
    for size, top in ((1, 5), (1000, 4), (5000, 70_000), (300, 2**63)):
        entries = np.vstack([rng.integers(0, top, (words, size), np.uint64, endpoint=False), rng.integers(1, 400, (2, size)).astype(np.uint64)])
        entries = language_model._reduced(entries, words)
        assert (language_model._from_bytes(language_model._to_bytes(entries, words), words) == entries).all()


def test_numbers_follow_the_counts(spark):
    model = language_model.train(spark.createDataFrame([("a " * 9 + "b " * 3 + "c",), ("d a",)], "text string"))
    words = language_model.Words(model.folder, model.word_shards)
    import pyarrow as pa

    cut = next(language_model.cut(pa.array(["a b c d never"]), language_model.SPACED))
    numbers = words.numbers(cut.hashes)
    assert numbers[0] == 1 and sorted(numbers[:4].tolist()) == sorted({int(n) for n in numbers[:4]}) and numbers[:4].max() <= 5
    assert numbers[4] == language_model._UNKNOWN
