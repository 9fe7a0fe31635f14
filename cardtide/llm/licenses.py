"""Operator 1, license scans: an exact set-similarity join of text blocks with notice templates.

A block is ``BLOCK`` consecutive words, and a new one starts every ``STRIDE`` words, so any notice of up to
BLOCK - STRIDE + 1 words lies in one block; a longer template makes the blocks longer. A block matches a template of T distinct words if it contains at least
ceil(THRESHOLD * T) = o of them. Tokens are ordered by how many documents hold them, rare ones first. A match must
share a token between the first T - o + 1 of the template and the first B - o + 1 of the block's tokens (prefix), needs
B >= o (length), and enough tokens after the shared places (position). Survivors are verified by intersection.

Only tokens of templates can count towards an overlap, so a block is reduced to them, and only blocks that hold a
template's prefix token are built at all. Everything is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.functions.once import computed_once
from cardtide.llm.words import PLAIN_GAP, words_of

#: Phrase and label of the base search.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices of widespread licenses, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights", "copyright all rights reserved no part may be reproduced without written permission"),
)
THRESHOLD = 0.8
BLOCK, STRIDE = 64, 32


def _literal(words) -> Column:
    return F.array(*[F.lit(word) for word in words]).cast("array<string>")


def _need(size: int) -> int:
    return -int(-size * THRESHOLD // 1)


def _places(words: Column, phrase: str) -> Column:
    """Start words of all places where the phrase's words stand."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    found = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == part for k, part in enumerate(parts)]),
    )
    return F.when(F.array_contains(words, parts[-1]) & (last >= 0), found).otherwise(F.array().cast("array<int>"))


def token_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of rows of ``words`` that hold them. As many rows as tokens are collected."""
    held = words.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("token"))
    counts = dict(held.groupBy("token").count().collect())
    return sorted(vocabulary, key=lambda token: (counts.get(token, 0), token))


def block_matches(rows: DataFrame, order: list[str], keys: list[str], templates=TEMPLATES) -> DataFrame:
    """``keys``, label and containment of every (block, template) pair that meets the threshold."""
    spark = rows.sparkSession
    rank = {token: k for k, token in enumerate(order)}
    block_words = max(BLOCK, max(len(text.split(" ")) for _, text in templates) + STRIDE - 1)
    reach = -(-block_words // STRIDE)  # blocks that a word may lie in
    index, prefixes = [], set()
    for number, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split(" ")), key=rank.__getitem__)
        need = _need(len(tokens))
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            index.append((token, number, label, place, need, tokens))
            prefixes.add(token)
    indexed = spark.createDataFrame(index, "token string, template int, label string, t_place int, need int, tokens array<string>")
    firsts = sorted(prefixes)
    hit = rows.where(F.arrays_overlap("words", _literal(firsts)))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i).isin(firsts))
    first_block = F.transform(places, lambda i: F.floor(i / STRIDE).cast("int"))
    earlier = [F.transform(first_block, lambda b, k=k: F.greatest(b - k, F.lit(0))) for k in range(1, reach)]
    blocks = F.array_distinct(F.concat(first_block, *earlier))
    blocks = hit.select(*keys, "words", F.explode(blocks).alias("block"))
    # The block's template tokens, in global order.
    own = F.array_intersect(_literal(order), F.slice("words", F.col("block") * STRIDE + 1, F.lit(block_words)))
    blocks = computed_once(blocks, {"own": own}).select(*keys, "block", "own")
    prefix = blocks.select(*keys, "block", "own", F.posexplode("own").alias("b_place", "token"))
    size, length = F.size("own"), F.size("tokens")
    after = F.least(length - F.col("t_place"), size - F.col("b_place")) + F.least("t_place", "b_place")
    # The index has a row for each prefix token of each template: its size is that of the parameter.
    pairs = prefix.join(F.broadcast(indexed), "token").where(
        (size >= F.col("need")) & (F.col("b_place") <= size - F.col("need")) & (after >= F.col("need"))
    )
    both = F.size(F.array_intersect("own", "tokens"))
    return pairs.where(both >= F.col("need")).select(*keys, "label", (both / length).alias("containment"))


def license_report(documents: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Word count, base places, labels and score of every row.

    ``score`` is 1 with a base place, else the largest containment among matches, else 0. Null text has no words;
    repeated rows get the same result each; null keys are kept; an empty table gives an empty result; other columns
    are not read.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = computed_once(rows, {"words": words_of(F.col("text"), PLAIN_GAP)})
    order = token_order(rows.select("words"), sorted({token for _, notice in templates for token in notice.split(" ")}))
    # Matches depend on the text alone, so they are found by id and text digest: repeated rows share them.
    keyed = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    matches = block_matches(keyed.select("doc_id", "digest", "words"), order, ["doc_id", "digest"], templates)
    matches = matches.groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    based = computed_once(
        keyed.select("doc_id", "digest", "words"), {f"p{k}": _places(F.col("words"), phrase) for k, (phrase, _) in enumerate(BASE)}
    )
    places = F.concat(*[f"p{k}" for k in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    based = based.select(
        "doc_id",
        "digest",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(labels).alias("base"),
    )
    joined = based.join(matches, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
