"""Operator 12, periodic run detection: descending-LCP Kruskal over the suffixes of each text's words.

The suffixes of a text are sorted by prefix doubling, and neighbours in that order have their longest common prefix
(LCP) read off the doubling's ranks. Edges between neighbours are then taken by decreasing LCP: union-find joins the
classes of suffixes that share at least that much, and each class keeps its start positions in order. When a union
makes positions i < j neighbours, their LCP is the edge's, and if their distance is within it, i and j seed a run of
period j - i. The seed that no word extends to the left starts the run, which ends where the LCP does. For a run of
smallest period q, no start between i and i + q can share that LCP (its period would divide q), so each run is seeded
exactly once, and no other period is.

Only edges whose LCP can still give a run of the asked length and exponent are taken. A text is worked on in one task,
several short ones together; memory is its words times the doubling steps (the logarithm of its longest repeat).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardtide.functions.once import computed_once
from cardtide.llm.words import SLICE_BYTES, SPACED_GAP, fresh

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: A set that is this many times larger takes the elements of the other one by one.
_MERGE = 32


def _regrouped(rank: np.ndarray, active: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after a doubling step, and the positions that still share theirs. A rank is the number of smaller suffixes."""
    order = np.lexsort((following, rank[active]))
    at, old, then = active[order], rank[active][order], following[order]
    step = np.arange(len(at))
    opens = np.ones(len(at), bool)
    opens[1:] = old[1:] != old[:-1]
    splits = opens.copy()
    splits[1:] |= then[1:] != then[:-1]
    group = np.maximum.accumulate(np.where(opens, step, 0))
    part = np.maximum.accumulate(np.where(splits, step, 0))
    ranked = rank.copy()
    ranked[at] = old + (part - group).astype(rank.dtype)
    alone = splits & np.append(splits[1:], True)
    return ranked, at[~alone]


def suffix_neighbours(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes of the same text with an LCP of at least ``least``, and that LCP."""
    none = np.zeros(0, np.int64)
    size = len(codes)
    if not size:
        return none, none, none
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    symbols = text.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    opens = np.ones(size, bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(size, np.int64 if size >= 1 << 31 else np.int32)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(size), 0))
    active = order[~(opens & np.append(opens[1:], True))]
    ranks, reach = [rank], 1
    while len(active):
        beyond = active + reach
        following = np.where(beyond < ends[active], rank[np.minimum(beyond, size - 1)], -1)
        rank, active = _regrouped(rank, active, following)
        ranks.append(rank)
        reach *= 2
    sequence = np.empty(size, np.int64)
    sequence[rank] = np.arange(size)
    first, second = sequence[:-1], sequence[1:]
    # Ranks of 2^k words agree exactly where 2^k words do.
    known = least.bit_length() - 1
    if known >= len(ranks):
        return none, none, none
    alike = ranks[known][first] == ranks[known][second]
    first, second = first[alike], second[alike]
    shared = np.zeros(len(first), np.int64)
    for level in reversed(range(len(ranks))):
        a, b = first + shared, second + shared
        inside = (a < ends[first]) & (b < ends[second])
        same = ranks[level][np.minimum(a, size - 1)] == ranks[level][np.minimum(b, size - 1)]
        shared += np.where(inside & same, 1 << level, 0)
    enough = shared >= least
    return first[enough], second[enough], shared[enough]


class _Classes:
    """Union-find over positions whose classes keep their positions in order."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}

    def _root(self, position: int) -> int:
        above = self.above
        if position not in above:
            above[position] = position
            self.members[position] = [position]
        root = position
        while above[root] != root:
            root = above[root]
        while above[position] != root:
            above[position], position = root, above[position]
        return root

    def unite(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Pairs of the united class that are neighbours now and were in different classes."""
        small, large = self._root(a), self._root(b)
        if small == large:
            return
        if len(self.members[small]) > len(self.members[large]):
            small, large = large, small
        few, many = self.members.pop(small), self.members[large]
        places = [bisect_left(many, x) for x in few]
        last = len(few) - 1
        for k, (x, place) in enumerate(zip(few, places, strict=True)):
            if place and (k == 0 or places[k - 1] < place):
                yield many[place - 1], x
            if place < len(many) and (k == last or places[k + 1] > place):
                yield x, many[place]
        self.above[small] = large
        if len(few) * _MERGE < len(many):
            for x in few:
                insort(many, x)
        else:
            many += few
            many.sort()


class Limits(NamedTuple):
    length: int = MIN_LENGTH
    exponent: Fraction = Fraction(MIN_EXPONENT)

    @property
    def least(self) -> int:
        """The smallest LCP with which any period makes a run that is long enough."""
        return max(1, min(max(self.length - q, -int(-(self.exponent - 1) * q // 1)) for q in range(1, self.length + 1)))


def runs_of(codes: np.ndarray, offsets: np.ndarray, limits: Limits = Limits()) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period. ``codes`` are words of all texts."""
    first, second, shared = suffix_neighbours(codes, offsets, limits.least)
    order = np.argsort(-shared, kind="stable")
    starts = set(offsets[:-1].tolist())
    words, classes, found = codes, _Classes(), []
    up, down = (limits.exponent - 1).as_integer_ratio()
    for a, b, lcp in zip(first[order].tolist(), second[order].tolist(), shared[order].tolist(), strict=True):
        for i, j in classes.unite(a, b):
            period = j - i
            if up * period <= down * lcp and period + lcp >= limits.length and (i in starts or words[i - 1] != words[j - 1]):
                found.append((i, period + lcp, period))
    runs = np.array(sorted(found, key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)
    text = np.searchsorted(offsets, runs[:, 0], "right") - 1
    return np.column_stack([text, runs[:, 0] - offsets[text], runs[:, 1:]])


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and where each row's begin."""
    pieces = pc.split_pattern_regex(pc.fill_null(column, ""), SPACED_GAP)
    values, bounds = pieces.values, pieces.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(values), 0)
    counted = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return values.filter(filled), counted[bounds].astype(np.int64)


def _sliced(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text; a longer text is one of its own."""
    if not len(column):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
        yield first, last
        first = last


def _searched(column: pa.Array, limits: Limits) -> list[pa.Array]:
    """Word counts, runs and collapsed texts of some rows."""
    values, offsets = _words(column)
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = runs_of(codes, offsets, limits)
    kept = np.ones(len(values), bool)
    for text, start, length, period in runs.tolist():
        kept[offsets[text] + start + period : offsets[text] + start + length] = False
    left = np.concatenate([[0], np.cumsum(kept)])[offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), values.filter(pa.array(kept))), " ")
    flat = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
    per_row = np.searchsorted(runs[:, 0], np.arange(len(column) + 1))
    listed = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), flat)
    return [pa.array(np.diff(offsets)), listed, collapsed]


def with_runs(
    documents: DataFrame,
    text: str = "text",
    names: tuple[str, str, str] = ("n_words", "runs", "collapsed"),
    min_length: int = MIN_LENGTH,
    min_exponent: Fraction | int = MIN_EXPONENT,
) -> DataFrame:
    """Add the word count, the runs and the collapsed text of every row.

    A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` (2 or more)
    periods long, that no neighbouring word extends. Runs are listed by start, then period. The collapsed text has the
    words that no run holds after its first q, joined by single spaces. Words are runs of characters other than space
    and \\t to \\r, in their own case. A null or empty text has no words, no runs and an empty collapsed text. Other columns
    and repeated rows stay; a column of one of the new ``names``, in any case, is replaced. An empty table stays empty.
    """
    limits = Limits(min_length, Fraction(min_exponent))
    if limits.exponent < 2:
        raise ValueError("a run has at least two periods")
    taken = {name.lower() for name in names}
    kept = [name for name in documents.columns if name.lower() not in taken]
    source = documents.select(F.col(f"`{text}`").cast("string").alias(fresh(documents, "input")[0]), *[F.col(f"`{name}`") for name in kept])
    new = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DataType.fromDDL(RUNS)), T.StructField(names[2], T.StringType())]
    schema = T.StructType([*[source.schema.fields[k + 1] for k in range(len(kept))], *new])

    def search(batches):
        for batch in batches:
            for first, last in _sliced(batch.column(0)):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *_searched(part.column(0), limits)], [*kept, *names])

    return source.mapInArrow(search, schema)


def made_periodic(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; where 10 divides h, the CRC-32 of the decimal id, the words repeat from one place on.

    With g = h div 10 and n words, that place is a = g mod n, and the period 1 + (n - a) div (3 + g mod 8). Rows
    without an id or without words stay as they are.
    """
    rows = documents.select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACED_GAP), lambda word: word != "")
    rows = computed_once(rows, {"words": F.when(F.col("h") % 10 == 0, words)})
    rows = computed_once(rows, {"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    rows = computed_once(rows, {"a": F.expr("if(n > 0, g % n, 0)")})
    rows = computed_once(rows, {"p": F.expr("1 + (n - a) div (3 + g % 8)")})
    place = F.transform(
        F.expr("sequence(0L, n - 1)"), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


def run_report(documents: DataFrame) -> DataFrame:
    """Runs of every row of ``documents``, after ``made_periodic``: their number, the one of greatest exponent, digests.

    Exponents compare as doubles, which is exact below 2^26 words. Ties go to the smallest start, then period. A null or
    empty text has no run and the digests of empty texts. Repeated rows and rows without an id have a row each; an empty
    table gives an empty result; other columns are not read.
    """
    found = with_runs(made_periodic(documents))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length")))
    )
    found = computed_once(found, {"best": best})
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    )

    def of(name: str) -> Column:
        return F.col(f"best.{name}")

    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-of("s")).alias("start"),
        of("length").alias("length"),
        (-of("p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
