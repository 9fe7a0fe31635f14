"""Operator 10, benchmark decontamination: find benchmark passages in training texts and take them out.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words is one window, an item
without words is none. The windows' hashes are broadcast as one sorted array. Each task cuts its texts into
words, looks up the hash of every run of words, compares the words of each hit with the item's own, and keeps
the runs as spans. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardtide.llm.words import LOWER_BYTES, PLAIN, Words, cut, fresh, sequence_hashes

WIDTH = 13
#: Bytes of benchmark windows in one broadcast. A larger benchmark is scanned in several passes.
BROADCAST_BYTES = 64 << 20
HIT_TYPE = "array<struct<start:int,end:int,item:bigint>>"
_ARROW_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.int64())]))
_BITS = 20


def _joined(words: Words, start: int, length: int) -> bytes:
    spans = zip(words.starts[start : start + length], words.ends[start : start + length], strict=True)
    return b" ".join(LOWER_BYTES[words.data[a:b]].tobytes() for a, b in spans)


def benchmark_windows(benchmark: DataFrame, item_column: str, text_column: str, width: int) -> DataFrame:
    """One row per different window of an item: length, hash, phrase (its words, joined by a space), item."""

    def windows(batches):
        for batch in batches:
            found = set()
            items = batch.column(0).to_pylist()
            for words in cut(batch.column(1), PLAIN):
                for row in range(words.last - words.first):
                    first, end = words.offsets[row], words.offsets[row + 1]
                    length = min(width, end - first)
                    if not length or items[words.first + row] is None:
                        continue
                    hashes = sequence_hashes(words.hashes[first:end], length)
                    for at, value in enumerate(hashes.view(np.int64)):
                        phrase = _joined(words, first + at, length)
                        found.add((int(length), int(value), phrase, items[words.first + row]))
            names = ["length", "hash", "phrase", "item"]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    texts = benchmark.select(F.col(item_column).cast("long"), F.col(text_column))
    return texts.mapInArrow(windows, "length int, hash long, phrase binary, item long").distinct()


class WindowIndex:
    """Sorted hashes for each window length, with the phrases and items behind each hash."""

    def __init__(self, rows: list):
        self.phrases: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        for length, value, phrase, item in rows:
            self.phrases.setdefault((length, value), {}).setdefault(bytes(phrase), []).append(item)
        self.lengths = {}
        for length in sorted({key[0] for key in self.phrases}):
            hashes = np.sort(np.array([v for n, v in self.phrases if n == length], np.int64).view(np.uint64))
            quick = np.zeros(1 << _BITS, bool)
            quick[hashes >> np.uint64(64 - _BITS)] = True
            self.lengths[length] = (hashes, quick)

    def spans(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """Row, first word, end word and item of every verified window, in text order for each length."""
        rows = len(words.offsets) - 1
        for length, (hashes, quick) in self.lengths.items():
            values = sequence_hashes(words.hashes, length)
            maybe = np.flatnonzero(quick[values >> np.uint64(64 - _BITS)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(hashes, values[maybe]), len(hashes) - 1)
            maybe = maybe[hashes[place] == values[maybe]]
            row = np.searchsorted(words.offsets, maybe, "right") - 1
            inside = (row < rows) & (maybe + length <= words.offsets[np.minimum(row + 1, rows)])
            for at, r in zip(maybe[inside].tolist(), row[inside].tolist(), strict=True):
                key = (length, int(values[at : at + 1].view(np.int64)[0]))
                start = at - int(words.offsets[r])
                for item in self.phrases[key].get(_joined(words, at, length), ()):
                    yield r, start, start + length, item


def _merged(spans: list[tuple[int, int, int]]) -> list[dict]:
    """Join overlapping and adjacent spans of the same item."""
    merged: list[list[int]] = []
    for item, start, end in sorted(spans):
        if merged and merged[-1][2] == item and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, item])
    return [{"start": s, "end": e, "item": i} for s, e, i in merged]


def _cleaned(words: Words, row: int, hits: list[dict]) -> str:
    """The row's text without the bytes from the first to the last word of each hit."""
    first, low = int(words.offsets[row]), int(words.row_bytes[row])
    kept, at = [], low
    for hit in sorted(hits, key=lambda h: (h["start"], h["end"])):
        start, end = int(words.starts[first + hit["start"]]), int(words.ends[first + hit["end"] - 1])
        if start > at:
            kept.append(words.data[at:start].tobytes())
        at = max(at, end)
    kept.append(words.data[at : int(words.row_bytes[row + 1])].tobytes())
    return b"".join(kept).decode()


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    broadcast_bytes: int = BROADCAST_BYTES,
    names: tuple[str, str, str] = ("n_words", "hits", "without_hits"),
) -> DataFrame:
    """Every row and column of ``documents``, with three more.

    ``n_words``; ``hits``: the spans (first word, end word, item) where items stand, merged per item; and
    ``without_hits``: the text without those spans. Null text has no words and stays null. Repeated rows are
    judged each for itself; items with null id are ignored, repeated items count once. Empty tables give empty
    results, an empty benchmark gives no hits. ``names`` must not clash with columns of ``documents``.
    """
    spark = documents.sparkSession
    windows = benchmark_windows(benchmark, item_column, item_text, width)
    size = windows.agg(F.sum(F.length("phrase") + 120)).first()[0] or 0
    slices = -(-size // broadcast_bytes) or 1
    texts = documents
    where = documents.columns.index(text_column)
    more = T.StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` {HIT_TYPE}, `{names[2]}` string")
    schema = T.StructType(documents.schema.fields + more.fields)
    for k in range(slices):
        part = windows.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == k) if slices > 1 else windows
        held = spark.sparkContext.broadcast(WindowIndex([tuple(row) for row in part.collect()]))

        def scan(batches, held=held, first=k == 0):
            for batch in batches:
                columns = list(batch.columns)
                known = [[] for _ in range(batch.num_rows)]
                if not first:
                    known, columns = columns[-2].to_pylist(), columns[:-3]
                counts = np.zeros(batch.num_rows, np.int64)
                cleaned = {}
                for words in cut(batch.column(where), PLAIN):
                    counts[words.first : words.last] = words.counts
                    found: dict[int, list] = {}
                    for row, start, end, item in held.value.spans(words):
                        found.setdefault(row, []).append((item, start, end))
                    for row in range(words.last - words.first):
                        at = words.first + row
                        if row in found:
                            old = [(h["item"], h["start"], h["end"]) for h in known[at]]
                            known[at] = _merged(old + found[row])
                        if known[at]:
                            cleaned[at] = _cleaned(words, row, known[at])
                text = batch.column(where)
                if cleaned:
                    values = text.to_pylist()
                    for at, value in cleaned.items():
                        values[at] = value
                    text = pa.array(values, text.type)
                columns += [pa.array(counts), pa.array(known, _ARROW_HITS), text]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: len(columns) - 3], *names])

        texts = texts.mapInArrow(scan, schema)
    return texts


def hit_words(hits: Column) -> Column:
    """How many words the spans cover together."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))))
    empty = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        empty,
        lambda state, span: F.struct(
            (state["covered"] + F.greatest(F.lit(0), span["e"] - F.greatest(span["s"], state["upto"]))).alias("covered"),
            F.greatest(state["upto"], span["e"]).alias("upto"),
        ),
        lambda state: state["covered"].cast("long"),
    )


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", mode: str = "documents") -> DataFrame:
    """``documents`` without its contaminated rows, or with the spans taken out of its texts (``mode="spans"``)."""
    names = tuple(fresh(documents, "n_words", "hits", "without_hits"))
    found = find_hits(documents, benchmark, text_column, names=names)
    if mode == "spans":
        return found.select(*[F.col(names[2]).alias(c) if c == text_column else F.col(f"`{c}`") for c in documents.columns])
    return found.where(~is_contaminated(F.col(names[0]), hit_words(F.col(names[1])))).select(
        *[F.col(f"`{c}`") for c in documents.columns]
    )


def contamination_report(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, items and verdict of each row."""
    found = find_hits(documents.select(F.col(key).alias("doc_id"), F.col(text_column).alias("text")), benchmark)
    items = F.array_sort(F.transform(F.array_distinct(F.transform("hits", lambda h: h["item"])), lambda i: i.cast("string")))
    report = found.select("doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), items.alias("items"))
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
