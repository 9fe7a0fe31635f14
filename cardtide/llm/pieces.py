"""Operator 9, SentencePiece encoding and decoding: sampled segmentations of the piece lattice.

The lattice of a text has an edge for every piece that stands at a place, and an edge of byte pieces for a character
that is no piece. Forward filtering sums the weights of all paths to each place, backward sampling draws edges from
the end. The random number of a draw is a hash of (seed, row key, chunk, step), so a row's segmentation does not
depend on partitions, batches or retries. Pieces never reach over a line break or from a word into the next one's
space, so the lattice falls into chunks (spaces with the word behind them); different chunks of a slice are filtered
once, all places in lock step. Joining the pieces' bytes gives the text back exactly: nothing is normalised, and a
literal U+2581 is coded as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from cardtide.llm.words import fresh, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Multiplies the pieces' log weights; smaller values give more varied segmentations.
ALPHA = 1.0
#: Log weight of one byte piece.
BYTE_WEIGHT = -14.0
SLICE_CHARS = 1 << 20
SPACE = "▁"
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_U = np.uint64
#: Leading bits of a hash that choose its bucket.
_BITS = 20
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class PieceTable(NamedTuple):
    """Sorted hashes of pieces and of their beginnings, with ids (-1: a beginning only) and log weights."""

    hashes: np.ndarray
    buckets: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    first_byte: int
    surface: list[bytes]

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are in the table, and their places there."""
        bucket = (values >> _U(64 - _BITS)).astype(np.int64)
        place, end = self.buckets[bucket], self.buckets[bucket + 1]
        open_ = np.flatnonzero(place < end)
        kept = [np.zeros(0, np.int64)]
        while len(open_):
            same = self.hashes[place[open_]] == values[open_]
            kept.append(open_[same])
            open_ = open_[~same]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        found = np.sort(np.concatenate(kept))
        return found, place[found]


def _hash(characters: np.ndarray) -> int:
    total = 0
    for k, c in enumerate(characters.tolist()):
        total = (total + (c + 1) * pow(_STEP, k, 1 << 64)) % (1 << 64)
    return total


def piece_table(model_file: str = MODEL) -> PieceTable:
    """Read the vocabulary. A merge model's score is a rank, of which the weight is minus the logarithm.

    Control and unknown pieces stand for no text. Pieces that cannot lie within one chunk are refused.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    known: dict[str, tuple[int, float]] = {}
    surface, byte_ids = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids.append(i)
            surface.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            if "\n" in piece or " " in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} reaches over a chunk")
            surface.append(piece.replace(SPACE, " ").encode())
            score = model.get_score(i)
            known[piece] = (i, -float(np.log(20.0 + min(max(-score, 0.0), 1e5))))
    if len(byte_ids) != 256 or byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("a model with 256 consecutive byte pieces is needed")
    entries = {p[:k]: (-1, 0.0) for p in known for k in range(1, len(p))} | known
    hashes = mix(np.array([_hash(np.array([ord(c) for c in p])) for p in entries], _U))
    order = np.argsort(hashes)
    ids = np.array([i for i, _ in entries.values()], np.int64)[order]
    weights = np.array([w for _, w in entries.values()])[order]
    hashes = hashes[order]
    buckets = np.searchsorted(hashes >> _U(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=_U)).astype(np.int32)
    return PieceTable(hashes, buckets, ids, weights, max(map(len, known)), byte_ids[0], surface)


class Lattice:
    """All edges of the lattices of different chunks, with forward sums."""

    def __init__(self, chunks: list[str], table: PieceTable, alpha: float):
        lengths = np.array([len(c) for c in chunks], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        text = np.where(raw == 0x20, 0x2581, np.where(raw == 0x2581, 0x110000, raw)).astype(np.uint64)
        size = len(text)
        power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, _U(_STEP), _U)]))
        back = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, _U(_BACK), _U)]))
        sums = np.concatenate([[_U(0)], np.cumsum((text + _U(1)) * power[:size], dtype=_U)])
        limit = np.repeat(self.starts[1:], lengths)
        begin, end, ids, weights = [], [], [], []
        at = np.arange(size)
        single = np.zeros(size, bool)
        for length in range(1, table.longest + 1):
            at = at[at + length <= limit[at]]
            value = mix((sums[at + length] - sums[at]) * back[at])
            known, place = table.find(value)
            at = at[known]
            piece = table.ids[place] >= 0
            begin.append(at[piece])
            end.append(at[piece] + length)
            ids.append(table.ids[place[piece]])
            weights.append(alpha * table.weights[place[piece]])
            if length == 1:
                single[at[piece]] = True
        other = np.flatnonzero(~single)
        begin.append(other)
        end.append(other + 1)
        ids.append(-1 - raw[other].astype(np.int64))
        weights.append(alpha * BYTE_WEIGHT * _byte_count(raw[other]))
        # Long edges first: they are the likely ones.
        begin, end, ids, weights = (np.concatenate(x[::-1]) for x in (begin, end, ids, weights))
        chunk_start = np.repeat(self.starts[:-1], lengths)
        order = np.argsort((end - chunk_start[end - 1]) * (size + 1) + end, kind="stable")
        begin, end, ids, weights = begin[order], end[order], ids[order], weights[order]
        # Places are numbered by their last character; the place before a chunk's first character has weight 1.
        forward = np.zeros(size)
        step = end - chunk_start[end - 1]
        first_edge = np.flatnonzero(np.diff(end, prepend=-1))
        group_step = step[first_edge]
        from_start = begin == chunk_start[end - 1]
        share = np.empty(len(begin))
        bounds = np.searchsorted(group_step, np.arange(1, int(lengths.max(initial=0)) + 2))
        edges = np.append(first_edge, len(begin))
        for k in range(len(bounds) - 1):
            low, high = bounds[k], bounds[k + 1]
            if low == high:
                continue
            here = slice(edges[low], edges[high])
            value = weights[here] + np.where(from_start[here], 0.0, forward[begin[here] - 1])
            local = edges[low:high] - edges[low]
            top = np.maximum.reduceat(value, local)
            counts = np.diff(np.append(local, len(value)))
            value = np.exp(value - np.repeat(top, counts))
            total = np.add.reduceat(value, local)
            share[here] = value / np.repeat(total, counts)
            forward[end[edges[low:high]] - 1] = top + np.log(total)
        self.begin, self.ids = begin, ids
        self.low = np.zeros(size + 1, np.int64)
        self.high = np.zeros(size + 1, np.int64)
        self.low[end[first_edge]], self.high[end[first_edge]] = edges[:-1], edges[1:] - 1
        self.upto = np.concatenate([[0.0], np.cumsum(share)])

    def sample(self, chunk: np.ndarray, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (below 0: a character in bytes) and rows, in text order, for chunk occurrences in text order."""
        stop, now = self.starts[chunk], self.starts[chunk + 1].copy()
        active = np.arange(len(chunk))
        found, owner, steps, step = [], [], [], 0
        while len(active):
            draw = mix(keys[active] + _U((step * _STEP) % (1 << 64)))
            draw = (draw >> _U(11)).astype(np.float64) * 2.0**-53
            low, high = self.low[now[active]], self.high[now[active]]
            goal = self.upto[low] + draw * (self.upto[high + 1] - self.upto[low])
            edge, later = low, np.flatnonzero(low < high)
            while len(later):
                later = later[self.upto[edge[later] + 1] <= goal[later]]
                edge[later] += 1
                later = later[edge[later] < high[later]]
            found.append(self.ids[edge])
            owner.append(active)
            steps.append(np.full(len(active), step))
            now[active] = self.begin[edge]
            active = active[now[active] > stop[active]]
            step += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, owner, steps = map(np.concatenate, (found, owner, steps))
        order = np.lexsort((-steps, owner))
        return found[order], row[owner[order]]


def _byte_count(characters: np.ndarray) -> np.ndarray:
    return 1 + (characters >= 0x80) + (characters >= 0x800) + (characters >= 0x10000).astype(np.int64)


def _expanded(ids: np.ndarray, row: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters by their byte pieces."""
    other = np.flatnonzero(ids < 0)
    if not len(other):
        return ids, row
    counts = np.ones(len(ids), np.int64)
    characters = -1 - ids[other]
    counts[other] = _byte_count(characters)
    raw = "".join(map(chr, characters.tolist())).encode()
    out = np.repeat(ids, counts)
    out[out < 0] = np.frombuffer(raw, np.uint8).astype(np.int64) + first_byte
    return out, np.repeat(row, counts)


def encode(texts: list[str], keys: np.ndarray, table: PieceTable, seed: int = 0, alpha: float = ALPHA) -> Iterator[np.ndarray]:
    """Sampled piece ids of each text, slice by slice. Equal (seed, key, text) give equal ids."""
    seeded = mix(keys.astype(np.int64).view(_U) + mix(np.array([seed], np.int64).view(_U) + _U(11)))
    first = 0
    while first < len(texts):
        last, size = first, 0
        places: dict[str, int] = {}
        chunk, counts = [], []
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_CHARS):
            own = _CHUNK.findall(texts[last])
            chunk.extend([places.setdefault(c, len(places)) for c in own])
            counts.append(len(own))
            size += len(texts[last])
            last += 1
        row = np.repeat(np.arange(last - first), counts)
        if len(row):
            order = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            key = mix(seeded[first:last][row] + order.astype(_U) * _U(0xD1B54A32D192ED03))
            ids, owner = Lattice(list(places), table, alpha).sample(np.array(chunk), row, key)
            ids, owner = _expanded(ids, owner, table.first_byte)
        else:
            ids, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        border = np.searchsorted(owner, np.arange(last - first + 1))
        for k in range(last - first):
            yield ids[border[k] : border[k + 1]].astype(np.int32)
        first = last


def decode(ids: np.ndarray, table: PieceTable) -> str:
    surface = table.surface
    return b"".join([surface[i] for i in ids.tolist()]).decode()


def with_pieces(
    documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "pieces", check: str | None = None,
    model_file: str = MODEL, seed: int = 0, alpha: float = ALPHA,
) -> DataFrame:
    """Every row and column, and the sampled ids of its text; with ``check``, whether they decode to the text.

    Null and empty text have no pieces. Rows with the same key and text have the same ids; a null key has a seed of
    its own. An empty table gives an empty result. ``name`` and ``check`` must not clash with columns.
    """
    held = documents.sparkSession.sparkContext.broadcast(piece_table(model_file))
    (seeded,) = fresh(documents, "row_key")
    keyed = documents.withColumn(seeded, F.coalesce(F.xxhash64(key), F.lit(0)))
    at = documents.columns.index(text)
    more = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])

    def encoded(batches):
        table = held.value
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "").to_pylist()
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            ids, same = [], []
            for text_value, found in zip(texts, encode(texts, keys, table, seed, alpha), strict=True):
                ids.append(found)
                if check:
                    same.append(decode(found, table) == text_value)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), values)]
            columns += [pa.array(same, pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *(f.name for f in more)])

    return keyed.mapInArrow(encoded, T.StructType(documents.schema.fields + more))


def with_text(encoded: DataFrame, pieces: str = "pieces", name: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """Every row and column, and the text of its ids. Null ids give null text."""
    held = encoded.sparkSession.sparkContext.broadcast(piece_table(model_file))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        table = held.value
        return ids.map(lambda found: None if found is None else decode(found, table))

    return encoded.withColumn(name, text(F.col(pieces)))


def piece_report(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Counts and digest of the ids of each row, and whether they decode to its text."""
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = with_pieces(rows, "doc_id", "text", "pieces", "lossless", **settings)
    return found.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.size(F.array_distinct("pieces")).cast("long").alias("n_distinct"),
        F.xxhash64("pieces").alias("pieces_hash"),
        "lossless",
    )
