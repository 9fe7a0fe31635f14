"""Words of text columns: column expressions, and numpy cuts of Arrow batches.

Both sides follow the same two definitions, over text whose A-Z are lower-cased and whose null is empty:
``SPACED`` words are runs of characters other than space and \\t to \\r, ``PLAIN`` words are runs of digits,
letters and everything from U+0080 on. UTF-8 bytes of at least 0x80 belong to words in both, so cutting bytes
and cutting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACED_GAP = r"[\x20\x09-\x0D]+"
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are cut at once. A longer text is cut alone.
SLICE_BYTES = 2 << 20

_BYTE = np.arange(256)
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
PLAIN = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint64) + np.uint64(1)
LOWER_BYTES = (_LOWER - np.uint64(1)).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words_of(text: Column, gap: str) -> Column:
    return F.filter(F.split(lower_ascii(text), gap), lambda word: word != "")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of the frame, in any case."""
    taken = {name.lower() for name in frame.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input reaches every bit of the output."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _powers_upto(length: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < length:
        size = max(length, SLICE_BYTES) + 1
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(step), np.uint64)]))
            for step in (_BASE, _INVERSE)
        ]
    return _powers


class Words(NamedTuple):
    """Words of the rows first..last-1 of a batch. ``offsets`` has the first word of each row, and the end."""

    first: int
    last: int
    data: np.ndarray
    row_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def cut(column: pa.Array, kind: np.ndarray, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Cut a text column into words with 64-bit hashes of their lower-cased bytes, slice by slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    bounds = np.frombuffer(offset_buffer, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + slice_bytes, "right")) - 1)
        data = whole[bounds[first] : bounds[last]]
        rows = bounds[first : last + 1] - bounds[first]
        yield _cut_slice(first, last, data, rows, kind)
        first = last


def _cut_slice(first: int, last: int, data: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> Words:
    size = len(data)
    inside = kind[data]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[rows[:-1][rows[:-1] < size]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_upto(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[:size], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(first, last, data, rows, starts, ends, np.searchsorted(starts, rows), hashes)


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, across row borders."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    count = len(hashes) - length + 1
    total = np.full(count, np.uint64(length), np.uint64)
    for k in range(length):
        total *= np.uint64(_BASE)
        total += hashes[k : k + count]
    return mix(total)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row index of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
