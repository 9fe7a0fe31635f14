"""Operator 4, LM scoring: an interpolated modified Kneser-Ney n-gram model.

Words are numbered first: tasks count word hashes, one shard of the hashes at a time numbers its words, frequent words
before rare ones. An n-gram is then a row of small numbers. Counting tasks pack their distinct n-grams, sorted, as
differences to the one before, into one compressed array per shard of the context; a shard's task merges the packed
arrays, writes its table into the shared folder, and sends the distinct n-grams without their first word on to the shards
of the next lower order, whose counts are continuation counts. No n-gram is ever one row, and a frequent n-gram arrives
once per task. There are as many shards as the number of tokens asks for. Scoring: workers memory-map the sorted hash
arrays and look up the distinct n-grams of a slice of texts, shard by shard. The driver sees totals only.

Files: for each shard of the words, their sorted hashes, occurrences and numbers; for each order n and shard, sorted hashes
of contexts with which total they have and how many words follow once, twice and more often, and (place of the context,
word) with counts. What is shuffled is freed as soon as a step has written its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardtide.llm.shared import delete_folder, free_shuffles, map_array, shared_folder, write_array
from cardtide.llm.words import SPACED, cut, mix

ORDER = 3
#: N-grams that a counting task holds before it packs them.
FLUSH = 1 << 20
#: N-grams, or words, that a shard has to hold at most on average. Tokens are counted for it, of which n-grams are fewer.
SHARD_TOKENS = 1 << 21
SHARD_WORDS = 1 << 20
_U = np.uint64
#: Word numbers: text starts are padded with 0, and words that training never saw have no number.
_START, _UNKNOWN = _U(0), _U(1 << 63)
#: Hash of the end token, and the empty context.
_END, _NONE = _U(0x454E), _U(1)
_STEP = _U(0xA24BAED4963EE407)
#: A key is the place of the context among its shard's, and the word's number in these bits.
_WORD_BITS = _U(36)
_NO_WORD = _U((1 << 36) - 1)
_PACK = "level int, shard int, entries binary, n1 long, n2 long, n3 long, n4 long, total long, raw long, kinds long"
_FIELDS = [part.split(" ")[0] for part in _PACK.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.binary()] + [pa.int64()] * 7
#: Words are grouped by the logarithm of their count; numbers are given group by group.
_GROUPS = 64


class Discounts(NamedTuple):
    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> "Discounts":
        """From how many n-grams occur one to four times; half a count for each where one of them is missing."""
        if not (n1 and n2 and n3 and n4):
            return cls(0.5, 1.0, 1.5)
        share = n1 / (n1 + 2 * n2)
        found = (1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3)
        return cls(*(float(np.clip(d, 0.05 * k, 0.95 * k)) for k, d in enumerate(found, 1)))

    def taken(self, counts: np.ndarray) -> np.ndarray:
        return np.choose(np.minimum(counts, 3).astype(np.int64), (0.0, self.one, self.two, self.more))


class NgramModel(NamedTuple):
    """Where the arrays are, and the totals."""

    folder: str
    order: int
    shards: int
    word_shards: int
    discounts: tuple[Discounts, ...]
    continuations: int
    backoff: float
    tokens: int
    vocabulary: int


def held_out(key: Column, folds: int = 5, held: int = 1) -> Column:
    """True where the text is not learned from. A null key is learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held, F.lit(False))


def _token_rows(words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token per row, and the offsets of the rows."""
    rows = len(words.offsets) - 1
    tokens = np.insert(words.hashes, words.offsets[1:], _END)
    return tokens, words.offsets + np.arange(rows + 1)


def _contexts(tokens: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the preceding order - 1, order - 2, ... 1 tokens of each token; starts are padded."""
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    found, total = [], np.full(len(tokens), _NONE, _U)
    for back in range(1, order):
        before = np.full(len(tokens), _START, _U)
        before[back:] = tokens[:-back] if back else tokens
        before[place < back] = _START
        total = mix(total * _STEP + before)
        found.insert(0, total)
    return found


def _shard(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values >> _U(40)).astype(np.int64) * shards) >> 24


def _context_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a context from its words, first to last, as ``_contexts`` has it."""
    total = np.full(len(columns[0]), _NONE, _U)
    for column in reversed(columns):
        total = mix(total * _STEP + column)
    return total


def _smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _write_counts(name: str, counts: np.ndarray) -> None:
    """Counts as bytes; the few that need more room stand apart, with their places."""
    large = np.flatnonzero(counts >= 255)
    write_array(f"{name}-counts.npy", np.minimum(counts, _U(255)).astype(np.uint8))
    write_array(f"{name}-places.npy", large)
    write_array(f"{name}-large.npy", counts[large])


def _write_kinds(name: str, columns: list[np.ndarray]) -> None:
    """Which of the different rows each context has, and these rows: few, as most contexts are rare."""
    order = _order(np.stack(columns))
    opens = _opens([column[order] for column in columns])
    which = np.empty(len(order), _U)
    which[order] = (np.cumsum(opens) - 1).astype(_U)
    write_array(f"{name}-kinds.npy", _smallest(which))
    write_array(f"{name}-following.npy", np.stack([column[order][opens] for column in columns], axis=1))


def _opens(columns: list[np.ndarray]) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    opens = np.zeros(len(columns[0]), bool)
    opens[:1] = True
    for column in columns:
        opens[1:] |= column[1:] != column[:-1]
    return opens


def _order(columns: np.ndarray) -> np.ndarray:
    """The order of rows by all columns. Columns whose bits fit into one number are sorted as one."""
    keys: list[np.ndarray] = []
    room = 0
    for column in columns:
        bits = max(1, int(column.max(initial=0)).bit_length())
        if keys and bits <= room:
            keys[-1] = (keys[-1] << _U(bits)) | column
        else:
            keys.append(column)
            room = 64
        room -= bits
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _reduced(entries: np.ndarray, words: int) -> np.ndarray:
    """Sort the n-grams and sum the counts of equal ones. Rows: the words in order, continuations, occurrences."""
    entries = entries[:, _order(entries[:words])]
    first = np.flatnonzero(_opens(list(entries[:words])))
    out = entries[:, first]
    if len(first):
        for k in (-2, -1):
            out[k] = np.add.reduceat(entries[k], first)
    return out


def _to_bytes(entries: np.ndarray, words: int) -> bytes:
    """Sorted n-grams, each word as the difference to the row before while the words to its left stay, byte by byte of
    the narrowest type, compressed."""
    parts, size = [], entries.shape[1]
    opens = np.zeros(size, bool)
    opens[:1] = True
    for k, row in enumerate(entries):
        values = row
        if k < words:
            values = row - np.where(opens, _U(0), np.concatenate([row[:1], row[:-1]]))
            opens = opens | (np.concatenate([[True], row[1:] != row[:-1]]))
        narrow = _smallest(values)
        parts.append((narrow.itemsize, narrow.view(np.uint8).reshape(size, narrow.itemsize).T.tobytes()))
    head = np.array([size, *(width for width, _ in parts)], np.int64).tobytes()
    return head + pa.compress(b"".join(part for _, part in parts), codec="zstd", asbytes=True)


def _from_bytes(packed: bytes, words: int) -> np.ndarray:
    size, *widths = np.frombuffer(packed, np.int64, words + 3).tolist()
    data = np.frombuffer(pa.decompress(packed[8 * (words + 3) :], size * sum(widths), codec="zstd", asbytes=True), np.uint8)
    entries, at, opens = np.empty((words + 2, size), _U), 0, np.arange(size) == 0
    for k, width in enumerate(widths):
        plane = np.ascontiguousarray(data[at : at + size * width].reshape(width, size).T)
        at += size * width
        values = plane.view(f"<u{width}").ravel().astype(_U)
        if k < words:
            first = np.maximum.accumulate(np.where(opens, np.arange(size), 0))
            sums = np.cumsum(values)
            values = sums - (sums - values)[first]
            opens = opens | np.concatenate([[True], values[1:] != values[:-1]])
        entries[k] = values
    return entries


def _batch(level: int, shards: list[int], packs: list[bytes], facts: list[int] | None = None) -> pa.RecordBatch:
    columns = [[level] * len(shards), shards, packs, *([fact] * len(shards) for fact in facts or [0] * 7)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _FIELDS)


def _packed(level: int, entries: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row per shard of the context, or of the word where there is none."""
    shard = _shard(_context_of(list(entries[: max(level - 1, 1)])), shards)
    order = np.argsort(shard, kind="stable")
    border = np.searchsorted(shard[order], np.arange(shards + 1))
    used = [k for k in range(shards) if border[k] < border[k + 1]]
    return _batch(level, used, [_to_bytes(entries[:, order[border[k] : border[k + 1]]], level) for k in used])


def _flushing(level: int, words: int, shards: int, entries_of, pack):
    """Tasks that gather what ``entries_of`` makes of each slice of texts, and pack it when there is enough."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        read, held, size = entries_of(), [], 0
        for batch in batches:
            for slice_ in cut(batch.column(0), SPACED):
                held.append(read(*_token_rows(slice_)))
                size += held[-1].shape[1]
                if size >= FLUSH:
                    yield pack(level, _reduced(np.concatenate(held, axis=1), words), shards)
                    held, size = [], 0
        if size:
            yield pack(level, _reduced(np.concatenate(held, axis=1), words), shards)

    return count


def _packed_words(level: int, entries: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row per shard of the word hashes, which are sorted, as the shards are."""
    border = np.searchsorted(_shard(entries[0], shards), np.arange(shards + 1))
    used = [k for k in range(shards) if border[k] < border[k + 1]]
    return _batch(level, used, [_to_bytes(entries[:, border[k] : border[k + 1]], 1) for k in used])


def _groups_of(counts: np.ndarray) -> np.ndarray:
    """0 for the most frequent words, and so on, by the logarithm of the count."""
    return _GROUPS - 1 - np.log2(counts.astype(float)).astype(np.int64)


def _numbered_words(texts: DataFrame, folder: str, shards: int) -> tuple[int, int]:
    """Write hashes, occurrences and numbers of all words. Returns how many tokens and different words there are."""
    spark = texts.sparkSession

    def whole_words():
        return lambda tokens, offsets: np.stack([tokens, np.ones(len(tokens), _U), np.ones(len(tokens), _U)])

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        entries = _reduced(np.concatenate([_from_bytes(b.as_py(), 1) for b in table.column("entries")], axis=1), 1)
        write_array(f"{folder}/words-{shard}-keys.npy", entries[0])
        write_array(f"{folder}/words-{shard}-raw.npy", _smallest(entries[-1]))
        groups = np.bincount(_groups_of(entries[-1]), minlength=_GROUPS)
        return pa.table({"shard": pa.array([shard], pa.int32()), "sizes": pa.array([groups.tolist()], pa.list_(pa.int64())), "tokens": pa.array([int(entries[-1].sum())], pa.int64())})

    counted = texts.mapInArrow(_flushing(0, 1, shards, whole_words, _packed_words), _PACK)
    merged = counted.groupBy("shard").applyInArrow(merge, "shard int, sizes array<long>, tokens long").collect()  # a row per shard
    sizes = np.zeros((shards, _GROUPS), np.int64)
    for row in merged:
        sizes[row["shard"]] = row["sizes"]
    # Numbers begin with 1: all shards' words of the first group, then those of the second.
    starts = (np.cumsum(sizes.T.ravel()) - sizes.T.ravel()).reshape(_GROUPS, shards) + 1

    def number(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                groups = _groups_of(map_array(f"{folder}/words-{shard}-raw.npy"))
                order = np.argsort(groups, kind="stable")
                numbers = np.empty(len(groups), np.int64)
                inside = np.arange(len(groups)) - (np.cumsum(sizes[shard]) - sizes[shard])[groups[order]]
                numbers[order] = starts[groups[order], shard] + inside
                write_array(f"{folder}/words-{shard}-numbers.npy", _smallest(numbers))
            yield batch

    used = spark.createDataFrame([(row["shard"],) for row in merged], "shard int")
    used.repartition(min(shards, max(1, len(merged)))).mapInArrow(number, "shard int").agg(F.count("*")).first()
    return sum(row["tokens"] for row in merged), int(sizes.sum())


def _merging(level: int, order: int, shards: int, folder: str):
    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        entries = _reduced(np.concatenate([_from_bytes(b.as_py(), level) for b in table.column("entries")], axis=1), level)
        counts = entries[-1] if level == order else entries[-2]
        name = f"{folder}/{level}-{shard}"
        if level == 1:
            write_array(f"{name}-keys.npy", entries[0])
            _write_counts(name, counts)
        else:
            opens = _opens(list(entries[: level - 1]))
            first = np.flatnonzero(opens)
            context = _context_of(list(entries[: level - 1, first]))
            by_context = np.argsort(context)
            stats = [np.add.reduceat(x.astype(_U), first)[by_context] for x in (counts, counts == 1, counts == 2, counts > 2)]
            write_array(f"{name}-contexts.npy", context[by_context])
            _write_kinds(name, stats)
            place = np.empty(len(first), _U)
            place[by_context] = np.arange(len(first), dtype=_U)
            keys = (place[np.cumsum(opens) - 1] << _WORD_BITS) | entries[level - 1]
            by_key = np.argsort(keys)
            write_array(f"{name}-keys.npy", keys[by_key])
            _write_counts(name, counts[by_key])
        sums = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int(counts.sum()), int(entries[-1].sum()), entries.shape[1]]
        batches = [_batch(level, [shard], [b""], sums)]
        if level > 1:
            lower = entries[1:].copy()
            lower[-2] = 1
            batches.append(_packed(level - 1, _reduced(lower, level - 1), shards))
        return pa.Table.from_batches(batches)

    return merge


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> NgramModel:
    """Count the n-grams of all texts and write the model below ``spark.checkpoint.dir``.

    Null text is a text without words: its end is still a token. Repeated rows count each. An empty table gives a
    model in which every token has probability 1 / (V + 1) with V = 0.
    """
    spark = texts.sparkSession
    folder, least = shared_folder(spark, "ngrams"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select(F.col(text))
    # Bytes are at least twice the tokens, or so, and the words are fewer still.
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    word_shards = max(least, size // 16 // SHARD_WORDS)
    tokens, vocabulary = _numbered_words(texts, folder, word_shards)
    free_shuffles(spark)
    shards = max(least, -(-tokens // SHARD_TOKENS))

    def numbered():
        words = Words(folder, word_shards)

        def read(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            numbers = words.numbers(hashes)
            # The contexts' words: order - 1 places back, and so on down to one.
            place = np.arange(len(numbers)) - np.repeat(offsets[:-1], np.diff(offsets))
            rows = [np.where(place < back, _START, np.roll(numbers, back)) for back in range(order - 1, 0, -1)]
            return np.stack([*rows, numbers, np.ones(len(numbers), _U), np.ones(len(numbers), _U)])

        return read

    if vocabulary >= int(_NO_WORD) - 1:
        raise ValueError("more different words than a key has room for")
    level, totals = texts.mapInArrow(_flushing(order, order, shards, numbered, _packed), _PACK), {}
    for n in range(order, 0, -1):
        sent = level.where((F.col("level") == n) & (F.length("entries") > 0))
        sent.groupBy("shard").applyInArrow(_merging(n, order, shards, folder), _PACK).write.parquet(f"{folder}/level-{n}")
        del sent, level
        level = spark.read.parquet(f"{folder}/level-{n}")
        totals[n] = [x or 0 for x in level.where((F.col("level") == n) & (F.length("entries") == 0)).agg(*map(F.sum, _FIELDS[3:])).first()]
        if n < order:
            delete_folder(spark, f"{folder}/level-{n + 1}")
        free_shuffles(spark)
    discounts = tuple(Discounts.of(*totals[n][:4]) for n in range(1, order + 1))
    n1, n2, _, _, total, _, kinds = totals[1]
    backoff = discounts[0].one * n1 + discounts[0].two * n2 + discounts[0].more * (kinds - n1 - n2)
    return NgramModel(folder, order, shards, word_shards, discounts, total, float(backoff), tokens, vocabulary)


class Words:
    """Numbers and occurrences of words, from mapped arrays."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.array = lru_cache(maxsize=None)(self._array)

    def _array(self, shard: int, name: str) -> np.ndarray | None:
        try:
            return map_array(f"{self.folder}/words-{shard}-{name}.npy")
        except FileNotFoundError:  # no word fell into the shard
            return None

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and occurrences of sorted, different word hashes."""
        numbers, raw = np.full(len(hashes), _UNKNOWN), np.zeros(len(hashes))
        border = np.searchsorted(_shard(hashes, self.shards), np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(border)).tolist():
            known = self.array(k, "keys")
            if known is None:
                continue
            here = slice(border[k], border[k + 1])
            place = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
            hit = known[place] == hashes[here]
            numbers[here] = np.where(hit, self.array(k, "numbers")[place], _UNKNOWN)
            raw[here] = np.where(hit, self.array(k, "raw")[place], 0)
        return numbers, raw

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        words, back = np.unique(hashes, return_inverse=True)
        return self.look_up(words)[0][back]


class Tables:
    """The model's arrays, mapped when they are first needed."""

    def __init__(self, model: NgramModel):
        self.model = model
        self.words = Words(model.folder, model.word_shards)
        self.array = lru_cache(maxsize=None)(self._array)

    def _array(self, level: int, shard: int, name: str) -> np.ndarray | None:
        try:
            return map_array(f"{self.model.folder}/{level}-{shard}-{name}.npy")
        except FileNotFoundError:  # no n-gram fell into the shard
            return None

    def continuations(self, words: np.ndarray) -> np.ndarray:
        """Continuation counts of different words."""
        shard, counts = _shard(_context_of([words]), self.model.shards), np.zeros(len(words))
        order = np.argsort(shard, kind="stable")
        border = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for k in np.flatnonzero(np.diff(border)).tolist():
            known = self.array(1, k, "keys")
            if known is None:
                continue
            here = order[border[k] : border[k + 1]]
            place = np.minimum(np.searchsorted(known, words[here]), len(known) - 1)
            counts[here] = np.where(known[place] == words[here], self._counts(1, k, place), 0)
        return counts

    def _counts(self, level: int, shard: int, places: np.ndarray) -> np.ndarray:
        counts = self.array(level, shard, "counts")[places].astype(np.int64)
        large = np.flatnonzero(counts == 255)
        if len(large):
            counts[large] = self.array(level, shard, "large")[np.searchsorted(self.array(level, shard, "places"), places[large])]
        return counts

    def seen(self, level: int, context: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is known of each context (total, kinds that follow once, twice, more often) and each n-gram's count.

        Tokens are ordered by context, as the shards and the arrays in them are, so searches go through these in order.
        """
        order = np.argsort(context)
        ordered = context[order]
        opens = _opens([ordered])
        first = np.flatnonzero(opens)
        distinct, which = ordered[first], np.cumsum(opens) - 1
        follow, seen = np.zeros((len(distinct), 4)), np.zeros(len(context))
        border = np.searchsorted(_shard(distinct, self.model.shards), np.arange(self.model.shards + 1))
        ends = np.append(first, len(context))[border]
        for k in np.flatnonzero(np.diff(border)).tolist():
            known = self.array(level, k, "contexts")
            if known is None:
                continue
            here = slice(border[k], border[k + 1])
            place = np.minimum(np.searchsorted(known, distinct[here]), len(known) - 1)
            hit = known[place] == distinct[here]
            follow[here][hit] = self.array(level, k, "following")[self.array(level, k, "kinds")[place[hit]]]
            tokens = slice(ends[k], ends[k + 1])
            inside = which[tokens] - border[k]
            usable = np.flatnonzero(hit[inside])
            at = order[tokens][usable]
            # A word without a number is in no n-gram; its number has a bit that no key has.
            wanted = (place[inside[usable]].astype(_U) << _WORD_BITS) | np.minimum(words[at], _NO_WORD)
            keys = self.array(level, k, "keys")
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            match = keys[found] == wanted
            seen[at[match]] = self._counts(level, k, found[match])
        where = np.empty(len(context), np.int64)
        where[order] = which
        return follow[where], seen

    def score(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training and the model's probability of each token, given as word hashes."""
        model = self.model
        hashes, back = np.unique(tokens, return_inverse=True)
        words, raw = self.words.look_up(hashes)
        counts = self.continuations(words)
        tokens = words[back]
        total = max(model.continuations, 1)
        lowest = (counts - model.discounts[0].taken(counts)) / total
        rest = model.backoff / total if model.continuations else 1.0
        probability = (lowest + rest / (model.vocabulary + 1))[back]
        for n, context in enumerate(_contexts(tokens, offsets, model.order)[::-1], 2):
            discount = model.discounts[n - 1]
            follow, seen = self.seen(n, context, tokens)
            totals = np.maximum(follow[:, 0], 1)
            spread = np.where(follow[:, 0] > 0, follow[:, 1:] @ np.array(discount) / totals, 1.0)
            probability = (seen - discount.taken(seen)) / totals + spread * probability
        return raw[back], probability


def scored(texts: DataFrame, model: NgramModel) -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10) of each row of (key, text)."""

    def score(batches):
        tables = Tables(model)
        norm = np.log10(model.tokens + 0.5 * (model.vocabulary + 1))
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for words in cut(batch.column(1), SPACED):
                tokens, offsets = _token_rows(words)
                counts, probability = tables.score(tokens, offsets)
                starts, here = offsets[:-1], slice(words.first, words.last)
                out[0, here] = np.diff(offsets)
                out[1, here] = np.add.reduceat((counts > 0).astype(float), starts)
                out[2, here] = np.add.reduceat(np.log10(counts + 0.5) - norm, starts)
                out[3, here] = np.add.reduceat(np.log10(probability), starts)
            columns = [batch.column(0), *(pa.array(out[k].astype(np.int64)) for k in (0, 1)), *(pa.array(out[k]) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "n_known", "base_score", "score"])

    rows = texts.select(F.col(texts.columns[0]).cast("long").alias("key"), F.col(texts.columns[1]).alias("text"))
    return rows.mapInArrow(score, "key long, n_tokens long, n_known long, base_score double, score double")


def perplexity_report(documents: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of every row under the model of the rows that are not held out."""
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = train(rows.where(~held_out(F.col("doc_id"))), "text", order)
    return scored(rows, model).select(
        F.col("key").alias("doc_id"),
        held_out(F.col("key")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
