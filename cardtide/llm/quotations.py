"""Operator 7, chat formatting: link quotations to the messages they come from.

A line that starts with quote marks (``>``, nested ``> >``) is quoted; the number of marks is its level. Successive
quoted lines of one level are a passage. Passages and unquoted bodies are normalised (lower case, single spaces, line
breaks ignored) and hashed sentence by sentence, since quoting breaks lines anew and often takes a part only. A
sentence's original is the earliest message of the conversation that holds it unquoted, which makes the join's right
side one row per (conversation, sentence). A message replies to the message from which most sentences of its
outermost linked level come. Threads follow from the replies by pointer jumping.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardtide.llm.shared import materialised

_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARSED = "body string, own array<bigint>, quoted array<struct<level:int,passage:int,sentence:bigint>>"
_QUOTED = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("sentence", pa.int64())]))


def sentence_hashes(text: str) -> list[int]:
    """64-bit hashes of the normalised sentences of a text."""
    plain = " ".join(text.lower().split())
    parts = [s for s in _SENTENCE.split(plain) if s]
    return [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True) for s in parts]


def parsed(text: str) -> tuple[str, list[int], list[dict]]:
    """The text without quotations, its sentence hashes, and those of its passages with their levels."""
    body, passages = [], []
    before = 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        if not level:
            body.append(line)
        elif level == before:
            passages[-1][1].append(line[marks.end() :])
        else:
            passages.append((level, [line[marks.end() :]]))
        before = level
    plain = "\n".join(body)
    plain = plain.strip("\n") if passages else plain
    quoted = [
        {"level": level, "passage": k, "sentence": h}
        for k, (level, lines) in enumerate(passages)
        for h in sentence_hashes("\n".join(lines))
    ]
    return plain, sentence_hashes(plain), quoted


def _parse(batches):
    for batch in batches:
        found = [parsed(text or "") for text in batch.column(batch.num_columns - 1).to_pylist()]
        kinds = (pa.string(), pa.list_(pa.int64()), _QUOTED)
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], ["conv_id", "turn", "role", "body", "own", "quoted"])


def _threads(replies: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``root`` and ``depth`` of messages that reply. A reply is always to an earlier turn."""
    now = materialised(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:
        above = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "root"], "left")
        if joined.where("higher is not null").isEmpty():
            return now
        now = materialised(
            joined.select(
                "conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )


def linked_messages(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per row of ``messages``, to be read in the order of conv_id, root_turn, depth, turn.

    ``reply_to`` is the turn it quotes, null without a link; ``root_turn`` and ``depth`` place it in its thread;
    ``n_sentences`` and ``n_linked`` count quoted and linked sentences; ``formatted`` is the message as a chat turn
    without quotations. Null text is empty, a null role is "unknown"; a null conversation or turn links to nothing.
    Rows that repeat (conversation, turn) count as one message with all their sentences; equally good originals give
    the latest turn. An empty table gives an empty result; other columns are not read.
    """
    rows = messages.select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    read = rows.mapInArrow(_parse, f"conv_id long, turn long, role string, {_PARSED}")
    key = ["conv_id", "sentence"]
    originals = read.select("conv_id", "turn", F.explode("own").alias("sentence")).groupBy(*key).agg(F.min("turn").alias("origin"))
    quotes = read.select("conv_id", "turn", F.explode("quoted").alias("q")).groupBy(
        "conv_id", "turn", F.col("q.level").alias("level"), F.col("q.sentence").alias("sentence")
    ).agg(F.count("*").alias("n"))
    links = materialised(quotes.join(originals, key).where("origin < turn"))
    best = links.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    reply = best.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("reply_to"), F.sum("n").alias("n_linked")
    )
    threads = _threads(reply)
    placed = reply.join(threads, ["conv_id", "turn"])
    out = read.join(placed, ["conv_id", "turn"], "left")
    speaker = F.coalesce("role", F.lit("unknown"))
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("quoted").cast("long").alias("n_sentences"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), speaker, F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("formatted"),
    )
