"""Operator 13, personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Texts are searched where they are read; nothing is shuffled. Every pattern takes a whole run of its characters at once
and never goes back into it, so a search is linear in the text however long its runs are. Base kinds keep every span
whose check holds. The other kinds are kept from ``THRESHOLD`` on, where a checksum or a context word is needed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardtide.functions.once import computed_once
from cardtide.llm.words import fresh

THRESHOLD = 0.6
#: Characters before and after a span in which context words count.
NEARBY = 48
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

#: Characters of an IBAN by country, ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(d - 9 * (d > 9) for d in doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ ]?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])")


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    if "@" in text:
        for found in _EMAIL.finditer(text):
            if found.group(1):
                yield *found.span(), False


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in _IP.finditer(text):
        if found.group(1):
            parts = [part.lstrip("0") or "0" for part in found.group().split(".")]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                yield *found.span(), False


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 13:
            digits = _digits(found.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield *found.span(), True


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_digits(found.group())) <= 15:
                yield *found.span(), False


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in _IBAN.finditer(text):
        need, at, taken = IBAN_LENGTHS.get(found.group()[:2], 0), found.start(), []
        while at < len(text) and len(taken) < need:
            if "0" <= text[at] <= "9" or "A" <= text[at] <= "Z":
                taken.append(text[at])
            elif text[at] != " " or text[at - 1] == " ":
                break
            at += 1
        closed = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if need and len(taken) == need and closed and mod97("".join(taken)):
            yield found.start(), at, True


def _matches(pattern: re.Pattern) -> Callable:
    def search(text: str) -> Iterator[tuple[int, int, bool]]:
        for found in pattern.finditer(text):
            yield *found.span(), False

    return search


class Kind(NamedTuple):
    """``prior`` is the score of a pattern match, ``checked`` what a checksum adds, ``near`` what a context word adds and
    ``against`` what a word against it takes away. ``alone`` kinds give way to overlapping spans of other kinds."""

    name: str
    search: Callable
    prior: float
    checked: float
    near: float
    against: float
    words: frozenset[str]
    other: frozenset[str]
    base: bool = False
    alone: bool = False


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_CALL = _set("phone call tel telephone mobile cell fax telefon anrufen handy téléphone appeler portable teléfono móvil llamar")
#: In the order in which they are listed.
KINDS = (
    Kind("email", _emails, 0.9, 0, 0.1, 0.3, _set("email mail contact e-mail kontakt courriel correo"), _set("example noreply"), base=True),
    Kind("ip", _addresses, 0.6, 0, 0.3, 0.4, _set("ip host server address addr login adresse dirección"), _set("version release section"), base=True),
    Kind("card", _cards, 0.4, 0.3, 0.3, 0.3, _set("card credit debit visa mastercard amex payment kreditkarte karte carte tarjeta"), _set("isbn tracking order"), base=True),
    Kind("phone", _phones, 0.7, 0, 0.3, 0.3, _CALL, _set("score ratio"), base=True),
    Kind("iban", _ibans, 0.4, 0.4, 0.2, 0, _set("iban bank account konto compte cuenta"), frozenset()),
    Kind("ssn", _matches(_SSN), 0.4, 0, 0.4, 0.2, _set("ssn social security"), _set("order part isbn"), alone=True),
    Kind("local_phone", _matches(_LOCAL), 0.4, 0, 0.4, 0.2, _CALL, _set("order part isbn"), alone=True),
)
BASE_KINDS = tuple(kind.name for kind in KINDS if kind.base)


def _context(text: str, start: int, end: int) -> set[str]:
    before, after = text[max(0, start - NEARBY) : start], text[end : end + NEARBY]
    return set(re.split(r"[^\w-]+", before.lower())) | set(re.split(r"[^\w-]+", after.lower()))


def _taken(spans: list[tuple[str, int, int, float]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that any span covers, in order. The last is a guard before all places."""
    starts, ends = [], []
    for _, start, end, _ in sorted(spans, key=lambda span: span[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, [*ends, -1]


def find_personal(text: str) -> list[tuple[str, int, int, float]]:
    """Kind, start, end and score of all spans, by kind as listed and then by start. Positions are code points."""
    found: list[tuple[str, int, int, float]] = []
    for kind in KINDS:
        starts, ends = _taken(found) if kind.alone else ([], [])
        for start, end, checked in kind.search(text):
            if ends and ends[bisect_left(starts, end) - 1] > start:
                continue
            words = _context(text, start, end)
            score = kind.prior + kind.checked * checked + kind.near * bool(words & kind.words) - kind.against * bool(words & kind.other)
            score = round(min(1.0, max(0.0, score)), 6)
            if kind.base or score >= THRESHOLD:
                found.append((kind.name, start, end, score))
    return found


def with_personal(documents: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """Add the spans of every row as an array (kind, start, end, score), by kind and then by start.

    A null or empty text has none. Rows, repeated ones too, and other columns stay; a column called ``name``, in any case,
    is replaced. An empty table stays empty.
    """
    kept = [column for column in documents.columns if column.lower() != name.lower()]
    source = documents.select(F.col(f"`{text}`").cast("string").alias(fresh(documents, "input")[0]), *[F.col(f"`{column}`") for column in kept])
    schema = T.StructType([*[source.schema.fields[k + 1] for k in range(len(kept))], T.StructField(name, T.DataType.fromDDL(SPANS))])

    def search(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), span)) for span in find_personal(value or "")] for value in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, pa.list_(_SPAN))], [*kept, name])

    return source.mapInArrow(search, schema)


def masked(documents: DataFrame, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``documents`` with every span of score ``least`` or more replaced by its kind in angle brackets.

    Overlapping spans become one mark, that of the first (the longest of those with one start). Null texts stay null.
    """

    def clean(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if v is None else _without(v, least) for v in column.to_pylist()], pa.string()) if k == place else column
                    for k, column in enumerate(batch.columns)
                ],
                columns,
            )

    columns = documents.columns
    place = columns.index(text)
    return documents.mapInArrow(clean, documents.schema)


def _without(text: str, least: float) -> str:
    parts, at = [], 0
    for kind, start, end, score in sorted(find_personal(text), key=lambda span: (span[1], -span[2])):
        if score >= least:
            if start >= at:
                parts += [text[at:start], f"<{kind}>"]
            at = max(at, end)
    return "".join([*parts, text[at:]])


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_report(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of their spans, all spans and the highest score of every row.

    Null and empty texts have no spans, the digest of an empty list and no score. Rows without a key and repeated rows
    have a row each; an empty table gives an empty result; other columns are not read.
    """
    found = with_personal(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    found = computed_once(found, {"base": F.filter("personal", lambda s: s["kind"].isin(*BASE_KINDS))})

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(kind) for kind in BASE_KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
        F.array_max(F.transform("personal", lambda s: s["score"])).alias("score"),
    )
