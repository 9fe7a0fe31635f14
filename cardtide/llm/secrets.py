"""Operator 3, secret scans: an incremental ledger of content-addressed blobs.

A version of a file is its text; a blob is a distinct text, addressed by its SHA-256. The ledger has one row per
scanned (blob, rule version) with the findings. A scan hashes every version, keeps the blobs that the ledger does
not have for this rule version, reads one version of each of them, and joins the findings of all blobs back to every
path. Copies of a text are scanned once, and a second scan with the same rules reads only new blobs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardtide.llm.shared import materialised
from cardtide.llm.words import fresh

RULE_VERSION = "3"
#: Kinds in the order in which spans of one start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "url_login")
BASE_KINDS = KINDS[:3]
#: From BEGIN to the first END of a private key before another BEGIN. Without one, to the end of the lines that are
#: base64 or PEM headers, or of long base64 words. Line ends may be escaped.
_PEM = r"""(?x)-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-----
    (?: (?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-----
    | (?: (?:\s|\\[nrt])*(?:[\r\n]|\\[nr])[\x20\t]*
            (?: [A-Za-z0-9+/=]+(?=[\x20\t]*(?:[\r\n"',;)]|\\[nr]|\Z)) | (?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):\x20[^\r\n\\]* )
        | (?:\s|\\[nrt])*[A-Za-z0-9+/=]{32,} )* )"""
_RULES = (
    ("assign", ("passw", "secret", "token", "api"), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", None, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", None, r"[0-9a-f]{24,}", 0, 24),
    ("private_key", ("-----begin",), _PEM, 0, 1),
    ("web_token", ("eyj",), r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("url_login", ("://",), r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]*:[^\s/@]+@", 0, 1),
)
SPANS = "array<struct<start:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def find_secrets(text: str) -> list[dict]:
    """Spans of all rules, by start and then by kind. Positions are code points, ends are exclusive."""
    lowered = text.lower()
    found = []
    for place, (kind, needed, pattern, group, least) in enumerate(_COMPILED):
        if needed and not any(part in lowered for part in needed):
            continue
        for match in pattern.finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), place, kind, match.end()))
    return [{"start": start, "kind": kind, "end": end} for start, _, kind, end in sorted(found)]


_COMPILED = [
    (kind, needed, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind in ("assign", "url_login") else 0)), group, least)
    for kind, needed, pattern, group, least in _RULES
]


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_versions(
    versions: DataFrame, ledger: DataFrame, path: str, text: str = "text", rule_version: str = RULE_VERSION
) -> tuple[DataFrame, DataFrame]:
    """``(paths, new)``: one row (``path``, ``blob``) per version, and the ledger rows of blobs not scanned before.

    Null text is the empty blob. A null path and repeated rows are versions like others. An empty table gives empty
    results; other columns are not read. ``new`` is written to the shared folder; append it to the ledger.
    """
    hashed = versions.select(
        F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2("text", 256))
    # One version stands for each blob. Only keys are shuffled here.
    known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
    first = hashed.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    chosen = hashed.join(
        first.select(F.col("blob").alias("b"), F.col("path").alias("p")),
        (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")),
        "left_semi",
    ).select("blob", "text")

    def scan(batches):
        for batch in batches:
            spans = [find_secrets(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], ["blob", "spans"])

    scanned = chosen.mapInArrow(scan, f"blob string, spans {SPANS}")
    new = scanned.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    return hashed.select("path", "blob"), materialised(new)


def findings_by_path(paths: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every path with the spans of its blob; an empty array where the blob is clean."""
    dirty = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(dirty, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(documents: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of every row."""
    ledger = empty_ledger(documents.sparkSession) if ledger is None else ledger
    paths, new = scan_versions(documents, ledger, key, text)
    found = findings_by_path(paths, ledger.unionByName(new))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"),
        *[of(kind) for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``documents`` with every span replaced by ``mark``; rows, columns and clean texts stay as they are."""
    ledger = empty_ledger(documents.sparkSession)
    _, new = scan_versions(documents, ledger, key, text)
    blob, spans = fresh(documents, "blob", "spans")
    dirty = new.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))

    def cut(value: Column, found: Column) -> Column:
        """Pieces between the spans, joined by the mark."""
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("upto"))
        return F.aggregate(
            found,
            start,
            lambda state, s: F.when(
                s["start"] >= state["upto"],
                F.struct(
                    F.concat(state["text"], F.substring(value, state["upto"] + 1, s["start"] - state["upto"]), F.lit(mark)).alias("text"),
                    s["end"].alias("upto"),
                ),
            ).otherwise(F.struct(state["text"].alias("text"), F.greatest(state["upto"], s["end"]).alias("upto"))),
            lambda state: F.concat(state["text"], F.substring(value, state["upto"] + 1, F.length(value))),
        )

    joined = documents.withColumn(blob, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).join(dirty, blob, "left")
    value = F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(spans)))
    return joined.select(*[value.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns])
