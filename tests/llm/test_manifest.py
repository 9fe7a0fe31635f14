"""Merkle manifests against a plain loop."""

import hashlib
import zlib

import pytest

from pyspark.sql import functions as F

from cardtide.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, number string, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = (row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, arity):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([sha("".join(made[-1][k : k + arity])) for k in range(0, len(made[-1]), arity)])
    return made


def brute(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]], arity) for g in order]
    top = levels([tree[-1][0] for tree in trees], arity)
    out = []
    for place, (g, tree) in enumerate(zip(order, trees)):
        for number, row in enumerate(groups[g]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now, proof = leaf(row, int(hit)), ""
            for made, at in ((tree, number), (top, place)):
                for level in made[:-1]:
                    start = at - at % arity
                    run = level[start : start + arity]
                    proof += "".join(run[: at % arity] + run[at % arity + 1 :])
                    run[at % arity] = now
                    now, at = sha("".join(run)), at // arity
            out.append((row[0], tree[0][number], tree[-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def reported(spark, rows, arity=2):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in manifest.manifest_report(frame, arity).collect()), key=str)


EDGE = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "x", None, "é", 3), (None, None, None, None, None),
    (7, "same", "de", "s", 4), (7, "other", "de", "s", 5), (7, "same", "de", "s", 4), (-5, "é\x00🎉", "", "s", 9), (8, "w " * 60_000, "ü", "s", 120_000),
]
MANY = [(k * 37 % 1009 - 500, f"text {k}", ["en", "en", "de", None, f"l{k % 11}"][k % 5], f"s{k % 3}", k) for k in range(240)]


@pytest.mark.parametrize("rows, arity", [(EDGE, 2), (MANY, 3), ([], 2), ([(3, "t", "en", "s", 1)] * 40 + EDGE[:1], 2)])
def test_manifest_against_a_loop(spark, rows, arity):
    assert reported(spark, rows, arity) == brute(rows, arity)


def test_levels_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SMALL", 0)
    assert reported(spark, MANY) == brute(MANY, 2)


def test_a_changed_row_changes_only_its_proofs_outcome(spark):
    frame = spark.createDataFrame([(k, f"t{k}", "en", "s", k, "", "", "") for k in range(50)], SCHEMA)
    made = manifest.manifest(frame, "lang", ["doc_id"], manifest.leaf_of([F.col("text")]), {"doc_id": F.col("doc_id")})
    other = F.unhex(F.sha2(F.lit("other"), 256))
    kept = made.leaves.select(manifest.shown(manifest.folded(made, F.col("leaf"))).alias("a"), manifest.shown(manifest.folded(made, other)).alias("b"))
    assert all(r["a"] == made.root != r["b"] for r in kept.collect())
    with pytest.raises(ValueError):
        manifest.manifest(frame, "lang", ["doc_id"], F.col("text"), arity=1)
