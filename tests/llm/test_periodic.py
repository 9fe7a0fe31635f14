"""Periodic runs against a loop over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cardtide.llm import periodic

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h string, RUNS string, words string, n string"


def brute(words, length=6, exponent=4):
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(length, exponent * q):
                found.setdefault((start, i - start + q), q)  # the smallest period of this stretch
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_of(seed):
    choice, made = random.Random(seed), []
    for _ in range(30):
        words = [choice.choice("ab") if choice.random() < 0.5 else choice.choice("abcdef") for _ in range(choice.randrange(60))]
        part = [choice.choice("xyz") for _ in range(choice.randrange(1, 7))]
        made.append(words[:9] + part * choice.randrange(9) + words[9:])
    return made


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (3, Fraction(5, 2)), (9, 3)])
@pytest.mark.parametrize("seed", range(10))
def test_runs_against_all_periods(limits, seed):
    made = texts_of(seed)
    names = {w: k for k, w in enumerate("abcdefxyz")}
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in made])])
    codes = np.array([names[w] for t in made for w in t], np.int64)
    got = periodic.runs_of(codes, offsets, periodic.Limits(limits[0], Fraction(limits[1])))
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(made) for r in brute(t, *limits)]


def expected(doc_id, text):
    words = SPACED.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    kept = [True] * n
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    collapsed = " ".join(w for w, keep in zip(words, kept) if keep)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def rows():
    ten = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    made = [(k, " ".join(f"w{j % 50}" for j in range(k % 77))) for k in ten]
    made += [(500 + k, " ".join(t)) for k, t in enumerate(texts_of(3))]
    made += [(None, "a " * 9), (None, None), (600, None), (601, ""), (602, " \t\n"), (603, "a a a a a"), (604, "a a a a a a"), (604, "a a a a a a")]
    made += [(605, "A a A a A a A a\x00é 🎉 🎉 \x0b " + "é " * 7), (606, "x " * 20_000), (607, "x " * 99), (ten[0], None), (ten[0], "one")]
    return made


def test_report_against_all_periods(spark):
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows()], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in periodic.run_report(frame).collect()), key=str)
    quick = {(i, t): expected(i, t) for i, t in rows() if i != 606}
    long = (606, 1, 0, 20_000, 1, 20_000_000, *(hashlib.sha256(x).hexdigest() for x in (b"0,20000,1\n", b"x")))
    assert got == sorted([quick.get(r, long) for r in rows()], key=str)
    assert periodic.run_report(frame.limit(0)).count() == 0


def test_columns_and_limits(spark):
    frame = spark.createDataFrame([(1, "b a a c", "h", "r", "w", "n")], SCHEMA)
    row = periodic.with_runs(frame, min_length=2, min_exponent=2).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "text": "b a a c", "h": "h", "words": "w", "n": "n", "n_words": 4, "runs": [{"start": 1, "length": 2, "period": 1}], "collapsed": "b a c"}
    with pytest.raises(ValueError):
        periodic.with_runs(frame, min_exponent=1)
