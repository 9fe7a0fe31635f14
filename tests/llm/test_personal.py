"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

import pytest

from cardtide.llm import personal

SCHEMA = "doc_id long, text string, base string, PERSONAL string, score string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    return {
        "email": True,
        "ip": all(int(part) <= 255 for part in text.split(".")) if kind == "ip" else False,
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def noise(seed):
    choice = random.Random(seed)
    parts = ["@", ".", "a.b", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.255", "010.1.2.256", "x@y.zz", "é", "🎉", "%", "7", "12", "+1 (743) 555-3824", "\n"]
    return ["".join(choice.choice(parts) for _ in range(choice.randrange(60))) for _ in range(150)]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_against_the_plain_patterns(seed):
    for text in noise(seed):
        assert [span[:3] for span in personal.find_personal(text) if span[0] in PLAIN] == brute(text), text


def test_report_of_all_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows += [(-k, t) for k, t in enumerate(noise(9))] + [(None, "a@b.cc"), (None, None), (3, None), (3, ""), (3, "")]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    expected = []
    for i, text in rows:
        base = brute(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(b[0] == k for b in base) for k in PLAIN]
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in personal.find_personal(text or ""))
        assert spans.startswith(listed)
        expected.append((i, *counts, hashlib.sha256(listed.encode()).hexdigest(), spans))
    got = [tuple(r)[:-1] for r in personal.personal_report(frame).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert personal.personal_report(frame.limit(0)).count() == 0
    assert personal.with_personal(frame).columns == ["doc_id", "text", "base", "score", "personal"]


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in personal.find_personal(text)]


def test_checksums_and_context():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay GB82WEST12345698765432 now") == [("iban", "GB82WEST12345698765432")]
    assert not kinds("IBAN DE88 3704 0044 0532 0130 00") and not kinds("GB82WEST123456987654321") and not kinds("XX82WEST12345698765432")
    assert kinds("my SSN is 219-09-9999") == [("ssn", "219-09-9999")]
    assert not kinds("part 219-09-9999") and not kinds("ssn 000-09-9999")
    assert kinds("call (743) 555-3824") == [("local_phone", "(743) 555-3824")] and not kinds("sum (743) 555-3824")
    assert kinds("call +1 (743) 555-3824") == [("phone", "+1 (743) 555-3824")]
    scores = [personal.find_personal(f"{word} 4111 1111 1111 1111")[0][3] for word in ("tracking", "plain", "visa")]
    assert scores == [0.4, 0.7, 1.0]


def test_masked(spark):
    rows = [(1, "mail a@b.cc or visa 4111111111111111 é", "", "", ""), (2, None, "", "", ""), (3, "clean", "", "", "")]
    out = personal.masked(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "mail <email> or visa <card> é", 2: None, 3: "clean"}


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@a", "+1", "+1 ", "a@", "1-", "DE89 ", "555-", "a.@a.a", "(743) 555-3824 "])
def test_long_texts_take_linear_time(unit):
    begun = time.time()
    personal.find_personal(unit * (400_000 // len(unit)))
    assert time.time() - begun < 8
