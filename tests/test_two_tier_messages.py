"""The typed reading of messages must agree with the full one on every message it takes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cardtide.operators import contract

GOOD = {
    "transaction_id": "txn-00000001", "event_time": "2024-01-05T10:11:12", "customer_id": "a" * 64, "merchant": "Shop",
    "merchant_category": "travel", "amount": 12.5, "customer_lat": 1.0, "customer_long": 2, "merchant_lat": 3.25, "merchant_long": 4.0,
    "city_population": 1000, "customer_age": 40, "channel": "card_present", "order_margin_pct": 0.3, "customer_ltv_band": "low", "fraud_label": None,
}


def message(**changes):
    return json.dumps({**GOOD, **changes}, separators=(",", ":"))


def variants():
    yield from (message(), json.dumps(GOOD), json.dumps(GOOD, indent=1), message(fraud_label=True), message(event_time="2024-01-05"))
    yield json.dumps({k: v for k, v in GOOD.items() if k != "fraud_label"})
    odd = [None, 1, 1.5, -3, 10**30, True, "", "x", "12", "1e3", "NaN", "é\"\\\n", [1], {"a": 1}, "yes", 1704448800, "2024-01-05 10:00"]
    for name in GOOD:
        yield json.dumps({k: v for k, v in GOOD.items() if k != name})
        for value in odd:
            yield message(**{name: value})
    yield message(extra=1)
    yield message(merchant='a","transaction_id":"b')
    yield message(merchant="{}")
    yield message().replace("12.5", "NaN")
    yield message().replace("12.5", "012.5")
    yield message().replace('"', "'")
    yield message()[:-1] + ',"amount":13.5}'
    yield message()[:-1] + ',"transaction_id":12345678}'
    yield message().replace('"customer_id":"' + "a" * 64 + '"', '"customer_id":' + "1" * 64)
    yield message().replace('"transaction_id":"txn-00000001"', '"transaction_id":123456789')
    yield from (message() + " ", message() + "1", message() + "{}", " " + message(), message() + "}", "{}", "[]", "1", '"x"', "null", "", "{broken")


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(bytearray(text.encode()), k) for k, text in enumerate(variants())] + [(None, -1), (bytearray(b"\xff\xfe{}"), -2)]
    messages = spark.createDataFrame(rows, "value binary, offset bigint").repartition(4)
    columns = ["offset", "payload_state", *contract.EVENT_FIELDS, "issues", "accepted"]

    def read(frame):
        return {r["offset"]: r.asDict(recursive=True) for r in frame.select(*columns).collect()}

    taken = {r["offset"] for r in contract._plain_reading(messages).filter("_plain").collect()}
    return dict(enumerate(variants())), taken, read(contract.parse_messages(messages)), read(contract._full_reading(messages))


def test_both_readings_agree(readings):
    texts, taken, both, full = readings
    assert len(both) == len(texts) + 2
    wrong = {k: (texts.get(k), both[k], full[k]) for k in both if both[k] != full[k]}
    assert not wrong, next(iter(wrong.values()))


def test_plain_messages_need_no_full_reading(readings):
    texts, taken, both, _ = readings
    assert {0, 1, 3, 4, 5} <= taken
    assert all(both[k]["accepted"] and both[k]["issues"] == [] for k in taken)
    assert both[0]["event_time"] == datetime(2024, 1, 5, 10, 11, 12)


def test_dead_letters_read_only_what_failed(spark):
    rows = spark.createDataFrame([(bytearray(t.encode()), "t", 0, k) for k, t in enumerate([message(), message(amount=0), "{broken"])], "value binary, topic string, partition int, offset bigint")
    letters = contract.dead_letters(contract.parse_messages(rows), F.lit("2024-01-01"))
    assert {r["offset"]: r["error_type"] for r in letters.collect()} == {1: "ValidationError", 2: "JSONDecodeError"}


def test_messages_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([(bytearray(message().encode()), 0)], "value binary, offset bigint").write.parquet(str(tmp_path / "in"))
    plan = contract.parse_messages(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
