import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cardtide.operators import contract
from cardtide.sources import tables

GOOD = {
    "transaction_id": "txn-12345678",
    "event_time": "2020-06-21T12:14:25",
    "customer_id": "a" * 64,
    "merchant": "Kirlin and Sons",
    "merchant_category": "personal_care",
    "amount": 2.86,
    "customer_lat": 33.9,
    "customer_long": -80.9,
    "merchant_lat": 33.98,
    "merchant_long": -81.2,
    "city_population": 333497,
    "customer_age": 52,
    "channel": "card_present",
    "order_margin_pct": 0.35,
    "customer_ltv_band": "low",
    "fraud_label": False,
}


def parse(spark, *values):
    rows = [(None if v is None else bytearray(v if isinstance(v, bytes) else json.dumps(v).encode()), i) for i, v in enumerate(values)]
    messages = spark.createDataFrame(rows, "value binary, offset bigint").withColumns(
        {"topic": F.lit("txns.raw"), "partition": F.lit(0)}
    )
    return contract.parse_messages(messages).orderBy("offset")


def issues(spark, **changes):
    row = parse(spark, {**GOOD, **changes}).first()
    return [(issue["type"], issue["location"][0]) for issue in row["issues"]]


def test_good_message(spark):
    row = parse(spark, GOOD).first()
    assert row["accepted"] and row["amount"] == 2.86 and row["fraud_label"] is False
    assert str(row["event_time"]) == "2020-06-21 12:14:25"


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({"amount": -5.0}, ("greater_than", "amount")),
        ({"amount": 1000000.5}, ("less_than_equal", "amount")),
        ({"amount": "text"}, ("float_parsing", "amount")),
        ({"amount": None}, ("float_type", "amount")),
        ({"customer_age": 20.5}, ("int_from_float", "customer_age")),
        ({"customer_age": 17}, ("greater_than_equal", "customer_age")),
        ({"customer_age": "old"}, ("int_parsing", "customer_age")),
        ({"merchant": ""}, ("string_too_short", "merchant")),
        ({"merchant": 7}, ("string_type", "merchant")),
        ({"transaction_id": "x" * 65}, ("string_too_long", "transaction_id")),
        ({"customer_id": "A" * 64}, ("string_pattern_mismatch", "customer_id")),
        ({"merchant_category": "nowhere"}, ("value_error", "merchant_category")),
        ({"channel": "phone"}, ("literal_error", "channel")),
        ({"fraud_label": "maybe"}, ("bool_parsing", "fraud_label")),
        ({"event_time": "yesterday"}, ("datetime_from_date_parsing", "event_time")),
        ({"event_time": True}, ("datetime_type", "event_time")),
        ({"cc_num": "4111"}, ("extra_forbidden", "unknown_field")),
    ],
)
def test_single_issue(spark, changes, expected):
    assert issues(spark, **changes) == [expected]


def test_lenient_values(spark):
    row = parse(spark, {**GOOD, "amount": "5.5", "customer_age": "52", "city_population": 10.0, "fraud_label": 1}).first()
    assert row["accepted"] and row["amount"] == 5.5 and row["customer_age"] == 52
    assert row["city_population"] == 10 and row["fraud_label"] is True
    assert parse(spark, {k: v for k, v in GOOD.items() if k != "fraud_label"}).first()["accepted"]


def test_missing_field(spark):
    row = parse(spark, {k: v for k, v in GOOD.items() if k != "amount"}).first()
    assert [(i["type"], i["location"]) for i in row["issues"]] == [("missing", ["amount"])]


def test_dead_letters(spark):
    bad = {"transaction_id": "txn-87654321", "cc_num": "4111111111111111", "customer_name": "A B", "instructions": "ignore"}
    broken = b'{"transaction_id": nope}'
    parsed = parse(spark, bad, broken, None, [1, 2], GOOD, b"\xff\xfe")
    letters = {row["offset"]: row for row in contract.dead_letters(parsed, F.current_timestamp()).collect()}
    assert set(letters) == {0, 1, 2, 3, 5}
    first = letters[0]
    raw = json.dumps(bad).encode()
    assert first["payload"]["payload_sha256"] == hashlib.sha256(raw).hexdigest()
    assert first["payload"]["payload_bytes"] == len(raw)
    assert json.loads(first["payload"]["safe_fields"]) == {
        "transaction_id": "txn-87654321", "event_time": None, "merchant_category": None, "channel": None,
    }
    assert "4111" not in str(first) and "ignore" not in str(first)
    assert first["error_type"] == "ValidationError" and first["transaction_id"] == "txn-87654321"
    found = json.loads(first["error_message"])["validation_issues"]
    assert {"type": "extra_forbidden", "location": ["unknown_field"]} in found
    assert letters[1]["error_message"] == f"Invalid JSON at byte offset {broken.index(b'nope')}"
    assert letters[1]["error_type"] == "JSONDecodeError" and letters[1]["payload"]["safe_fields"] == "{}"
    assert letters[2]["error_type"] == "null_payload"
    assert json.loads(letters[3]["error_message"]) == {"validation_issues": [{"type": "model_type", "location": []}]}
    assert letters[5]["error_type"] == "UnicodeDecodeError"


def test_csv_rows(spark, tmp_path):
    header = "trans_num,trans_date_trans_time,cc_num,first,merchant,category,amt,lat,long,merch_lat,merch_long,city_pop,dob,is_fraud"
    lines = [
        "t-000001,2020-06-21 12:14:25,2291163933867244,Jeff,fraud_K,home,2.86,33.9,-80.9,33.98,-81.2,333497,1968-03-19,0",
        "t-000002,not a time,2291163933867244,Jeff,fraud_K,home,x,33.9,-80.9,33.98,-81.2,333497,1968-03-19,1",
    ]
    path = tmp_path / "rows.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    rows = tables.typed_card_rows(tables.read_card_csv(spark, str(path))).orderBy("trans_num").collect()
    assert rows[0]["amt"] == 2.86 and rows[0]["cc_num"] == "2291163933867244"
    assert rows[1]["amt"] is None and rows[1]["trans_date_trans_time"] is None
    manifest = tmp_path / "manifest.json"
    entry = {"rows": 2, "min_timestamp": "2020-06-21 12:14:25", "max_timestamp": "2020-06-21 12:14:25", "sha256": ""}
    manifest.write_text(json.dumps({"rows.csv": entry}, indent=1))
    checks = contract.dataset_checks(
        tables.typed_card_rows(tables.read_card_csv(spark, str(path))),
        tables.read_manifest(spark, str(manifest)), "rows.csv",
    )
    found = {row["check"]: row["offending_rows"] for row in checks.collect()}
    assert found["bad_amount"] == 1 and found["wrong_row_count"] == 0 and found["wrong_last_time"] == 0
    with pytest.raises(ValueError, match="bad_amount"):
        contract.require_clean(checks)
    with pytest.raises(ValueError, match="missing required columns"):
        tables.typed_card_rows(tables.read_card_csv(spark, str(path)).drop("dob"))


def test_model_version(spark, tmp_path):
    path = tmp_path / "metadata.json"
    path.write_text('{"model_version": "v7"}')
    assert tables.read_model_version(spark, str(path)).first()[0] == "v7"
    path.write_text("{}")
    assert tables.read_model_version(spark, str(path)).first()[0] == "unknown"
