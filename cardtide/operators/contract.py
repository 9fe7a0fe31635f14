"""Event contract: typed rules, JSON messages, dead letters, dataset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardtide.fixed_values import BANDS, CATEGORIES, CHANNELS, DEAD_LETTER_FIELDS, RAW_TOPIC
from cardtide.functions.once import computed_once
from cardtide.sources.schemas import EVENT_FIELDS, EVENT_SCHEMA, RAW_COLUMNS

ISSUES_TYPE = "array<struct<type:string,location:array<string>>>"
MASKED_FIELD = "unknown_field"
OPTIONAL_FIELDS = {"fraud_label"}

# Bounds of the contract.
LENGTHS = {"transaction_id": (8, 64), "merchant": (1, 160)}
PATTERNS = {"customer_id": "^[a-f0-9]{64}$"}
CHOICES = {"channel": CHANNELS, "customer_ltv_band": BANDS}
BOUNDS = {
    "amount": (("greater_than", 0), ("less_than_equal", 1_000_000)),
    "customer_lat": (("greater_than_equal", -90), ("less_than_equal", 90)),
    "customer_long": (("greater_than_equal", -180), ("less_than_equal", 180)),
    "merchant_lat": (("greater_than_equal", -90), ("less_than_equal", 90)),
    "merchant_long": (("greater_than_equal", -180), ("less_than_equal", 180)),
    "city_population": (("greater_than_equal", 0),),
    "customer_age": (("greater_than_equal", 18), ("less_than_equal", 120)),
    "order_margin_pct": (("greater_than", 0), ("less_than_equal", 1)),
}
# NaN sorts above every number in Spark but satisfies no lower bound here.
_BROKEN = {
    "greater_than": "({0} <= {1} OR isnan({0}))",
    "greater_than_equal": "({0} < {1} OR isnan({0}))",
    "less_than_equal": "({0} > {1} AND NOT isnan({0}))",
}


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _rules(name: str) -> list[tuple[str, str]]:
    """(condition in SQL, issue type) pairs that a well-typed value of the field may break."""
    if name in LENGTHS:
        low, high = LENGTHS[name]
        return [(f"length({name}) < {low}", "string_too_short"), (f"length({name}) > {high}", "string_too_long")]
    if name in PATTERNS:
        return [(f"NOT rlike({name}, '{PATTERNS[name]}')", "string_pattern_mismatch")]
    if name == "merchant_category":
        return [(f"{name} NOT IN ({_listed(CATEGORIES)})", "value_error")]
    if name in CHOICES:
        return [(f"{name} NOT IN ({_listed(CHOICES[name])})", "literal_error")]
    return [(_BROKEN[kind].format(f"CAST({name} AS DOUBLE)", bound), kind) for kind, bound in BOUNDS.get(name, ())]


def _all_rules(name: str) -> list[tuple[str, str]]:
    missing = [] if name in OPTIONAL_FIELDS else [(f"{name} IS NULL", "missing")]
    return missing + _rules(name)


def event_issues() -> Column:
    """Contract issues of an already typed event row."""
    found = []
    for name in EVENT_FIELDS:
        branches = " ".join(
            f"WHEN {condition} THEN named_struct('type', '{kind}', 'location', array('{name}'))"
            for condition, kind in _all_rules(name)
        )
        if branches:
            found.append(f"CASE {branches} END")
    return F.expr(f"CAST(array_compact(array({', '.join(found)})) AS {ISSUES_TYPE})")


def is_valid_event() -> Column:
    """The same rules as one plain condition."""
    required = [f"{name} IS NOT NULL" for name in EVENT_FIELDS if name not in OPTIONAL_FIELDS]
    kept = [f"NOT ({condition})" for name in EVENT_FIELDS for condition, _ in _rules(name)]
    return F.expr(" AND ".join(required + kept))


def with_issues(events: DataFrame) -> DataFrame:
    return events.withColumn("issues", event_issues())


def _materialised(events: DataFrame) -> DataFrame:
    """Keep the rules above the event's expressions; pushed below, they repeat a hash per rule.

    Identifier and time stay outside the fence, so that filters on them still reach the scan.
    """
    outside = [name for name in ("transaction_id", "event_time") if name in events.columns]
    inside = F.struct(*[name for name in events.columns if name not in outside])
    return events.select(*outside, F.inline(F.array(inside))).select(*events.columns)


def valid_events(events: DataFrame) -> DataFrame:
    return _materialised(events).filter(is_valid_event())


def rejected_events(events: DataFrame) -> DataFrame:
    return with_issues(_materialised(events).filter(~F.coalesce(is_valid_event(), F.lit(False))))


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """How many rows break which rule; a row that breaks two is counted under both."""
    return (
        rejected.select(F.explode("issues").alias("issue"))
        .groupBy(F.col("issue.location")[0].alias("field"), F.col("issue.type").alias("issue_type"))
        .agg(F.count("*").alias("rejected_rows"))
    )


# ---------------------------------------------------------------- JSON messages

_NUMBER_TEXT = r"r'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_INTEGER_TEXT = r"r'^\s*[+-]?\d+(\.0*)?\s*$'"
_TIME_TEXT = (
    r"r'^\d{4}-\d{2}-\d{2}([T _]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$'"
)
_TRUE_TEXT = _listed(["true", "1", "yes", "on", "t", "y"])
_FALSE_TEXT = _listed(["false", "0", "no", "off", "f", "n"])


def _read_field(name: str, data_type: T.DataType) -> tuple[str, str]:
    """SQL for the typed value of a field from its JSON type ``_s_`` and text ``_t_``, and for the
    type issue once that value is a column.

    Lenient like the contract: numeric text is a number, a whole number is an integer.
    """
    kind, text = f"_s_{name}", f"_t_{name}"
    decimal = f"({kind} = 'DOUBLE' OR {kind} LIKE 'DECIMAL%')"
    numeric = f"({kind} = 'BIGINT' OR {decimal})"
    nested = f"({kind} = 'VOID' OR {kind} LIKE 'ARRAY%' OR {kind} LIKE 'OBJECT%')"
    number = f"try_cast({text} AS DOUBLE)"
    if isinstance(data_type, T.StringType):
        wrong = "literal_error" if name in CHOICES else "string_type"
        return f"if({kind} = 'STRING', {text}, NULL)", f"if({kind} <> 'STRING', '{wrong}', NULL)"
    if isinstance(data_type, T.TimestampType):
        # Numbers are seconds since 1970, or milliseconds when they are large.
        seconds = f"if(abs({number}) > 2e10, {number} / 1000, {number})"
        value = (
            f"CASE WHEN {kind} = 'STRING' AND rlike({text}, {_TIME_TEXT}) "
            f"THEN try_cast(replace({text}, '_', 'T') AS TIMESTAMP) "
            f"WHEN {numeric} OR ({kind} = 'STRING' AND rlike({text}, {_NUMBER_TEXT})) "
            f"THEN timestamp_micros(try_cast({seconds} * 1e6 AS BIGINT)) END"
        )
        return value, (
            f"CASE WHEN NOT ({numeric} OR {kind} = 'STRING') THEN 'datetime_type' "
            f"WHEN {name} IS NULL THEN 'datetime_from_date_parsing' END"
        )
    if isinstance(data_type, T.DoubleType):
        value = (
            f"CASE WHEN {numeric} OR ({kind} = 'STRING' AND rlike({text}, {_NUMBER_TEXT})) THEN {number} "
            f"WHEN {kind} = 'BOOLEAN' THEN CAST(CAST({text} AS BOOLEAN) AS DOUBLE) END"
        )
        return value, f"CASE WHEN {nested} THEN 'float_type' WHEN {name} IS NULL THEN 'float_parsing' END"
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        size = data_type.simpleString()
        value = (
            f"CASE WHEN {kind} = 'BIGINT' THEN try_cast({text} AS {size}) "
            f"WHEN {decimal} OR ({kind} = 'STRING' AND rlike({text}, {_INTEGER_TEXT})) "
            f"THEN if({number} = floor({number}), try_cast({number} AS {size}), NULL) "
            f"WHEN {kind} = 'BOOLEAN' THEN CAST(CAST({text} AS BOOLEAN) AS {size}) END"
        )
        return value, (
            f"CASE WHEN {nested} THEN 'int_type' "
            f"WHEN {decimal} AND {number} <> floor({number}) THEN 'int_from_float' "
            f"WHEN {name} IS NULL THEN 'int_parsing' END"
        )
    value = (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN CAST({text} AS BOOLEAN) "
        f"WHEN {kind} IN ('STRING', 'BIGINT') AND lower({text}) IN ({_TRUE_TEXT}) THEN true "
        f"WHEN {kind} IN ('STRING', 'BIGINT') AND lower({text}) IN ({_FALSE_TEXT}) THEN false "
        f"WHEN {decimal} AND {number} IN (0D, 1D) THEN {number} = 1D END"
    )
    return value, (
        f"CASE WHEN {kind} = 'VOID' THEN NULL WHEN {nested} OR ({decimal} AND {number} NOT IN (0D, 1D)) THEN 'bool_type' "
        f"WHEN {kind} IS NOT NULL AND {name} IS NULL THEN 'bool_parsing' END"
    )


def _plain_reading(messages: DataFrame) -> DataFrame:
    """``_text``, the event's fields by one typed read, and ``_plain``: whether that read is the event.

    It is, for one flat object of known keys, each once, whose text fields are texts, whose other fields have the type
    asked for, and which breaks no rule. Whatever is not certain here is left to the full reading.
    """
    texts = [field.name for field in EVENT_SCHEMA if isinstance(field.dataType, (T.StringType, T.TimestampType))]
    wanted = ", ".join(f"{field.name} {'STRING' if field.name in texts else field.dataType.simpleString()}" for field in EVENT_SCHEMA)
    options = "map('columnNameOfCorruptRecord', '_bad', 'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
    decoded = computed_once(messages, {"_text": "if(is_valid_utf8(CAST(value AS STRING)), CAST(value AS STRING), NULL)"})
    # One opening and one closing brace, at the ends: nothing nested, nothing after the object.
    flat = "startswith(_text, '{') AND endswith(_text, '}') AND length(translate(_text, '{}', '')) = length(_text) - 2"
    read = computed_once(
        decoded,
        {
            "_read": f"if({flat}, from_json(_text, '{wanted}, _bad STRING', {options}), NULL)",
            "_keys": f"if({flat}, json_object_keys(_text), NULL)",
        },
    )
    values = {name: f"_read.{name}" for name in EVENT_FIELDS}
    values["event_time"] = f"if(rlike(_read.event_time, {_TIME_TEXT}), try_cast(replace(_read.event_time, '_', 'T') AS TIMESTAMP), NULL)"
    named = computed_once(read, values)
    # A quote inside a text is escaped, so this stands only where the field's own text begins.
    fine = [f"(contains(_text, '\"{name}\":\"') OR contains(_text, '\"{name}\": \"'))" for name in texts]
    fine += ["_read._bad IS NULL", f"size(_keys) = size(array_intersect(_keys, array({_listed(EVENT_FIELDS)})))"]
    fine += [f"{name} IS NOT NULL" for name in EVENT_FIELDS if name not in OPTIONAL_FIELDS]
    fine += [f"NOT coalesce({condition}, false)" for name in EVENT_FIELDS for condition, _ in _rules(name)]
    return computed_once(named, {"_plain": f"coalesce({' AND '.join(fine)}, false)"}).drop("_read", "_keys")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Read ``value BINARY`` rows as events plus ``issues``; other columns pass through.

    A typed read comes first and is all that a message of the contract's plain form needs. Only the others are read field
    by field. ``payload_state`` is ``object``, ``scalar`` (JSON but no object), ``invalid`` (not JSON), ``undecodable``
    or ``null``. Both readings are made in one pass, in which the second sees no text where the first is enough.
    """
    tiers = _plain_reading(messages)
    given = F.struct(*EVENT_FIELDS).alias("_given")
    return _field_reading(tiers.select(*messages.columns, F.expr("if(_plain, NULL, _text)").alias("_text"), "_plain", given))


def _full_reading(messages: DataFrame) -> DataFrame:
    """All messages field by field, without the typed read."""
    decoded = computed_once(
        messages, {"_text": "if(is_valid_utf8(CAST(value AS STRING)), CAST(value AS STRING), NULL)"}
    )
    nothing = F.lit(None).cast(EVENT_SCHEMA).alias("_given")
    return _field_reading(decoded.select("*", F.lit(False).alias("_plain"), nothing))


def _field_reading(tiers: DataFrame) -> DataFrame:
    """The document is parsed once into a VARIANT and each field is read on its own, so that one bad
    field yields its own issue instead of an empty record. Plain rows keep their ``_given`` fields."""
    columns = [name for name in tiers.columns if name not in ("_text", "_plain", "_given")]
    document = computed_once(tiers, {"_doc": "try_parse_json(_text)"})
    fields = {
        "payload_state": (
            "CASE WHEN _plain THEN 'object' WHEN value IS NULL THEN 'null' WHEN _text IS NULL THEN 'undecodable' "
            "WHEN _doc IS NULL THEN 'invalid' WHEN schema_of_variant(_doc) LIKE 'OBJECT%' THEN 'object' "
            "ELSE 'scalar' END"
        )
    }
    for name in EVENT_FIELDS:
        fields[f"_s_{name}"] = f"schema_of_variant(try_variant_get(_doc, '$.{name}', 'variant'))"
        fields[f"_t_{name}"] = f"try_variant_get(_doc, '$.{name}', 'string')"
    values, kinds = {}, {}
    for field in EVENT_SCHEMA:
        value, wrong = _read_field(field.name, field.dataType)
        values[field.name] = f"if(_plain, _given.{field.name}, CAST({value} AS {field.dataType.simpleString()}))"
        absent = "" if field.name in OPTIONAL_FIELDS else f"WHEN _s_{field.name} IS NULL THEN 'missing' "
        kinds[f"_w_{field.name}"] = f"CASE {absent}ELSE {wrong} END" if absent else wrong
    read = computed_once(computed_once(computed_once(document, fields), values), kinds)
    found = ", ".join(
        "CASE "
        + " ".join(
            f"WHEN {condition} THEN named_struct('type', {kind}, 'location', array('{name}'))"
            for condition, kind in [
                (f"_w_{name} IS NOT NULL", f"_w_{name}"),
                *[(condition, f"'{kind}'") for condition, kind in _rules(name)],
            ]
        )
        + " END"
        for name in EVENT_FIELDS
    )
    extra = (
        f"transform(array_except(json_object_keys(_text), array({_listed(EVENT_FIELDS)})), "
        f"key -> named_struct('type', 'extra_forbidden', 'location', array('{MASKED_FIELD}')))"
    )
    # Most messages are fine, which plain conditions find out far faster than building the list.
    fine = [f"_w_{name} IS NULL" for name in EVENT_FIELDS]
    fine += [f"NOT coalesce({condition}, false)" for name in EVENT_FIELDS for condition, _ in _rules(name)]
    present = " + ".join(f"int(_s_{name} IS NOT NULL)" for name in EVENT_FIELDS)
    fine.append(f"size(json_object_keys(_text)) = {present}")
    issues = (
        f"CASE WHEN _plain OR (payload_state = 'object' AND {' AND '.join(fine)}) THEN CAST(array() AS {ISSUES_TYPE}) "
        f"WHEN payload_state = 'object' "
        f"THEN concat(CAST(array_compact(array({found})) AS {ISSUES_TYPE}), CAST({extra} AS {ISSUES_TYPE})) "
        f"WHEN payload_state = 'scalar' THEN CAST(array(named_struct('type', 'model_type', 'location', array())) AS {ISSUES_TYPE}) "
        f"ELSE CAST(array() AS {ISSUES_TYPE}) END"
    )
    checked = computed_once(read, {"issues": issues}).withColumn(
        "accepted", F.expr("payload_state = 'object' AND size(issues) = 0")
    )
    return checked.select(*columns, "payload_state", *EVENT_FIELDS, "issues", "accepted", "_doc")


def accepted_events(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return parsed.filter("accepted").select(*(keep or []), *EVENT_FIELDS)


@F.pandas_udf(T.IntegerType())
def _json_error_offset(values):  # type: ignore[no-untyped-def]
    """Where the JSON text breaks. Only rows that are already known to be invalid get here."""
    import json

    import pandas as pd

    def offset(raw):
        if raw is None:
            return None
        try:
            json.loads(bytes(raw))
        except json.JSONDecodeError as error:
            return error.pos
        return None

    return pd.Series([offset(raw) for raw in values], dtype="Int32")


def dead_letters(parsed: DataFrame, rejected_at: Column, offsets: bool = True) -> DataFrame:
    """Sanitised rejections: hash and size of the payload, four allow-listed fields, no raw content."""
    state = F.col("payload_state")
    rejected = parsed.filter(~F.col("accepted"))
    position = F.lit(None).cast("int")
    if offsets:
        rejected = rejected.withColumn(
            "_offset", _json_error_offset(F.when(state == "invalid", F.col("value")))
        )
        position = F.col("_offset")
    safe, document = [], "_doc"
    for name, length in DEAD_LETTER_FIELDS.items():
        kind = f"schema_of_variant(try_variant_get({document}, '$.{name}', 'variant'))"
        text = f"try_variant_get({document}, '$.{name}', 'string')"
        # to_json of a one-element array quotes and escapes the text; the brackets are cut off.
        quoted = f"to_json(array(substring({text}, 1, {length})))"
        safe.append(
            f"'\"{name}\":' || CASE WHEN {kind} IS NULL OR {kind} = 'VOID' THEN 'null' "
            f"WHEN {kind} = 'STRING' THEN substring({quoted}, 2, length({quoted}) - 2) "
            f"WHEN {kind} NOT LIKE 'ARRAY%' AND {kind} NOT LIKE 'OBJECT%' THEN {text} END"
        )
    safe_fields = F.expr(
        f"if(payload_state = 'object', '{{' || concat_ws(',', {', '.join(safe)}) || '}}', '{{}}')"
    )
    kind = "schema_of_variant(try_variant_get(_doc, '$.transaction_id', 'variant'))"
    identifier = F.expr(
        f"CASE WHEN payload_state = 'object' AND {kind} <> 'VOID' AND {kind} NOT LIKE 'ARRAY%' "
        f"AND {kind} NOT LIKE 'OBJECT%' "
        f"THEN substring(try_variant_get(_doc, '$.transaction_id', 'string'), 1, "
        f"{DEAD_LETTER_FIELDS['transaction_id']}) END"
    )
    found = F.substring(F.to_json(F.struct(F.col("issues").alias("validation_issues"))), 1, 2000)
    return rejected.withColumns(
        {
            "rejected_at": rejected_at.cast("timestamp"),
            "source_topic": F.lit(RAW_TOPIC),
            "error_type": F.when(state.isin("object", "scalar"), "ValidationError")
            .when(state == "invalid", "JSONDecodeError")
            .when(state == "null", "null_payload")
            .otherwise("UnicodeDecodeError"),
            "error_message": F.when(state.isin("object", "scalar"), found)
            .when(
                (state == "invalid") & position.isNotNull(),
                F.concat(F.lit("Invalid JSON at byte offset "), position.cast("string")),
            )
            .when(state == "invalid", "Rejected by JSONDecodeError")
            .when(state == "null", "Rejected by null_payload")
            .otherwise("Rejected by UnicodeDecodeError"),
            "rejected_id": F.when(~identifier.isin("", "false", "0"), identifier),
            "payload": F.struct(
                F.sha2(F.coalesce(F.col("value"), F.lit("null").cast("binary")), 256).alias("payload_sha256"),
                F.coalesce(F.octet_length("value"), F.lit(4)).alias("payload_bytes"),
                safe_fields.alias("safe_fields"),
            ),
        }
    ).select(
        *[name for name in parsed.columns if name in ("topic", "partition", "offset")],
        "rejected_at",
        "source_topic",
        "error_type",
        "error_message",
        F.col("rejected_id").alias("transaction_id"),
        "payload",
    )


# ---------------------------------------------------------------- datasets

def dataset_profile(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum("is_fraud"), F.lit(0)).alias("fraud_rows"),
        F.avg("is_fraud").alias("fraud_rate"),
        F.countDistinct("category").alias("category_count"),
        F.min("trans_date_trans_time").alias("first_time"),
        F.max("trans_date_trans_time").alias("last_time"),
    )


def dataset_checks(rows: DataFrame, manifest: DataFrame | None = None, file: str | None = None) -> DataFrame:
    """One row per check with the number of offending rows; a manifest adds equality checks.

    ``rows`` may be text or typed. Every check is computed in one pass.
    """
    absent = sorted(set(RAW_COLUMNS) - set(rows.columns))
    if absent:
        raise ValueError(f"missing required columns {absent}")
    label, amount, identifier = F.col("is_fraud").cast("string"), F.col("amt").try_cast("double"), F.col("trans_num")
    facts = rows.agg(
        F.count_if(label.isNull() | ~label.isin("0", "1")).alias("bad_label"),
        F.count_if(amount.isNull() | (amount < 0)).alias("bad_amount"),
        F.count_if(identifier.isNull() | (identifier == "")).alias("bad_identifier"),
        F.count("*").alias("row_count"),
        F.date_format(F.min("trans_date_trans_time"), "yyyy-MM-dd HH:mm:ss").alias("first_time"),
        F.date_format(F.max("trans_date_trans_time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"),
    )
    checks = ["bad_label", "bad_amount", "bad_identifier"]
    if manifest is not None:
        # The manifest has one short entry per file.
        facts = facts.withColumn("file", F.lit(file)).join(F.broadcast(manifest), "file").withColumns(
            {
                "wrong_row_count": (F.col("row_count") != F.col("rows")).cast("bigint"),
                "wrong_first_time": (F.col("first_time") != F.col("min_timestamp")).cast("bigint"),
                "wrong_last_time": (F.col("last_time") != F.col("max_timestamp")).cast("bigint"),
            }
        )
        checks += ["wrong_row_count", "wrong_first_time", "wrong_last_time"]
    return facts.select(*checks).unpivot([], checks, "check", "offending_rows")


def require_clean(checks: DataFrame) -> None:
    """Raise when any check found something. The check table has a handful of rows."""
    failed = {row["check"]: row["offending_rows"] for row in checks.filter("offending_rows > 0").collect()}
    if failed:
        raise ValueError(f"dataset checks failed: {failed}")
