"""The catalogue's queries as plain SQL over the same Parquet tables."""

from __future__ import annotations

# Fixed values, written out apart from the package, so that a wrong one there shows.
DECLINE_GRID = [
    0.1, 0.125, 0.15000000000000002, 0.17500000000000002, 0.2, 0.225, 0.25, 0.275, 0.30000000000000004, 0.325,
    0.35, 0.375, 0.4, 0.42500000000000004, 0.45000000000000007, 0.475, 0.5, 0.525, 0.55, 0.5750000000000001,
    0.6, 0.625, 0.65, 0.675, 0.7000000000000001, 0.725, 0.75, 0.775, 0.8, 0.8250000000000001, 0.85, 0.875, 0.9,
    0.95,
]
VERIFY_GRID = [
    0.01, 0.025, 0.05, 0.07500000000000001, 0.1, 0.125, 0.15, 0.17500000000000002, 0.2, 0.225, 0.25, 0.275,
    0.30000000000000004, 0.32500000000000007, 0.35000000000000003, 0.37500000000000006, 0.4,
]
SWEEP_DECLINES = [
    0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95,
]
MARGIN_BY_CATEGORY = {
    "entertainment": 0.35,
    "food_dining": 0.3,
    "gas_transport": 0.08,
    "grocery_net": 0.12,
    "grocery_pos": 0.1,
    "health_fitness": 0.38,
    "home": 0.28,
    "kids_pets": 0.32,
    "misc_net": 0.3,
    "misc_pos": 0.25,
    "personal_care": 0.35,
    "shopping_net": 0.3,
    "shopping_pos": 0.22,
    "travel": 0.18,
}
REACQUISITION_BY_BAND = {
    "low": 15.0,
    "medium": 45.0,
    "high": 120.0,
}
FEATURE_LABELS = {
    "amount": "purchase amount",
    "log_amount": "purchase amount",
    "distance_km": "customer-to-merchant distance",
    "transaction_hour": "transaction time",
    "transaction_day_of_week": "day of week",
    "customer_age": "customer age profile",
    "city_population": "customer location size",
    "is_night": "late-night timing",
    "order_margin_pct": "merchant margin",
    "merchant_category": "merchant category",
    "channel": "purchase channel",
    "customer_ltv_band": "customer value band",
}


def _case(column: str, table: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{key}' THEN {_literal(value)}" for key, value in table.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else f"CAST({value!r} AS DOUBLE)"


def _verify(decline: float) -> str:
    """Verify threshold of a what-if decline threshold."""
    half, below = f"{_literal(decline)} * {_literal(0.55)}", f"{_literal(decline)} - {_literal(0.01)}"
    return f"greatest({_literal(0.01)}, least({half}, {below}))"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _r(expression: str, name: str, places: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"


def _n(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def _numeric(expression: str, precision: int, scale: int) -> str:
    return f"CAST(CAST(CAST({expression} AS DECIMAL(28,8)) AS DECIMAL({precision},{scale})) AS DOUBLE)"


RAW = """
raw AS (
  SELECT event_id, user_id, event_type,
    'txn-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS trans_num,
    ts AS at_time,
    CAST(4000000000000000 + user_id AS VARCHAR) AS cc_num,
    'fraud_Merchant ' || CAST(event_id % 97 AS VARCHAR) AS merchant,
    ['entertainment','food_dining','gas_transport','grocery_net','grocery_pos','health_fitness','home',
     'kids_pets','misc_net','misc_pos','personal_care','shopping_net','shopping_pos','travel']
      [CAST((event_id * 7 + user_id) % 14 AS INT) + 1] AS category,
    value AS amt,
    25 + (user_id % 200) / CAST(10 AS DOUBLE) AS lat,
    -120 + (user_id % 400) / CAST(10 AS DOUBLE) AS long,
    25 + (user_id % 200) / CAST(10 AS DOUBLE) + (event_id % 21 - 10) / CAST(10 AS DOUBLE) AS merch_lat,
    -120 + (user_id % 400) / CAST(10 AS DOUBLE) + (event_id % 31 - 15) / CAST(10 AS DOUBLE) AS merch_long,
    500 + (user_id * 7919) % 1000000 AS city_pop,
    DATE '1935-01-01' + CAST((user_id * 9176) % 27000 AS INT) AS dob,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS is_fraud
  FROM events
)"""

EVENTS = f"""
hashed AS (SELECT *, sha256('salt:' || cc_num) AS person FROM raw),
all_events AS (
  SELECT event_id, event_type, trans_num AS transaction_id, at_time AS event_time, person AS customer_id,
    regexp_replace(merchant, '^fraud_', '') AS merchant, category AS merchant_category, amt AS amount,
    lat AS customer_lat, long AS customer_long, merch_lat AS merchant_lat, merch_long AS merchant_long,
    city_pop AS city_population,
    year(at_time) - year(dob) - CASE WHEN month(at_time) < month(dob) OR (month(at_time) = month(dob) AND day(at_time) < day(dob))
      THEN 1 ELSE 0 END AS customer_age,
    CASE WHEN category LIKE '%\\_net' ESCAPE '\\' OR category = 'travel'
      THEN 'card_not_present' ELSE 'card_present' END AS channel,
    {_case('category', MARGIN_BY_CATEGORY)} AS order_margin_pct,
    CASE WHEN CAST('0x' || substr(person, 1, 8) AS BIGINT) % 100 < 50 THEN 'low'
         WHEN CAST('0x' || substr(person, 1, 8) AS BIGINT) % 100 < 85 THEN 'medium' ELSE 'high' END
      AS customer_ltv_band,
    CASE is_fraud WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS fraud_label
  FROM hashed
),
featured_all AS (
  SELECT *, ln(1 + amount) AS log_amount,
    6371.0088 * 2 * atan2(sqrt(chord), sqrt(1 - chord)) AS distance_km,
    hour(event_time) AS transaction_hour, isodow(event_time) - 1 AS transaction_day_of_week,
    CASE WHEN hour(event_time) < 6 OR hour(event_time) >= 22 THEN 1 ELSE 0 END AS is_night
  FROM (SELECT *, least(greatest(
      pow(sin(radians(merchant_lat - customer_lat) / 2), 2)
      + cos(radians(customer_lat)) * cos(radians(merchant_lat))
        * pow(sin(radians(merchant_long - customer_long) / 2), 2), 0), 1) AS chord FROM all_events)
),
issues AS (
  SELECT event_id, event_time, 'amount' AS field,
    CASE WHEN amount <= 0 THEN 'greater_than' ELSE 'less_than_equal' END AS issue_type
  FROM all_events WHERE amount <= 0 OR amount > 1000000
  UNION ALL
  SELECT event_id, event_time, 'customer_age',
    CASE WHEN customer_age < 18 THEN 'greater_than_equal' ELSE 'less_than_equal' END
  FROM all_events WHERE customer_age < 18 OR customer_age > 120
),
featured AS (SELECT * FROM featured_all WHERE event_id NOT IN (SELECT event_id FROM issues))"""

FRICTION = f"(amount * order_margin_pct + {_case('customer_ltv_band', REACQUISITION_BY_BAND)})"
REALIZED = {
    "approve": "CASE WHEN fraud_label THEN amount ELSE 0 END",
    "verify": "3 + CASE WHEN fraud_label THEN amount * CAST(0.15000000000000002 AS DOUBLE) "
    "ELSE friction * CAST(0.08 AS DOUBLE) END",
    "decline": "CASE WHEN fraud_label THEN 0 ELSE friction END",
}
REALIZED_CASE = "CASE WHEN fraud_label IS NULL THEN NULL " + " ".join(
    f"WHEN decision = '{name}' THEN {cost}" for name, cost in REALIZED.items()
) + " END"

SCORED = f"""
probable AS (
  SELECT *, 1 / (1 + exp(-(CAST(-5.2 AS DOUBLE) + 0.55 * log_amount + 0.012 * least(distance_km, 200) + 0.8 * is_night
    + {_case('merchant_category', {'shopping_net': 0.9, 'misc_net': 0.7, 'grocery_pos': 0.35, 'gas_transport': 0.25}, '0')})))
    AS fraud_probability, {FRICTION} AS friction
  FROM featured
),
decided AS (
  SELECT *, CASE WHEN fraud_probability >= 0.5 THEN 'decline' WHEN fraud_probability >= 0.15 THEN 'verify'
    ELSE 'approve' END AS decision FROM probable
),
scored AS (
  SELECT *, {REALIZED_CASE} AS realized_policy_cost, 'heuristic-v0' AS model_version,
    fraud_probability * amount AS expected_cost_approve,
    3 + fraud_probability * amount * CAST(0.15000000000000002 AS DOUBLE) + (1 - fraud_probability) * friction * 0.08
      AS expected_cost_verify,
    (1 - fraud_probability) * friction AS expected_cost_decline
  FROM decided
),
stored AS (
  SELECT event_id, event_type, transaction_id, event_time, merchant, merchant_category, channel, customer_ltv_band,
    fraud_label, decision, model_version, customer_age, city_population, log_amount, distance_km,
    transaction_hour, transaction_day_of_week, is_night, amount AS full_amount, order_margin_pct AS full_margin,
    {_numeric('amount', 14, 2)} AS amount, {_numeric('order_margin_pct', 6, 4)} AS order_margin_pct,
    CAST(CAST(fraud_probability AS DECIMAL(10,8)) AS DOUBLE) AS fraud_probability,
    {_numeric('realized_policy_cost', 14, 4)} AS realized_policy_cost,
    {_numeric('realized_policy_cost', 14, 4)} AS baseline_cost,
    CASE WHEN fraud_label IS NOT NULL THEN CAST(0 AS DOUBLE) END AS estimated_savings
  FROM scored
)"""

STAGED = f"""
friction_rows AS (SELECT *, {FRICTION} AS friction FROM stored),
staged AS (
  SELECT *, CAST(event_time AS DATE) AS transaction_date,
    CASE WHEN fraud_label AND decision IN ('verify', 'decline') THEN 1 ELSE 0 END AS fraud_intervened,
    CASE WHEN NOT fraud_label AND decision = 'decline' THEN 1 ELSE 0 END AS false_decline,
    CASE WHEN NOT fraud_label AND decision = 'verify' THEN 1 ELSE 0 END AS legitimate_verified,
    CASE WHEN fraud_label AND decision = 'decline' THEN amount
         WHEN fraud_label AND decision = 'verify' THEN amount * 0.85 ELSE 0 END AS fraud_caught_value,
    CASE WHEN fraud_label AND decision = 'approve' THEN amount
         WHEN fraud_label AND decision = 'verify' THEN amount * 0.15 ELSE 0 END AS fraud_missed_cost,
    CASE WHEN decision = 'verify' THEN 3.0 + CASE WHEN NOT fraud_label THEN friction * 0.08 ELSE 0 END
         WHEN NOT fraud_label AND decision = 'decline' THEN friction ELSE 0 END AS friction_cost,
    CASE WHEN NOT fraud_label AND decision = 'approve' THEN amount ELSE 0 END AS normal_approval_value
  FROM friction_rows
),
labelled AS (SELECT * FROM staged WHERE fraud_label IS NOT NULL)"""

DAILY_SELECT = """
  SELECT transaction_date AS metric_date, merchant_category, count(*) AS transaction_count,
    CAST(sum(CAST(fraud_label AS INT)) AS BIGINT) AS fraud_transaction_count,
    CAST(sum(fraud_intervened) AS BIGINT) AS fraud_intervened_count,
    CAST(sum(false_decline) AS BIGINT) AS false_decline_count,
    CAST(sum(legitimate_verified) AS BIGINT) AS legitimate_verified_count,
    count(*) FILTER (WHERE decision = 'approve') AS approved_count,
    count(*) FILTER (WHERE decision = 'verify') AS verified_count,
    count(*) FILTER (WHERE decision = 'decline') AS declined_count,
    sum(CASE WHEN fraud_label THEN amount ELSE 0 END) AS gross_fraud_exposure,
    sum(coalesce(realized_policy_cost, 0)) AS policy_cost,
    sum(coalesce(baseline_cost, 0)) AS baseline_cost,
    sum(coalesce(estimated_savings, 0)) AS estimated_savings,
    sum(fraud_caught_value) AS fraud_caught_value, sum(fraud_missed_cost) AS fraud_missed_cost,
    sum(friction_cost) AS friction_cost, sum(normal_approval_value) AS normal_approval_value,
    avg(fraud_probability) AS average_fraud_probability, max(event_time) AS source_freshness
  FROM {source} GROUP BY ALL"""

COUNTS = [
    "transaction_count", "fraud_transaction_count", "fraud_intervened_count", "false_decline_count",
    "legitimate_verified_count", "approved_count", "verified_count", "declined_count",
]
DOLLARS = [
    "gross_fraud_exposure", "policy_cost", "baseline_cost", "estimated_savings", "fraud_caught_value",
    "fraud_missed_cost", "friction_cost", "normal_approval_value",
]
SUM_COUNTS = ", ".join(_n(f"sum({name})", name) for name in COUNTS)
SUM_DOLLARS = ", ".join(_r(f"sum({name})", name) for name in DOLLARS)

WINDOWED = """
ordered AS (
  SELECT *, CAST(fraud_label AS INT) AS is_fraud, count(*) OVER () AS total,
    row_number() OVER (ORDER BY event_time, sha256(transaction_id)) - 1 AS position FROM labelled
),
windowed AS (
  SELECT *, CASE WHEN position < CAST(floor(total * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
    WHEN position < CAST(floor(total * CAST(0.7 AS DOUBLE)) AS BIGINT) + CAST(floor(total * CAST(0.15 AS DOUBLE)) AS BIGINT)
      THEN 'calibration' ELSE 'threshold_validation' END AS "window" FROM ordered
)"""

METRICS = """
metrics AS (
  SELECT event_time AS metric_time, 'transactions_scored' AS metric_name, '{"decision":"' || decision || '"}' AS labels
  FROM scored
  UNION ALL
  SELECT event_time, 'transactions_rejected', '{"error":"ValidationError"}'
  FROM all_events WHERE event_id IN (SELECT event_id FROM issues)
)"""

DELIVERIES = """
base_log AS (SELECT *, 0 AS batch_id FROM stored),
deliveries AS (
  SELECT transaction_id, event_id, customer_ltv_band, decision, batch_id, amount, model_version FROM base_log
  UNION ALL
  SELECT transaction_id, event_id, customer_ltv_band, decision, 1, amount + 1, model_version FROM base_log
  WHERE channel = 'card_not_present'
  UNION ALL
  SELECT transaction_id, event_id, customer_ltv_band, decision, 2, amount + 2,
    CASE WHEN customer_ltv_band = 'high' THEN 'heuristic-v1' ELSE model_version END
  FROM base_log WHERE channel = 'card_not_present' OR customer_ltv_band = 'high'
)"""

# The log of four batches: the scored and the rejected rows of parts of January, and when each part was processed.
LOGGED = """
entered AS (
  SELECT event_id, event_time, 'scored:' || transaction_id || ':' || model_version AS dedupe_key, decision FROM scored
  UNION ALL
  SELECT event_id, event_time, 'rejected:txns.raw:0:' || event_id, NULL FROM all_events WHERE event_id IN (SELECT event_id FROM issues)
),
logged AS (
  SELECT *, (greatest(least(day(event_time), 25), 1) - 1) // 8 AS batch_id,
    [TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-01'][(least(day(event_time), 25) - 1) // 8 + 1] AS processed_at
  FROM entered
)"""


def _with(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)}\n{select}"


_EV = (RAW, EVENTS)
_SC = (*_EV, SCORED)
_ST = (*_SC, STAGED)
_DAILY = (*_ST, f"daily AS ({DAILY_SELECT.format(source='staged')})")

# Threshold search: every grid pair against every row, without the interval shortcut.
_SIX = "CAST(round(CAST({} AS DOUBLE) * 1000000) AS HUGEINT)"


def _costs_cte(source: str) -> str:
    return f"""
priced AS (
  SELECT merchant_category, fraud_probability, fraud_label,
    {_SIX.format(REALIZED['approve'])} AS a, {_SIX.format(REALIZED['verify'])} AS v,
    {_SIX.format(REALIZED['decline'])} AS d
  FROM {source}
),
pairs AS (
  SELECT verify, decline FROM (SELECT unnest([{', '.join(_literal(x) for x in VERIFY_GRID)}]) AS verify) AS vs,
    (SELECT unnest([{', '.join(_literal(x) for x in DECLINE_GRID)}]) AS decline) AS ds WHERE verify < decline
),
pair_costs AS (
  SELECT merchant_category, verify, decline, count(*) AS validation_rows,
    count(*) FILTER (WHERE fraud_label) AS validation_fraud_rows,
    sum(CASE WHEN fraud_probability >= decline THEN d WHEN fraud_probability >= verify THEN v ELSE a END) AS cost
  FROM priced, pairs GROUP BY ALL
),
global_costs AS (
  SELECT verify, decline, sum(cost) AS cost, CAST(sum(validation_rows) AS BIGINT) AS validation_rows,
    CAST(sum(validation_fraud_rows) AS BIGINT) AS validation_fraud_rows
  FROM pair_costs GROUP BY ALL
),
global_best AS (SELECT * FROM global_costs ORDER BY cost, verify, decline LIMIT 1),
own_best AS (
  SELECT * FROM pair_costs
  QUALIFY row_number() OVER (PARTITION BY merchant_category ORDER BY cost, verify, decline) = 1
),
chosen AS (
  SELECT o.merchant_category,
    CASE WHEN o.validation_fraud_rows >= 5 THEN o.verify ELSE g.verify END AS verify,
    CASE WHEN o.validation_fraud_rows >= 5 THEN o.decline ELSE g.decline END AS decline,
    CASE WHEN o.validation_fraud_rows >= 5 THEN o.cost END AS cost,
    o.validation_rows, o.validation_fraud_rows,
    CASE WHEN o.validation_fraud_rows < 5 THEN 'global' END AS fallback
  FROM own_best AS o, global_best AS g
)"""


def _sweep(source: str, declines: list[float]) -> str:
    pairs = ", ".join(f"({_literal(d)}, {_verify(d)})" for d in declines)
    act = "CASE WHEN fraud_probability >= decline_threshold THEN 'decline' " \
        "WHEN fraud_probability >= verify_threshold THEN 'verify' ELSE 'approve' END"
    return f"""
sweep AS (SELECT * FROM (VALUES {pairs}) AS t(decline_threshold, verify_threshold)),
acted AS (SELECT *, {act} AS act FROM sweep LEFT JOIN {source} AS rows ON TRUE),
swept AS (
  SELECT {_r('decline_threshold', 'decline_threshold')}, {_r('verify_threshold', 'verify_threshold')},
    {_r(f"sum(CASE act WHEN 'approve' THEN {REALIZED['approve']} WHEN 'verify' THEN {REALIZED['verify']} ELSE {REALIZED['decline']} END)", 'total_cost')},
    count(*) FILTER (WHERE act = 'approve') AS approve_count,
    count(*) FILTER (WHERE act = 'verify') AS verify_count,
    count(*) FILTER (WHERE act = 'decline') AS decline_count,
    count(*) FILTER (WHERE act = 'decline' AND NOT fraud_label) AS false_declines,
    count(*) FILTER (WHERE act <> 'approve' AND fraud_label) AS fraud_intervened,
    {_r("sum(CASE WHEN fraud_label AND act = 'decline' THEN amount WHEN fraud_label AND act = 'verify' THEN amount * 0.85 ELSE 0 END)", 'fraud_caught_value')},
    {_r("sum(CASE WHEN fraud_label AND act = 'approve' THEN amount WHEN fraud_label AND act = 'verify' THEN amount * 0.15 ELSE 0 END)", 'fraud_missed_cost')},
    {_r("sum(CASE WHEN act = 'verify' THEN 3 + CASE WHEN NOT fraud_label THEN friction * 0.08 ELSE 0 END WHEN act = 'decline' AND NOT fraud_label THEN friction ELSE 0 END)", 'friction_cost')},
    {_r("sum(CASE WHEN act = 'approve' AND NOT fraud_label THEN amount ELSE 0 END)", 'normal_approval_value')}
  FROM acted GROUP BY decline_threshold, verify_threshold
)"""


RANKED = """
by_score AS (
  SELECT least(greatest(fraud_probability, 1e-7), 1 - 1e-7) AS score,
    CAST(count(*) FILTER (WHERE fraud_label) AS DOUBLE) AS pos,
    CAST(count(*) FILTER (WHERE NOT fraud_label) AS DOUBLE) AS neg
  FROM labelled GROUP BY 1
),
ranked AS (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM by_score
)"""

NUMERIC = [
    "amount", "log_amount", "distance_km", "transaction_hour", "transaction_day_of_week", "customer_age",
    "city_population", "order_margin_pct",
]
DISCRETE = ["is_night", "merchant_category", "channel", "customer_ltv_band"]
SHIFT = {
    "amount": "amount * 25 + 1000",
    "log_amount": "ln(1 + (amount * 25 + 1000))",
    "distance_km": "distance_km + 5000",
    "transaction_hour": "(transaction_hour + 12) % 24",
    "city_population": "city_population * 50 + 1000000",
    "merchant_category": "'shifted_demo_category'",
    "channel": "'shifted_demo_channel'",
    "customer_ltv_band": "'shifted_demo_band'",
}


def _drift(shift: bool) -> str:
    now = SHIFT if shift else {}
    side = "event_time < TIMESTAMP '2024-01-16 00:00:00'"
    # The snapshot keeps the full-precision amount and margin.
    numbers = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {side} AS is_ref, "
        f"CASE WHEN {side} THEN CAST({name} AS DOUBLE) ELSE CAST({now.get(name, name)} AS DOUBLE) END AS x FROM snapshot"
        for name in NUMERIC
    )
    words = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {side} AS is_ref, "
        f"CASE WHEN {side} THEN CAST({name} AS VARCHAR) ELSE CAST({now.get(name, name)} AS VARCHAR) END AS x FROM snapshot"
        for name in DISCRETE
    )
    return f"""
snapshot AS (SELECT * EXCLUDE (amount, order_margin_pct), full_amount AS amount, full_margin AS order_margin_pct FROM stored),
numbers AS ({numbers}),
number_counts AS (
  SELECT feature, x, CAST(count(*) FILTER (WHERE is_ref) AS DOUBLE) AS r,
    CAST(count(*) FILTER (WHERE NOT is_ref) AS DOUBLE) AS c FROM numbers GROUP BY ALL
),
shares AS (
  SELECT *, sum(r) OVER w / sum(r) OVER f AS fr, sum(c) OVER w / sum(c) OVER f AS fc,
    lead(x) OVER w - x AS gap, sum(r) OVER f AS reference_rows, sum(c) OVER f AS current_rows
  FROM number_counts WINDOW w AS (PARTITION BY feature ORDER BY x), f AS (PARTITION BY feature)
),
spread AS (SELECT feature, stddev_pop(x) AS sd FROM numbers WHERE is_ref GROUP BY 1),
wasserstein AS (
  SELECT feature, 'wasserstein' AS test, sum(abs(fr - fc) * coalesce(gap, 0)) / max(greatest(sd, 0.001)) AS score,
    max(reference_rows) AS reference_rows, max(current_rows) AS current_rows
  FROM shares JOIN spread USING (feature) GROUP BY feature
),
words AS ({words}),
word_counts AS (
  SELECT feature, x, CAST(count(*) FILTER (WHERE is_ref) AS DOUBLE) AS r,
    CAST(count(*) FILTER (WHERE NOT is_ref) AS DOUBLE) AS c FROM words GROUP BY ALL
),
word_shares AS (
  SELECT *, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM word_counts
),
js AS (
  SELECT feature, 'jensen_shannon' AS test, sqrt(greatest(sum(
      CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END / 2
      + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END / 2), 0)) AS score,
    sum(r) AS reference_rows, sum(c) AS current_rows
  FROM word_shares GROUP BY feature
),
drift AS (
  SELECT feature, test, score, CAST(0.1 AS DOUBLE) AS threshold, score >= 0.1 AS drifted, reference_rows, current_rows
  FROM (SELECT * FROM wasserstein UNION ALL SELECT * FROM js)
)"""


DRIFT_SELECT = f"""SELECT feature, test, {_r('score', 'score')}, {_r('threshold', 'threshold')}, drifted,
  {_n('reference_rows', 'reference_rows')}, {_n('current_rows', 'current_rows')} FROM drift"""

SHOWN = {
    "amount": "'$' || format('{:,.2f}', full_amount)",
    "distance_km": "format('{:,.0f}', distance_km) || ' km'",
    "is_night": "CASE WHEN is_night <> 0 THEN 'yes' ELSE 'no' END",
}
DRIVERS = f"""
contributions AS (
  SELECT transaction_id, decision, merchant_category, amount, fraud_probability, 'amount' AS feature, 1 AS position,
    {SHOWN['amount']} AS value, round_even(0.55 * log_amount, 4) AS contribution FROM stored
  UNION ALL
  SELECT transaction_id, decision, merchant_category, amount, fraud_probability, 'distance_km', 2, {SHOWN['distance_km']},
    round_even(0.012 * least(distance_km, 200), 4) FROM stored
  UNION ALL
  SELECT transaction_id, decision, merchant_category, amount, fraud_probability, 'is_night', 3, {SHOWN['is_night']},
    round_even(0.8 * is_night, 4) FROM stored
),
driver_pool AS (
  SELECT *, abs(contribution) AS strength, bool_or(contribution > 0) OVER (PARTITION BY transaction_id) AS any_raising
  FROM contributions
),
drivers AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY strength DESC, position) - 1 AS rank
  FROM driver_pool WHERE contribution > 0 OR NOT any_raising
),
sentences AS (
  SELECT transaction_id, decision, string_agg(CASE feature WHEN 'amount' THEN 'the ' || value || ' purchase amount'
      WHEN 'distance_km' THEN 'the ' || value || ' customer-to-merchant distance'
      WHEN 'is_night' THEN CASE WHEN value = 'yes' THEN 'the late-night timing' ELSE 'the transaction timing' END END,
      ' and ' ORDER BY rank) AS reasons
  FROM drivers WHERE rank < 2 GROUP BY ALL
),
explained AS (
  SELECT transaction_id, decision, CASE decision
    WHEN 'approve' THEN 'Approved after considering ' || reasons
      || '; estimated risk remained below this segment''s intervention threshold.'
    WHEN 'verify' THEN 'Verification was recommended because ' || reasons || ' raised estimated risk.'
    ELSE 'Declined because ' || reasons || ' raised estimated risk.' END AS explanation_text
  FROM sentences
)"""

ALERT = """SELECT transaction_id, format('{{:.1f}}', fraud_probability * 100) || '%' AS risk, upper(decision) AS decision,
  merchant_category, '$' || format('{{:,.2f}}', amount) AS amount_text,
  'High-risk transaction: ' || transaction_id || ' (' || format('{{:.1f}}', fraud_probability * 100) || '% risk, '
    || upper(decision) || ')' AS message, '{limit:.0%}' AS alert_threshold
FROM scored WHERE fraud_probability >= {limit}"""


def _replay(mode: str) -> str:
    pause = {
        "demo": "greatest(greatest(gap, 0) / 720, 0.001)",
        "realtime": "greatest(least(greatest(gap, 0), 2.0), 0.001)",
    }[mode]
    places = 10 if mode == "demo" else 6
    return f"""SELECT transaction_id, {_time('event_time')} AS event_time, {_r('gap', 'gap_seconds')},
  {_r(f'CASE WHEN gap IS NULL THEN 0 ELSE {pause} END', 'delay_seconds', places)}
FROM (SELECT *, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (ORDER BY event_time, transaction_id)) / 1e6 AS gap
      FROM featured)"""


MESSAGE = """
messages AS (
  SELECT *, '{"transaction_id":"' || transaction_id || '","event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f')
    || '","customer_id":"' || customer_id || '","merchant":"' || merchant || '","merchant_category":"' || merchant_category
    || '","amount":' || CAST(amount AS VARCHAR) || ',"customer_lat":' || CAST(customer_lat AS VARCHAR)
    || ',"customer_long":' || CAST(customer_long AS VARCHAR) || ',"merchant_lat":' || CAST(merchant_lat AS VARCHAR)
    || ',"merchant_long":' || CAST(merchant_long AS VARCHAR) || ',"city_population":' || CAST(city_population AS VARCHAR)
    || ',"customer_age":' || CAST(customer_age AS VARCHAR) || ',"channel":"' || channel || '","order_margin_pct":'
    || CAST(order_margin_pct AS VARCHAR) || ',"customer_ltv_band":"' || customer_ltv_band || '","fraud_label":'
    || CASE WHEN fraud_label IS NULL THEN 'null' WHEN fraud_label THEN 'true' ELSE 'false' END || '}' AS body
  FROM all_events WHERE event_id IN (SELECT event_id FROM issues)
),
issue_lists AS (
  SELECT event_id, string_agg('{"type":"' || issue_type || '","location":["' || field || '"]}', ',' ORDER BY field) AS listed
  FROM issues GROUP BY 1
)"""

ORACLES: dict[str, str] = {
    "txn_features": _with(*_EV, select=f"""
SELECT transaction_id, customer_id, merchant, channel, customer_ltv_band, {_time('event_time')} AS event_time,
  {_r('amount', 'amount')}, {_r('log_amount', 'log_amount')}, {_r('distance_km', 'distance_km')},
  {_n('transaction_hour', 'transaction_hour')}, {_n('transaction_day_of_week', 'transaction_day_of_week')},
  {_n('customer_age', 'customer_age')}, city_population, {_n('is_night', 'is_night')},
  {_r('order_margin_pct', 'order_margin_pct')}, merchant_category FROM featured_all"""),
    "txn_valid": _with(*_EV, select=f"""
SELECT transaction_id, merchant_category, {_r('amount', 'amount')}, {_n('customer_age', 'customer_age')},
  city_population, fraud_label FROM featured"""),
    "txn_rejected_counts": _with(*_EV, select="SELECT field, issue_type, count(*) AS rejected_rows FROM issues GROUP BY ALL"),
    "dead_letters": _with(*_EV, MESSAGE, select="""
SELECT transaction_id, 'txns.raw' AS source_topic, 'ValidationError' AS error_type,
  '{"validation_issues":[' || listed || ']}' AS error_message, sha256(body) AS payload_sha256,
  CAST(strlen(body) AS BIGINT) AS payload_bytes,
  '{"transaction_id":"' || transaction_id || '","event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f')
    || '","merchant_category":"' || merchant_category || '","channel":"' || channel || '"}' AS safe_fields
FROM messages JOIN issue_lists USING (event_id)"""),
    "scored_heuristic": _with(*_SC, select=f"""
SELECT transaction_id, {_r('fraud_probability', 'fraud_probability')}, decision, {_r('0.15', 'verify_threshold')},
  {_r('0.5', 'decline_threshold')}, {_r('realized_policy_cost', 'realized_policy_cost')},
  {_r('realized_policy_cost', 'baseline_cost')}, {_r('realized_policy_cost - realized_policy_cost', 'estimated_savings')},
  model_version, {_r('round_even(0.55 * log_amount, 4)', 'contribution_1')},
  {_r('round_even(0.012 * least(distance_km, 200), 4)', 'contribution_2')},
  {_r('round_even(0.8 * is_night, 4)', 'contribution_3')},
  CASE WHEN is_night = 1 THEN 'true' ELSE 'false' END AS night_value FROM scored"""),
    "expected_costs": _with(*_SC, select="SELECT transaction_id, " + ", ".join(
        _r(f"expected_cost_{name}", f"expected_cost_{name}") for name in ("approve", "verify", "decline")) + " FROM scored"),
    "staged_transactions": _with(*_ST, select=f"""
SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, {_r('amount', 'amount')},
  {_r('realized_policy_cost', 'realized_policy_cost')}, {_n('fraud_intervened', 'fraud_intervened')},
  {_n('false_decline', 'false_decline')}, {_n('legitimate_verified', 'legitimate_verified')},
  {_r('fraud_caught_value', 'fraud_caught_value')}, {_r('fraud_missed_cost', 'fraud_missed_cost')},
  {_r('friction_cost', 'friction_cost')}, {_r('normal_approval_value', 'normal_approval_value')} FROM staged"""),
    "mart_daily_segment": _with(*_DAILY, select="SELECT CAST(metric_date AS VARCHAR) AS metric_date, merchant_category, "
        + ", ".join(COUNTS) + ", " + ", ".join(_r(name, name) for name in [*DOLLARS, "average_fraud_probability"])
        + f", {_time('source_freshness')} AS source_freshness FROM daily"),
    "mart_segment": _with(*_DAILY, select=f"""SELECT merchant_category, {SUM_COUNTS}, {SUM_DOLLARS},
  {_r('CAST(sum(fraud_intervened_count) AS DOUBLE) / nullif(sum(fraud_transaction_count), 0)', 'fraud_intervention_rate')},
  {_r('CAST(sum(false_decline_count) AS DOUBLE) / nullif(sum(transaction_count - fraud_transaction_count), 0)', 'false_decline_rate')},
  {_time('max(source_freshness)')} AS source_freshness FROM daily GROUP BY 1"""),
    "available_window": _with(*_DAILY, select=f"""SELECT CAST(min(metric_date) AS VARCHAR) AS min_date,
  CAST(max(metric_date) AS VARCHAR) AS max_date, {_time('max(source_freshness)')} AS freshness,
  CAST(greatest(min(metric_date), max(metric_date) - 29) AS VARCHAR) AS default_start FROM daily"""),
    "dashboard_totals": _with(*_DAILY, select=f"""SELECT {SUM_COUNTS}, {SUM_DOLLARS},
  {_r('sum(average_fraud_probability)', 'average_fraud_probability')},
  {_r('CAST(sum(fraud_transaction_count) AS DOUBLE) / greatest(sum(transaction_count), 1)', 'fraud_rate')},
  {_r('CAST(sum(fraud_intervened_count) AS DOUBLE) / greatest(sum(fraud_transaction_count), 1)', 'intervention_rate')},
  {_r('CAST(sum(false_decline_count) AS DOUBLE) / greatest(sum(transaction_count) - sum(fraud_transaction_count), 1)', 'false_decline_rate')}
FROM daily"""),
    "daily_kpis_default_window": _with(*_DAILY, select=f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, merchant_category,
  transaction_count, {_r('policy_cost', 'policy_cost')} FROM daily
WHERE metric_date >= (SELECT greatest(min(metric_date), max(metric_date) - 29) FROM daily)"""),
    "daily_costs_long": _with(*_DAILY, select=f"""
SELECT CAST(metric_date AS VARCHAR) AS metric_date, 'policy_cost' AS cost_type, {_r('sum(policy_cost)', 'cost')} FROM daily GROUP BY 1
UNION ALL
SELECT CAST(metric_date AS VARCHAR), 'baseline_cost', {_r('sum(baseline_cost)', 'cost')} FROM daily GROUP BY 1"""),
    "daily_decisions_long": _with(*_DAILY, select=" UNION ALL ".join(
        f"SELECT CAST(metric_date AS VARCHAR) AS metric_date, '{name}' AS decision, {_n(f'sum({name})', 'transactions')} "
        "FROM daily GROUP BY 1" for name in ("approved_count", "verified_count", "declined_count"))),
    "segment_performance": _with(*_DAILY, select="SELECT merchant_category, " + ", ".join(
        _n(f"sum({name})", name) for name in COUNTS[:4]) + ", " + ", ".join(
        _r(f"sum({name})", name) for name in ("policy_cost", "baseline_cost", "estimated_savings")) + f""",
  {_r('CAST(sum(fraud_intervened_count) AS DOUBLE) / greatest(sum(fraud_transaction_count), 1)', 'fraud_intervention_rate')},
  {_r('CAST(sum(false_decline_count) AS DOUBLE) / greatest(sum(transaction_count) - sum(fraud_transaction_count), 1)', 'false_decline_rate')}
FROM daily GROUP BY 1"""),
    "merchant_categories": _with(*_SC, select="SELECT DISTINCT merchant_category FROM scored"),
    "whatif_threshold": _with(*_ST, _sweep("labelled", [0.50]), select="SELECT * FROM swept"),
    "threshold_sweep": _with(*_ST, _sweep("labelled", SWEEP_DECLINES), select="SELECT * FROM swept"),
    "whatif_category": _with(*_ST, """
simulated AS (SELECT * FROM labelled WHERE merchant_category = 'travel')""",
        _sweep("simulated", [0.30]), select="SELECT * FROM swept"),
    "optimal_thresholds": _with(*_ST, WINDOWED, "picked AS (SELECT * FROM windowed WHERE \"window\" = 'threshold_validation')",
        _costs_cte("picked"), select=f"""SELECT merchant_category, {_r('verify', 'verify')}, {_r('decline', 'decline')},
  {_r('round(CAST(cost AS DOUBLE) / 1000000, 2)', 'validation_cost')}, validation_rows, validation_fraud_rows, fallback FROM chosen"""),
    "optimal_global": _with(*_ST, _costs_cte("labelled"), select=f"""SELECT {_r('verify', 'verify')}, {_r('decline', 'decline')},
  {_r('CAST(cost AS DOUBLE) / 1000000', 'validation_cost')}, validation_rows, validation_fraud_rows FROM global_best"""),
    "policy_metrics": _with(*_ST, _costs_cte("labelled"), f"""
redecided AS (
  SELECT l.* EXCLUDE (decision), CASE WHEN fraud_probability >= c.decline THEN 'decline'
    WHEN fraud_probability >= c.verify THEN 'verify' ELSE 'approve' END AS decision
  FROM labelled AS l LEFT JOIN chosen AS c USING (merchant_category)
),
recosted AS (SELECT *, {REALIZED_CASE} AS cost FROM redecided)""", select=f"""
SELECT {_r('sum(cost)', 'policy_cost')}, {_r('sum(CASE WHEN fraud_label THEN amount ELSE 0 END)', 'approve_all_baseline_cost')},
  {_r("avg(CASE WHEN decision <> 'approve' THEN 1.0 ELSE 0.0 END) FILTER (WHERE fraud_label)", 'fraud_intervention_rate')},
  {_r("avg(CASE WHEN decision <> 'approve' THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT fraud_label)", 'false_intervention_rate')},
  count(*) FILTER (WHERE decision = 'approve') AS approve_count,
  count(*) FILTER (WHERE decision = 'verify') AS verify_count,
  count(*) FILTER (WHERE decision = 'decline') AS decline_count,
  {_r('sum(CASE WHEN fraud_label THEN amount ELSE 0 END) - sum(cost)', 'estimated_savings_vs_approve_all')} FROM recosted"""),
    "isotonic_calibration": _with(*_ST, WINDOWED, """
points AS (SELECT fraud_probability AS score, count(*) AS w, sum(is_fraud) AS s FROM windowed
  WHERE "window" = 'calibration' GROUP BY 1),
sums AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(w) OVER (ORDER BY score) AS cw,
  sum(s) OVER (ORDER BY score) AS cs FROM points),
spans AS (SELECT j.i AS j, k.i AS i, CAST(k.cs - j.cs + j.s AS DOUBLE) / (k.cw - j.cw + j.w) AS mean
  FROM sums j JOIN sums k ON j.i <= k.i),
lowest AS (SELECT j, i, min(mean) OVER (PARTITION BY j ORDER BY i DESC) AS low FROM spans),
fitted AS (SELECT i, max(low) AS value FROM lowest GROUP BY 1)""", select=f"""SELECT {_r('score', 'score')},
  {_r('least(greatest(value, 0), 1)', 'calibrated')} FROM fitted JOIN sums USING (i)"""),
    "model_checks": _with(*_EV, WINDOWED.replace("FROM labelled", "FROM all_events WHERE fraud_label IS NOT NULL"), select=f"""
SELECT "window", count(*) AS row_count, {_n('sum(is_fraud)', 'fraud_rows')}, {_n('0', 'not_probabilities')},
  {_n('0', 'not_explained')}, {_n('0', 'not_adding_up')} FROM windowed GROUP BY 1"""),
    "window_metadata": _with(*_ST, WINDOWED, select=f"""SELECT "window", count(*) AS row_count, {_n('sum(is_fraud)', 'fraud_rows')},
  {_r('avg(is_fraud)', 'fraud_rate')}, {_time('min(event_time)')} AS event_time_start, {_time('max(event_time)')} AS event_time_end
FROM windowed GROUP BY 1"""),
    "roc_auc": _with(*_ST, RANKED, select=f"SELECT {_r('sum(neg * (tp - pos + pos / 2)) / max(p * n)', 'roc_auc')} FROM ranked"),
    "average_precision": _with(*_ST, RANKED, select=f"SELECT {_r('sum(pos / p * tp / (tp + fp))', 'average_precision')} FROM ranked"),
    "brier_logloss": _with(*_ST, select=f"""
SELECT {_r('avg(pow(s - y, 2))', 'brier_score')}, {_r('avg(-(y * ln(s) + (1 - y) * ln(1 - s)))', 'log_loss')}
FROM (SELECT least(greatest(fraud_probability, 1e-7), 1 - 1e-7) AS s, CAST(fraud_label AS INT) AS y FROM labelled)"""),
    "best_f1": _with(*_ST, RANKED, select=f"""SELECT {_r('score', 'best_f1_threshold', 8)} FROM ranked
ORDER BY 2 * (tp / (tp + fp)) * (tp / p) / greatest(tp / (tp + fp) + tp / p, 1e-12) DESC, score LIMIT 1"""),
    "positive_class_weight": _with(*_ST, select=f"""SELECT
  {_r('CAST(count(*) FILTER (WHERE NOT fraud_label) AS DOUBLE) / count(*) FILTER (WHERE fraud_label)', 'positive_weight')} FROM labelled"""),
    "drift_features": _with(*_SC, _drift(False), select=DRIFT_SELECT),
    "drift_shifted": _with(*_SC, _drift(True), select=DRIFT_SELECT),
    "drift_summary": _with(*_SC, _drift(False), select=f"""SELECT count(*) FILTER (WHERE drifted) AS drifted_features,
  count(*) AS total_features, {_r('CAST(count(*) FILTER (WHERE drifted) AS DOUBLE) / count(*)', 'drift_share')},
  CASE WHEN CAST(count(*) FILTER (WHERE drifted) AS DOUBLE) / count(*) >= 0.3 THEN 'drifting' ELSE 'ok' END AS health_status FROM drift"""),
    "latest_snapshots": _with(*_SC, select=f"""SELECT count(*) AS row_count, {_time('min(event_time)')} AS current_window_start,
  {_time('max(event_time)')} AS current_window_end, {_r('sum(full_amount)', 'amount')}
FROM stored"""),
    "model_health": _with(*_ST, f"""
reports AS (SELECT max(event_time) AS generated_at, avg(CASE WHEN decision <> 'approve' THEN 1.0 ELSE 0.0 END) AS drift_share
  FROM staged GROUP BY transaction_date),
latest AS (SELECT *, CASE WHEN drift_share >= 0.3 THEN 'drifting' ELSE 'ok' END AS health_status,
  greatest((epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(generated_at)) / 1e6, 0) AS age
  FROM reports ORDER BY generated_at DESC LIMIT 1)""", select=f"""
SELECT {_time('generated_at')} AS generated_at, {_r('drift_share', 'drift_share')}, health_status, {_r('age', 'age_seconds')},
  age > 691200 AS is_stale, CASE WHEN age > 691200 THEN 'stale' ELSE health_status END AS effective_health_status FROM latest"""),
    "upsert_latest": _with(*_SC, DELIVERIES, select=f"""SELECT transaction_id, {_n('batch_id', 'batch_id')}, event_id AS "offset",
  {_r('amount', 'amount')}, decision, model_version FROM deliveries
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY batch_id DESC) = 1"""),
    "upsert_explanations": _with(*_SC, DELIVERIES, select="""SELECT transaction_id, model_version,
  CASE WHEN customer_ltv_band <> 'high' THEN 'text of ' || transaction_id END AS explanation_text,
  CASE WHEN customer_ltv_band <> 'high' THEN '2024-02-01 00:01:00.000000' END AS explanation_generated_at
FROM deliveries QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY batch_id DESC) = 1"""),
    "outbox_new": _with(*_SC, DELIVERIES, select=f"""
SELECT 'scored:' || transaction_id || ':' || model_version AS dedupe_key, transaction_id, {_r('amount', 'amount')},
  {_n('batch_id', 'batch_id')} FROM deliveries WHERE customer_ltv_band <> 'low'
QUALIFY row_number() OVER (PARTITION BY transaction_id, model_version ORDER BY batch_id) = 1"""),
    "pending_outbox": _with(*_SC, select=f"""
SELECT 'scored:' || transaction_id || ':' || model_version AS dedupe_key, {_time('event_time')} AS created_at,
  transaction_id AS message_key FROM scored
WHERE decision <> 'approve' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '2024-01-16 00:00:00'
ORDER BY event_time, dedupe_key LIMIT 100"""),
    "metrics_10s": _with(*_SC, METRICS, select=f"""
SELECT {_time("time_bucket(INTERVAL '10 seconds', metric_time)")} AS window_start, {_r('count(*)', 'total')}
FROM metrics WHERE metric_name = 'transactions_scored' GROUP BY 1"""),
    "failure_rate_1m": _with(*_SC, METRICS, select=f"""
SELECT {_time("time_bucket(INTERVAL '1 minute', metric_time)")} AS window_start,
  {_r("100.0 * nullif(count(*) FILTER (WHERE metric_name = 'transactions_rejected'), 0) / nullif(count(*), 0)", 'failure_percent')}
FROM metrics GROUP BY 1"""),
    "metric_totals": _with(*_SC, METRICS, select=f"SELECT metric_name, labels, {_r('count(*)', 'total')} FROM metrics GROUP BY ALL"),
    "dataset_profile": _with(RAW, select=f"""SELECT count(*) AS row_count, {_n('sum(is_fraud)', 'fraud_rows')},
  {_r('avg(is_fraud)', 'fraud_rate')}, count(DISTINCT category) AS category_count, {_time('min(at_time)')} AS first_time,
  {_time('max(at_time)')} AS last_time FROM raw"""),
    "dataset_check": _with(RAW, select="""
SELECT 'bad_label' AS "check", count(*) FILTER (WHERE is_fraud IS NULL) AS offending_rows FROM raw
UNION ALL SELECT 'bad_amount', count(*) FILTER (WHERE amt < 0) FROM raw
UNION ALL SELECT 'bad_identifier', count(*) FILTER (WHERE trans_num = '') FROM raw"""),
    "dq_reconcile": _with(*_DAILY, select=f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, merchant_category,
  {_r('policy_cost', 'policy_cost')}, {_r('fraud_missed_cost + friction_cost', 'reconstructed_policy_cost')} FROM daily
WHERE abs(policy_cost - (fraud_missed_cost + friction_cost)) > 0.02"""),
    "dq_reconcile_labelled": _with(*_ST, f"daily AS ({DAILY_SELECT.format(source='labelled')})", select="""
SELECT count(*) AS failures FROM daily WHERE abs(policy_cost - (fraud_missed_cost + friction_cost)) > 0.02"""),
    "dq_unique": _with(*_DAILY, select="""SELECT count(*) AS failures FROM
  (SELECT 1 FROM daily GROUP BY metric_date, merchant_category HAVING count(*) > 1)"""),
    "dq_columns": _with(*_DAILY, select=" UNION ALL ".join(
        [f"SELECT 'scored_transactions' AS table_name, 'not_null' AS test, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS failures FROM scored"
         for c in ("transaction_id", "event_time", "decision")]
        + ["SELECT 'scored_transactions', 'unique', 'transaction_id', count(*) - count(DISTINCT transaction_id) FROM scored",
           "SELECT 'scored_transactions', 'accepted_values', 'decision', count(*) FILTER (WHERE decision NOT IN ('approve','verify','decline')) FROM scored"]
        + [f"SELECT 'mart_daily_segment_kpis', 'not_null', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM daily"
           for c in ("metric_date", "merchant_category", "fraud_caught_value", "fraud_missed_cost", "friction_cost", "normal_approval_value")]
        + [f"SELECT 'mart_segment_kpis', '{t}', '{c}', 0 FROM (SELECT 1) AS one"
           for t, c in (("not_null", "merchant_category"), ("not_null", "transaction_count"), ("unique", "merchant_category"))])),
    "recent_transactions": _with(*_SC, select=f"""SELECT transaction_id, {_time('event_time')} AS event_time, merchant,
  {_r('amount', 'amount')}, {_r('fraud_probability', 'fraud_probability', 8)}, decision, model_version FROM stored
WHERE merchant_category = 'shopping_net' ORDER BY stored.event_time DESC, transaction_id LIMIT 200"""),
    "simulation_rows": _with(*_SC, select=f"""SELECT transaction_id, {_r('amount', 'amount')}, {_r('order_margin_pct', 'order_margin_pct')},
  customer_ltv_band, fraud_label, {_r('fraud_probability', 'fraud_probability', 8)}, {_r('realized_policy_cost', 'current_policy_cost')}
FROM stored WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' AND merchant_category = 'grocery_pos'
  AND fraud_label IS NOT NULL"""),
    "high_risk_alerts": _with(*_SC, select=ALERT.format(limit=0.9)),
    "alerts_half": _with(*_SC, select=ALERT.format(limit=0.5)),
    "replay_schedule": _with(*_EV, select=_replay("demo")),
    "replay_realtime": _with(*_EV, select=_replay("realtime")),
    "risk_drivers": _with(*_SC, DRIVERS, select=f"""SELECT transaction_id, rank, feature, {_case('feature', FEATURE_LABELS)} AS label,
  value, CASE WHEN contribution > 0 THEN 'raised risk' ELSE 'lowered risk' END AS effect, {_r('strength', 'strength')} FROM drivers
WHERE rank < 3"""),
    "template_explanations": _with(*_SC, DRIVERS, select="""SELECT transaction_id, decision, explanation_text,
  CASE WHEN len(string_split(explanation_text, ' ')) > 30 THEN 'explanation exceeds word limit' END AS sentence_problem FROM explained"""),
    "explanation_inputs": _with(*_SC, DRIVERS, f"""
listed AS (
  SELECT transaction_id, string_agg('{{"feature":"' || feature || '","label":"' || {_case('feature', FEATURE_LABELS)}
    || '","value":"' || value || '","effect":"' || CASE WHEN contribution > 0 THEN 'raised risk' ELSE 'lowered risk' END
    || '","strength":' || CAST(strength AS VARCHAR) || '}}', ',' ORDER BY rank) AS items
  FROM drivers WHERE rank < 3 GROUP BY 1
)""", select="""
SELECT transaction_id, '{"transaction":{"amount_usd":' || CAST(amount AS VARCHAR) || ',"merchant_category":"'
  || replace(merchant_category, '_', ' ') || '","risk_percent":' || CAST(round_even(fraud_probability * 100, 1) AS VARCHAR)
  || ',"decision":"' || decision || '"},"top_risk_drivers":[' || items || ']}' AS explanation_input
FROM stored JOIN listed USING (transaction_id)"""),
    "retention_counts": _with(*_SC, METRICS, select="""
SELECT 'scored_transactions' AS table_name, count(*) FILTER (WHERE event_time < TIMESTAMP '2024-04-15' - INTERVAL 730 DAY) AS expired_rows FROM scored
UNION ALL SELECT 'rejected_transactions', count(*) FILTER (WHERE event_time < TIMESTAMP '2024-04-15' - INTERVAL 30 DAY)
  FROM all_events WHERE event_id IN (SELECT event_id FROM issues)
UNION ALL SELECT 'pipeline_metrics', count(*) FILTER (WHERE metric_time < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY) FROM metrics
UNION ALL SELECT 'outbox', count(*) FILTER (WHERE decision = 'approve' AND event_time < TIMESTAMP '2024-04-15' - INTERVAL 7 DAY) FROM scored"""),
    "training_cap": _with(RAW, select=f"""SELECT trans_num, {_time('at_time')} AS trans_date_trans_time, {_r('amt', 'amt')} FROM raw"""),
    "stream_outbox": _with(*_SC, """
keyed AS (
  SELECT event_id, 'scored:' || transaction_id || ':' || model_version AS dedupe_key, 'txns.scored' AS topic, transaction_id AS message_key FROM scored
  UNION ALL
  SELECT event_id, 'rejected:txns.raw:0:' || event_id, 'txns.rejected', transaction_id FROM all_events WHERE event_id IN (SELECT event_id FROM issues)
)""", select=f"""SELECT dedupe_key, topic, message_key, {_time("TIMESTAMP '2024-03-01 00:00:00'")} AS created_at FROM keyed
UNION ALL
SELECT dedupe_key, topic, message_key, {_time("TIMESTAMP '2024-03-09 00:00:00'")} FROM keyed
JOIN all_events USING (event_id) WHERE channel = 'card_not_present'"""),
    "outbox_publication": _with(*_SC, LOGGED, select=f"""SELECT dedupe_key, batch_id,
  CASE WHEN batch_id < 2 THEN {_time("TIMESTAMP '2024-01-20 00:00:00'")} WHEN batch_id = 2 THEN {_time("TIMESTAMP '2024-02-02 00:00:00'")} END AS published_at,
  CAST(0 AS BIGINT) AS attempts FROM logged"""),
    "retention_run": _with(*_SC, LOGGED, """
counted AS (
  SELECT 'scored_transactions' AS table_name, processed_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY AS gone FROM logged WHERE decision IS NOT NULL
  UNION ALL
  SELECT 'rejected_transactions', processed_at < TIMESTAMP '2024-04-15' - INTERVAL 30 DAY FROM logged WHERE decision IS NULL
  UNION ALL
  SELECT 'pipeline_metrics', processed_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY FROM (SELECT DISTINCT batch_id, processed_at, decision FROM logged)
  UNION ALL
  SELECT 'outbox', batch_id < 3 FROM logged
  UNION ALL
  SELECT 'model_drift_reports', max(event_time) < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY FROM scored GROUP BY CAST(event_time AS DATE)
)""", select="""SELECT table_name, count(*) AS rows_before, count(*) FILTER (WHERE gone) AS expired_rows, count(*) FILTER (WHERE NOT gone) AS rows_after
FROM counted GROUP BY 1"""),
    "boosted_stump": _with(*_EV, f"""
known AS (SELECT *, CAST(fraud_label AS INT) AS y FROM all_events WHERE fraud_label IS NOT NULL),
weighed AS (SELECT *, CASE WHEN y = 1 THEN (SELECT CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / count(*) FILTER (WHERE y = 1) FROM known) ELSE 1 END AS w FROM known),
inputs AS (
  SELECT 0 AS f, 'transaction_hour' AS feature, CAST(hour(event_time) AS DOUBLE) AS x, y, w FROM weighed
  UNION ALL SELECT 1, 'transaction_day_of_week', isodow(event_time) - 1, y, w FROM weighed
  UNION ALL SELECT 2, 'order_margin_pct', order_margin_pct, y, w FROM weighed
  UNION ALL SELECT 3, 'is_card_present', CAST(channel = 'card_present' AS INT), y, w FROM weighed
  UNION ALL SELECT 4, 'is_low', CAST(customer_ltv_band = 'low' AS INT), y, w FROM weighed
  UNION ALL SELECT 5, 'is_medium', CAST(customer_ltv_band = 'medium' AS INT), y, w FROM weighed
),
valued AS (SELECT f, feature, x, sum(w * (0.5 - y)) AS g, sum(w * 0.25) AS h FROM inputs GROUP BY ALL),
ordered AS (
  SELECT f, feature, x, sum(g) OVER below AS gl, sum(h) OVER below AS hl, sum(g) OVER every AS ga, sum(h) OVER every AS ha
  FROM valued WINDOW below AS (PARTITION BY f ORDER BY x), every AS (PARTITION BY f)
),
gains AS (SELECT *, (gl * gl / (hl + 2) + (ga - gl) * (ga - gl) / (ha - hl + 2) - ga * ga / (ha + 2)) / 2 AS gain
  FROM ordered WHERE hl >= 3 AND ha - hl >= 3)""", select=f"""
SELECT feature, {_r('x', 'border')}, {_r('gain', 'gain')}, {_r('-0.06 * gl / (hl + 2)', 'left_value')}, {_r('-0.06 * (ga - gl) / (ha - hl + 2)', 'right_value')},
  {_r('hl', 'left_hessian')}, {_r('ha - hl', 'right_hessian')} FROM gains ORDER BY gain DESC, f, x LIMIT 1"""),
    "explanation_log": _with(*_SC, DRIVERS, select=f"""SELECT transaction_id, model_version, CAST(0 AS BIGINT) AS run_id, explanation_text,
  {_time("TIMESTAMP '2024-01-09 00:00:00'")} AS explanation_generated_at FROM explained JOIN scored USING (transaction_id)
UNION ALL
SELECT transaction_id, 'heuristic-v1', 2, explanation_text, {_time("TIMESTAMP '2024-01-25 00:00:00'")}
FROM explained JOIN scored USING (transaction_id) WHERE customer_ltv_band = 'high'"""),
    "drift_statistics": _with(*_SC, _drift(False), """
whole AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS rr, sum(c) OVER (PARTITION BY feature) AS cc FROM word_shares),
top_share AS (SELECT feature, arg_max(p, x) AS p, arg_max(q, x) AS q, max(rr) AS rr, max(cc) AS cc, count(*) AS n FROM whole GROUP BY 1)""", select=f"""
SELECT feature, 'wasserstein' AS test, {_r('score', 'statistic')} FROM wasserstein
UNION ALL SELECT feature, 'wasserstein', {_r('abs(p - q) / greatest(sqrt(p * (1 - p)), 0.001)', 'statistic')} FROM top_share WHERE feature = 'is_night'
UNION ALL SELECT feature, 'ks', {_r('abs(p - q)', 'statistic')} FROM top_share WHERE feature = 'is_night'
UNION ALL SELECT feature, 'ks', {_r('max(abs(fr - fc))', 'statistic')} FROM shares GROUP BY 1
UNION ALL SELECT feature, 'jensen_shannon', {_r('score', 'statistic')} FROM js
UNION ALL SELECT feature, 'chi_square', {_r('sum((c - p * cc) * (c - p * cc) / (p * cc))', 'statistic')} FROM whole GROUP BY 1
UNION ALL SELECT feature, 'z', {_r('(p - q) / sqrt((p * rr + q * cc) / (rr + cc) * (1 - (p * rr + q * cc) / (rr + cc)) * (1 / rr + 1 / cc))', 'statistic')}
  FROM top_share WHERE n <= 2"""),
    "drift_ks": _with(*_SC, _drift(False), select="""SELECT feature, 'ks' AS test, CAST(0.05 AS DOUBLE) AS threshold,
  CAST(reference_rows AS BIGINT) AS reference_rows, CAST(current_rows AS BIGINT) AS current_rows FROM drift"""),
    "card_csv": _with(RAW, select=f"""SELECT trans_num, {_time("date_trunc('second', at_time)")} AS trans_date_trans_time, cc_num, category, {_r('amt', 'amt')},
  CAST(city_pop AS BIGINT) AS city_pop, CAST(dob AS VARCHAR) AS dob, CAST(is_fraud AS BIGINT) AS is_fraud FROM raw"""),
    "manifest_check": _with(RAW, select="""
SELECT 'bad_label' AS "check", count(*) FILTER (WHERE is_fraud IS NULL) AS offending_rows FROM raw
UNION ALL SELECT 'bad_amount', count(*) FILTER (WHERE amt < 0) FROM raw
UNION ALL SELECT 'bad_identifier', count(*) FILTER (WHERE trans_num = '') FROM raw
UNION ALL SELECT 'wrong_row_count', CAST(count(*) <> count(*) + 1 AS BIGINT) FROM raw
UNION ALL SELECT 'wrong_first_time', count(*) FILTER (WHERE at_time < (SELECT min(at_time) FROM raw)) FROM raw
UNION ALL SELECT 'wrong_last_time', count(*) FILTER (WHERE at_time > (SELECT max(at_time) FROM raw)) FROM raw"""),
    "dead_letter_kinds": _with(*_EV, """
turned AS (SELECT event_id, event_id % 50 AS turn, event_id IN (SELECT event_id FROM issues) AS wrong FROM all_events)""", select="""
SELECT event_id AS "offset",
  CASE turn WHEN 1 THEN 'JSONDecodeError' WHEN 3 THEN 'null_payload' WHEN 4 THEN 'UnicodeDecodeError' ELSE 'ValidationError' END AS error_type,
  CASE turn WHEN 1 THEN 'Invalid JSON at byte offset 1' WHEN 2 THEN '{"validation_issues":[{"type":"model_type","location":[]}]}'
    WHEN 3 THEN 'Rejected by null_payload' WHEN 4 THEN 'Rejected by UnicodeDecodeError' END AS error_message,
  CAST(CASE turn WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 11 END AS BIGINT) AS payload_bytes
FROM turned WHERE turn BETWEEN 1 AND 5 OR wrong"""),
    "outbound_payloads": _with(*_SC, select=f"""SELECT transaction_id AS message_key, 'txns.scored' AS topic, merchant_category, decision, model_version,
  {_r('amount', 'amount')}, {_r('fraud_probability', 'fraud_probability')}, {_r('transaction_hour', 'snapshot_hour')}, {_r('amount', 'snapshot_amount')} FROM scored"""),
    "json_snapshots": _with(*_SC, select=f"""SELECT transaction_id, {_r('full_amount', 'amount')},
  CAST(CASE WHEN customer_ltv_band <> 'high' THEN customer_age END AS BIGINT) AS customer_age, channel, CAST(is_night AS BIGINT) AS is_night
FROM stored WHERE customer_ltv_band <> 'low'"""),
    "score_breaks": _with(*_SC, select="""SELECT merchant_category, count(*) AS broken_rows FROM scored
WHERE merchant_category IN ('travel', 'home', 'kids_pets', 'misc_net', 'misc_pos') GROUP BY 1"""),
    "threshold_contract": _with(*_SC, """
segments AS (SELECT merchant_category, round(avg(fraud_probability), 6) AS verify, count(*) % 3 AS n FROM scored GROUP BY 1)""", select=f"""
SELECT merchant_category, {_r('verify', 'verify')}, {_r('verify * n', 'decline')}, NOT (verify >= 0 AND verify < verify * n AND verify * n <= 1) AS broken FROM segments"""),
    "rejected_routing": _with(*_EV, select="""SELECT transaction_id, CAST(1 AS BIGINT) AS dead_letters, CAST(0 AS BIGINT) AS decisions, TRUE AS routed
FROM all_events WHERE event_id IN (SELECT event_id FROM issues)"""),
    "ranked_contributions": _with(*_SC, """
parts AS (
  SELECT transaction_id, 'amount' AS feature, 0.55 * log_amount AS v FROM scored
  UNION ALL SELECT transaction_id, 'distance_km', 0.012 * least(distance_km, 200) FROM scored
  UNION ALL SELECT transaction_id, 'is_night', CAST(0.8 AS DOUBLE) * is_night FROM scored
)""", select="""SELECT transaction_id, string_agg(feature, ',' ORDER BY v, feature) AS by_value,
  array_to_string(list(feature ORDER BY abs(v) DESC, feature)[1:2], ',') AS largest FROM parts GROUP BY 1"""),
    "drift_reference": _with(*_EV, """
earliest AS (SELECT * FROM featured_all WHERE fraud_label IS NOT NULL ORDER BY event_time, transaction_id LIMIT 500)""", select=f"""
SELECT count(*) AS row_count, {_r('sum(amount)', 'amount')}, CAST(sum(customer_age) AS BIGINT) AS ages, {_r('max(distance_km)', 'farthest')} FROM earliest"""),
    "preprocessed": _with(*_EV, "known AS (SELECT * FROM featured_all WHERE fraud_label IS NOT NULL)", select=" UNION ALL ".join(
        f"SELECT '{name}' AS feature, {_r(f'avg({name})', 'mean')}, {_r(f'stddev_samp({name})', 'deviation')} FROM known" for name in [*NUMERIC, "is_night"])
        + "".join(f" UNION ALL SELECT '{name}_' || {name}, {_r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM known)', 'mean')}, NULL FROM known GROUP BY {name}"
            for name in ("merchant_category", "channel", "customer_ltv_band"))),
    "class_windows": _with(*_ST, WINDOWED, select="""SELECT "window", sum(is_fraud) > 0 AND sum(is_fraud) < count(*) AS both_classes FROM windowed GROUP BY 1"""),
}
