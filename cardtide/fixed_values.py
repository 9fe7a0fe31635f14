"""Values that decide results. They are fixed: changing one changes every dollar figure."""

# Business assumptions.
MARGIN_BY_CATEGORY = {
    "entertainment": 0.35,
    "food_dining": 0.30,
    "gas_transport": 0.08,
    "grocery_net": 0.12,
    "grocery_pos": 0.10,
    "health_fitness": 0.38,
    "home": 0.28,
    "kids_pets": 0.32,
    "misc_net": 0.30,
    "misc_pos": 0.25,
    "personal_care": 0.35,
    "shopping_net": 0.30,
    "shopping_pos": 0.22,
    "travel": 0.18,
}
CATEGORIES = sorted(MARGIN_BY_CATEGORY)
REACQUISITION_BY_BAND = {"low": 15.0, "medium": 45.0, "high": 120.0}
BANDS = ["low", "medium", "high"]
CHANNELS = ["card_present", "card_not_present"]
DECISIONS = ["approve", "verify", "decline"]
VERIFY_COST = 3.0
VERIFY_CATCH_RATE = 0.85
VERIFY_ABANDON_RATE = 0.08

# The twelve model features, numeric ones first.
NUMERIC_FEATURES = [
    "amount",
    "log_amount",
    "distance_km",
    "transaction_hour",
    "transaction_day_of_week",
    "customer_age",
    "city_population",
    "is_night",
    "order_margin_pct",
]
CATEGORICAL_FEATURES = ["merchant_category", "channel", "customer_ltv_band"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# The scoring heuristic used when no model is trained.
HEURISTIC_INTERCEPT = -5.2
HEURISTIC_LOG_AMOUNT = 0.55
HEURISTIC_PER_KM = 0.012
HEURISTIC_KM_CAP = 200.0
HEURISTIC_NIGHT = 0.8
HEURISTIC_CATEGORY_BOOST = {
    "shopping_net": 0.9,
    "misc_net": 0.7,
    "grocery_pos": 0.35,
    "gas_transport": 0.25,
}
HEURISTIC_VERSION = "heuristic-v0"
DEFAULT_VERIFY = 0.15
DEFAULT_DECLINE = 0.50

# Candidate thresholds as exact doubles. 0.15 and 0.15000000000000002 form a legal pair.
VERIFY_GRID = [
    0.01, 0.025, 0.05, 0.07500000000000001, 0.1, 0.125, 0.15, 0.17500000000000002, 0.2, 0.225, 0.25,
    0.275, 0.30000000000000004, 0.32500000000000007, 0.35000000000000003, 0.37500000000000006, 0.4,
]
DECLINE_GRID = [
    0.1, 0.125, 0.15000000000000002, 0.17500000000000002, 0.2, 0.225, 0.25, 0.275,
    0.30000000000000004, 0.325, 0.35, 0.375, 0.4, 0.42500000000000004, 0.45000000000000007, 0.475,
    0.5, 0.525, 0.55, 0.5750000000000001, 0.6, 0.625, 0.65, 0.675, 0.7000000000000001, 0.725, 0.75,
    0.775, 0.8, 0.8250000000000001, 0.85, 0.875, 0.9, 0.95,
]
# Fraud rows that a segment needs for thresholds of its own, decline thresholds of the sweep.
MIN_SEGMENT_FRAUD = 5
SWEEP_DECLINES = [x / 100 for x in range(5, 96, 5)]

# Fixed value.
EARTH_RADIUS_KM = 6371.0088

# Message topics.
RAW_TOPIC = "txns.raw"
SCORED_TOPIC = "txns.scored"
REJECTED_TOPIC = "txns.rejected"

# Fixed value: probability from which a transaction raises an alert.
HIGH_RISK_THRESHOLD = 0.90

# Dead letters keep only these fields, cut to these lengths.
DEAD_LETTER_FIELDS = {
    "transaction_id": 64,
    "event_time": 40,
    "merchant_category": 64,
    "channel": 32,
}

# Days each table is kept, by its time column.
RETENTION_DAYS = {
    "scored_transactions": ("processed_at", 730),
    "rejected_transactions": ("rejected_at", 30),
    "pipeline_metrics": ("metric_time", 90),
    "model_drift_reports": ("generated_at", 180),
    "outbox": ("published_at", 7),
}

# Replay pacing. None means no delay at all.
REPLAY_SPEED = {"realtime": 1.0, "demo": 720.0, "max": None}
REPLAY_FLOOR_SECONDS = 0.001
REPLAY_REALTIME_CAP_SECONDS = 2.0

# Drift monitoring.
DRIFT_MIN_ROWS = 500
DRIFT_SHARE = 0.30
DRIFT_HEALTH_MAX_AGE_SECONDS = 691_200
DRIFT_DISTANCE_LIMIT = 0.1
DRIFT_P_LIMIT = 0.05
DRIFT_SMALL_SAMPLE = 1000
DRIFT_FEW_VALUES = 5

# Wording of explanations.
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
# %s is the shown value; phrases without it do not show the value.
FEATURE_PHRASES = {
    "amount": "the %s purchase amount",
    "log_amount": "the purchase size",
    "distance_km": "the %s customer-to-merchant distance",
    "transaction_hour": "the %s transaction time",
    "transaction_day_of_week": "the %s timing",
    "customer_age": "the customer age profile",
    "city_population": "the customer location size",
    "is_night": "the transaction timing",
    "order_margin_pct": "the merchant margin",
    "merchant_category": "the %s merchant category",
    "channel": "the %s purchase channel",
    "customer_ltv_band": "the %s customer value band",
}
NIGHT_PHRASE = "the late-night timing"
NO_DRIVER_PHRASE = "the combined transaction signals"
APPROVE_SENTENCE = (
    "Approved after considering %s; estimated risk remained below this segment's intervention threshold."
)
VERIFY_SENTENCE = "Verification was recommended because %s raised estimated risk."
DECLINE_SENTENCE = "Declined because %s raised estimated risk."
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MAX_SENTENCE_WORDS = 30
JARGON_PATTERN = r"(?i)\b(shap|coefficient|prompt|feature contribution)\b"
