"""Schemas, closed vocabularies and thresholds of the ledger engine."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.LongType()),
        T.StructField("txn_id", T.StringType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("statement_id", T.LongType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("amount", MONEY),
        T.StructField("direction", T.StringType()),
        T.StructField("movement_type", T.StringType()),
        T.StructField("is_expense", T.BooleanType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("trust_status", T.StringType()),
        T.StructField("review_status", T.StringType()),
    ]
)

# Vocabularies.
DIRECTIONS = ("debit", "credit")
INCOME_MOVEMENTS = ("income", "salary")
TRANSFER_MOVEMENTS = ("transfer", "credit_card_payment")
NO_MERCHANT_RAILS = ("atm", "cash", "cheque")
MERCHANT_RAILS = ("card", "nach", "ach")
PERSON_RAILS = ("imps", "neft", "rtgs", "cheque", "cash", "unknown")

# Thresholds.
BREAKDOWN_LIMIT = 30
TOP_FOLD = 8
MAD_SCALE = "1.4826"
Z_THRESHOLD = "3.5"
MIN_HISTORY = 5
HISTORY_ROWS = 200
SPIKE_RATIO = "2.0"
SPIKE_MINIMUM = "2000.00"
SPIKE_MONTHS = 3
DUPLICATE_DAYS = 3
FIRST_SEEN_MULTIPLE = "3.0"
MIN_OCCURRENCES = 3
MIN_STABILITY = "0.80"
LAPSE_GRACE_DAYS = 45
LOOKBACK_DAYS = 400
MIN_PROJECTION_DAYS = 7
PAIRING_DAYS = 3
SIMILARITY_FLOOR = 0.92
EXPORT_CAP = 50_000
TOOL_ROWS = 25

#: cadence, days, tolerance, charges a year, calendar months (0: counted in days).
CADENCES = (
    ("weekly", 7, 2, 52, 0),
    ("fortnightly", 14, 3, 26, 0),
    ("monthly", 30, 5, 12, 1),
    ("quarterly", 91, 10, 4, 3),
    ("half_yearly", 182, 15, 2, 6),
    ("annual", 365, 25, 1, 12),
)

#: Upper edges (exclusive) of the amount buckets, and what lies above.
AMOUNT_BUCKETS = (
    (100, "under_100"),
    (500, "100_500"),
    (1_000, "500_1000"),
    (5_000, "1000_5000"),
    (10_000, "5000_10000"),
    (50_000, "10000_50000"),
    (100_000, "50000_100000"),
)
TOP_BUCKET = "over_100000"
