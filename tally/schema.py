"""Table schemas and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being matched, so they are
# stated here plainly and in their natural order.
# ---------------------------------------------------------------------------

# Raw transaction columns that must be present in an incoming batch.
REQUIRED_COLUMNS = [
    "transaction_id",
    "account_id",
    "description",
    "category",
    "amount",
    "direction",
    "transaction_date",
    "posted_at",
]

ALLOWED_DIRECTIONS = ["inflow", "outflow"]

# The eight transaction categories.
CATEGORIES = [
    "Salaries",
    "Rent",
    "Utilities",
    "Revenue",
    "Inventory",
    "Marketing",
    "Supplies",
    "Miscellaneous",
]

# Decimal places of the smallest unit per currency.
CURRENCY_DECIMALS = {"NGN": 2, "USD": 2, "EUR": 2, "JPY": 0}
DEFAULT_CURRENCY = "NGN"

# Keyword rules, in priority order: the first category with any keyword
# contained in the normalised description wins.
KEYWORD_RULES = [
    ("Salaries", ["salary", "wages", "payroll", "bonus payment", "staff wages",
                  "driver salary", "manager salary", "admin staff", "contractor fee"]),
    ("Rent", ["rent", "lease", "store rental", "shop rent", "co-working",
              "storage unit", "kiosk", "office rent"]),
    ("Utilities", ["electricity", "power", "water bill", "internet", "broadband",
                   "dstv", "energy cost", "heating bill", "waste disposal", "sewage"]),
    ("Revenue", ["cash sale", "pos transaction", "retail sales", "customer transfer",
                 "sales revenue", "online order", "consulting revenue", "refund received"]),
    ("Inventory", ["goods received", "vendor purchase", "inventory restock",
                   "supplier payment", "goods acquisition", "wholesale goods",
                   "bulk product", "retail inventory"]),
    ("Marketing", ["marketing", "banner design", "radio ad", "product launch",
                   "pr services", "facebook ads", "brand campaign", "email marketing"]),
    ("Supplies", ["tools & hardware", "merchandise restock", "medical supplies",
                  "consumables", "safety equipment", "equipment purchase"]),
    ("Miscellaneous", ["accounting", "freight", "permit fee", "customs duty",
                       "conference fee", "shipping cost", "vehicle maintenance", "fuel cost"]),
]

# Descriptions that count as empty after strip + lower.
EMPTY_DESCRIPTIONS = ["", "nil", "nill", "n/a", "none", "-"]

# Confidence of the scored rule categorizer.
RULE_CONFIDENCE = 0.85
FALLBACK_CONFIDENCE = 0.6

# Forecaster constants.
MIN_DAYS_REQUIRED = 90
DEFAULT_LOOKBACK_YEARS = 2
MAX_LOOKBACK_YEARS = 5
INTERVAL_Z = 1.96
SIGMA_FLOOR = 1e-6
FORECAST_CONFIDENCE = 0.95
MAX_HORIZON_DAYS = 90

# Limits of the request-shaped operators.
PAGE_LIMIT_MAX = 100
PAGE_LIMIT_DEFAULT = 50
LOG_LIMIT_MAX = 1000
DESCRIPTION_MAX = 500
TRANSACTION_ID_MAX = 100
BYTES_PER_ROW_ESTIMATE = 500

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------

#: Column for the text of CSV records with too many or too few cells.
BROKEN = "_broken"

RAW_TRANSACTION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in REQUIRED_COLUMNS]
    + [T.StructField("currency", T.StringType(), True)]
)

LEDGER_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("amount", T.LongType(), False),
    T.StructField("direction", T.StringType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("posted_at", T.TimestampNTZType(), True),
])

LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

# The eight columns of listings and exports.
LISTING_COLUMNS = [
    "transaction_id", "account_id", "description", "category",
    "amount", "direction", "transaction_date", "posted_at",
]

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("account_number", T.StringType(), True),
    T.StructField("starting_balance", T.LongType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("last_updated", T.DateType(), True),
])

LOG_SCHEMA = T.StructType([
    T.StructField("record", T.StructType([
        T.StructField("level", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("time", T.StructType([T.StructField("repr", T.StringType())])),
        T.StructField("message", T.StringType()),
        T.StructField("extra", T.StructType([
            T.StructField("extra", T.StructType([
                T.StructField("account_id", T.StringType()),
                T.StructField("user_id", T.StringType()),
            ])),
        ])),
    ])),
    T.StructField("text", T.StringType()),
])
