"""Fixed values and the mapping from the test tables to the retail roles.

Everything here is a plain parameter; no logic. Values marked FIXED must stay exactly as they
are because results (KPI keys, thresholds, accepted values) are defined by them.
"""

from __future__ import annotations

from datetime import date

# --- Simulation clock --------------------------------------------------------------------
# The order domain is replayed up to SIM_DATE (data after it is invisible / masked). The web
# event domain (marketing, sessions) lives in a different period and has its own as-of date.
SIM_DATE = date(2001, 8, 1)
WEB_SIM_DATE = date(2024, 1, 30)

# Calendar source (dim_date) range, inclusive.
CALENDAR_START = date(1992, 1, 1)
CALENDAR_END = date(2030, 12, 31)

# --- Role mapping (test tables -> retail source semantics) -------------------------------
# Order status letters of the `orders` table mapped to the ERP's final status.
ORDER_STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "canceled"}
# Promised delivery: purchase + this many days.
PROMISE_DAYS = 60
# Review of a delivered order is written this many days after delivery.
REVIEW_DELAY_DAYS = 3

# FIXED: payment types accepted by the ERP, assigned from the order priority digit 1..5.
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]

# FIXED: marketing channels; a web user belongs to channel number user_id % 4.
MARKETING_CHANNELS = ["organic", "paid_search", "paid_social", "email"]

# Category translation table (source language -> English). Two categories of the part table
# (medium, small) are left untranslated on purpose, so the fallback of the lookup is used.
CATEGORY_TRANSLATION = [
    ("economy", "budget_goods"),
    ("promo", "promotions"),
    ("standard", "standard_goods"),
    ("large", "bulky_goods"),
]

# --- FIXED: order states, severity / data-class ranks -----------------------------------
ORDER_STATUSES = ["created", "approved", "invoiced", "processing", "shipped", "delivered", "canceled", "unavailable"]
CANCELED_STATUSES = ["canceled", "unavailable"]
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}
DATA_CLASS_RANK = {"public": 0, "internal": 1, "confidential": 2}

# --- FIXED: KPI keys produced by the marts -----------------------------------------------
DAILY_KPI_KEYS = [
    "gmv",
    "orders_count",
    "avg_order_value",
    "items_per_order",
    "freight_ratio",
    "cancellation_rate",
    "delivery_time_avg_days",
    "on_time_rate",
    "review_score_avg",
    "new_customers",
    "returning_customers",
    "conversion_rate",
    "roas",
]
MONTHLY_KPI_KEYS = DAILY_KPI_KEYS + ["budget_deviation"]
DIMENSIONS = ["total", "region", "category"]
AGGREGATIONS = ["sum", "ratio"]

# --- FIXED: anomaly detector constants ----------------------------------------------------
WEEKLY_PERIOD = 7
WINDOW_DAYS = 120
LEVEL_DAYS = 14
SCALE_FLOOR = 0.01
WEEKDAY_WEEKS = 4
MAD_TO_SIGMA = 1.4826
CRITICAL_FACTOR = 1.5
TOP_MEMBERS = 5
MEMBER_THRESHOLD_FACTOR = 1.5
THRESHOLD_CANDIDATES = [3.5, 4.0, 4.5, 5.0, 5.5, 6.0]
MAX_FALSE_ALARMS_PER_MONTH = 2.0

# --- FIXED: outbox -------------------------------------------------------------------------
SCHEMA_VERSION = "insight.v1"
EVENT_SOURCE = "kpiforge"
MAX_ATTEMPTS = 5
BASE_BACKOFF_MINUTES = 1
BATCH_SIZE = 100

# --- Query layer defaults -----------------------------------------------------------------
DEFAULT_DAYS = 90
DEFAULT_MONTHS = 12
