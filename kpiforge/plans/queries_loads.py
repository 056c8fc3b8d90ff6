"""Registered queries: raw loads, clock ledger, payload backfill, CSV scan, streaming outbox."""

from __future__ import annotations

import uuid
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import loads
from kpiforge.plans import queries_more
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM_NEXT, cte, with_ctes
from kpiforge.session import checkpoint_dir
from kpiforge.sources import landing
from kpiforge.streaming import streams

SPLIT = date(2000, 12, 31)
LOAD_TIME = datetime.combine(config.SIM_DATE + timedelta(days=1), time(2, 0))


def _raw_dir(ctx: Ctx, name: str) -> str:
    return f"{checkpoint_dir(ctx.spark).rstrip('/')}/raw/{uuid.uuid4().hex[:12]}/{name}"


_ORDER_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in loads.ERP_ORDER_COLUMNS)


@register("load_append", with_ctes(
    f"""SELECT {_ORDER_TEXT},
               CASE WHEN order_purchase_timestamp < TIMESTAMP '{SPLIT + timedelta(days=1)}' THEN 'erp:orders:{SPLIT}'
                    ELSE 'erp:orders:{config.SIM_DATE}' END AS _load_id,
               CASE WHEN order_purchase_timestamp < TIMESTAMP '{SPLIT + timedelta(days=1)}' THEN TIMESTAMP '{datetime.combine(SPLIT + timedelta(days=1), time(2, 0))}'
                    ELSE TIMESTAMP '{LOAD_TIME}' END AS _loaded_at
        FROM erp_orders""", "erp_orders"))
def load_append(ctx: Ctx) -> DataFrame:
    """Two incremental loads of the orders appended to the raw table (conformed,
    as text, with load id and time); the table read back."""
    path = _raw_dir(ctx, "erp__orders")
    first = landing.erp_orders(ctx, None, SPLIT)
    loads.write_raw(first, path, loads.ERP_ORDER_COLUMNS, f"erp:orders:{SPLIT}",
                    datetime.combine(SPLIT + timedelta(days=1), time(2, 0)), "append")
    second = landing.erp_orders(ctx, datetime.combine(SPLIT + timedelta(days=1), time(0, 0)) - timedelta(microseconds=1), config.SIM_DATE)
    loads.write_raw(second, path, loads.ERP_ORDER_COLUMNS, f"erp:orders:{config.SIM_DATE}", LOAD_TIME, "append")
    return ctx.spark.read.parquet(path)


@register("load_replace", f"""
    SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id, CAST(c.c_custkey AS VARCHAR) AS customer_unique_id,
           lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
           lower(c.c_mktsegment) AS customer_city, n.n_name AS customer_state,
           'erp:customers:{config.SIM_DATE}' AS _load_id, TIMESTAMP '{LOAD_TIME}' AS _loaded_at
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def load_replace(ctx: Ctx) -> DataFrame:
    """Full reload of the customers replaces the previous load."""
    path = _raw_dir(ctx, "erp__customers")
    cust = landing.erp_customers(ctx)
    loads.write_raw(cust, path, loads.ERP_CUSTOMER_COLUMNS, f"erp:customers:{SPLIT}", datetime.combine(SPLIT, time(2, 0)), "overwrite")
    loads.write_raw(cust, path, loads.ERP_CUSTOMER_COLUMNS, f"erp:customers:{config.SIM_DATE}", LOAD_TIME, "overwrite")
    return ctx.spark.read.parquet(path)


def _requests(ctx: Ctx) -> DataFrame:
    days = landing.erp_orders(ctx).select(F.to_date("order_purchase_timestamp").alias("d")).distinct()
    at = lambda h: F.to_timestamp_ntz(F.concat(F.col("d").cast("string"), F.lit(f" 0{h}:00:00")))
    base = days.select(F.concat(F.lit("tick:"), F.col("d").cast("string")).alias("run_key"), F.lit(1).alias("days"), "d")
    return base.select("run_key", "days", at(3).alias("requested_at")).unionByName(
        base.select("run_key", "days", at(4).alias("requested_at"))  # every run retried once
    )


cte("clock_days", ["erp_orders"], "SELECT DISTINCT CAST(order_purchase_timestamp AS DATE) AS d FROM erp_orders")
cte("clock_requests", ["clock_days"], """
    SELECT run_key, days, requested_at FROM (
      SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY requested_at) AS rn FROM (
        SELECT 'tick:' || CAST(d AS VARCHAR) AS run_key, 1 AS days, CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR AS requested_at FROM clock_days
        UNION ALL
        SELECT 'tick:' || CAST(d AS VARCHAR), 1, CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR FROM clock_days) r) x
    WHERE rn = 1""")
cte("clock_ledger_prev", ["clock_days"], f"""
    SELECT 'tick:' || CAST(d AS VARCHAR) AS run_key, CAST(d - 1 AS DATE) AS from_date, d AS to_date
    FROM clock_days WHERE d <= DATE '{SPLIT}'""")
cte("clock_new", ["clock_requests", "clock_ledger_prev"], """
    SELECT *, sum(days) OVER (ORDER BY requested_at, run_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM clock_requests WHERE run_key NOT IN (SELECT run_key FROM clock_ledger_prev)""")


@register("clock_ledger", with_ctes(
    """SELECT r.run_key, l.from_date, l.to_date, false AS is_new
       FROM clock_requests r JOIN clock_ledger_prev l USING (run_key)
       UNION ALL
       SELECT run_key, CAST(b.base + CAST(cum - days AS INTEGER) AS DATE) AS from_date,
              CAST(b.base + CAST(cum AS INTEGER) AS DATE) AS to_date, true AS is_new
       FROM clock_new JOIN (SELECT max(to_date) AS base FROM clock_ledger_prev) b ON true""",
    "clock_requests", "clock_ledger_prev", "clock_new"))
def clock_ledger(ctx: Ctx) -> DataFrame:
    """Exactly-once clock advances: retried runs map to the date recorded for them."""
    req = _requests(ctx)
    days = landing.erp_orders(ctx).select(F.to_date("order_purchase_timestamp").alias("d")).distinct()
    ledger = days.filter(F.col("d") <= F.lit(SPLIT)).select(
        F.concat(F.lit("tick:"), F.col("d").cast("string")).alias("run_key"), F.date_sub("d", 1).alias("from_date"), F.col("d").alias("to_date")
    )
    return loads.advance_clock(req, ledger)


@register("backfill_from_payload")
def backfill_from_payload(ctx: Ctx) -> DataFrame:
    """data_class filled from the JSON payload where the column lacks it (rows-only:
    the payload JSON is produced by Spark)."""
    ev = queries_more.monthly_insights(ctx)
    legacy = ev.withColumn("data_class", F.when(F.col("severity") == "critical", F.col("data_class")))  # pre-migration rows
    return loads.backfill_from_payload(legacy, "data_class")


@register("scan_csv_text", with_ctes(
    f"""SELECT CAST(order_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id,
               CAST(1 + order_id % 5 AS VARCHAR) AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
               CAST(NULL AS VARCHAR) AS review_comment_message,
               strftime(CAST(order_delivered_customer_date AS DATE) + {config.REVIEW_DELAY_DAYS}, '%Y-%m-%d %H:%M:%S') AS review_creation_date,
               CAST(NULL AS VARCHAR) AS review_answer_timestamp
        FROM erp_orders
        WHERE order_delivered_customer_date IS NOT NULL
          AND strftime(CAST(order_delivered_customer_date AS DATE) + {config.REVIEW_DELAY_DAYS}, '%Y-%m-%d %H:%M:%S') < '{SIM_NEXT}'""",
    "erp_orders"))
def scan_csv_text(ctx: Ctx) -> DataFrame:
    """The review export as a BOM-prefixed CSV file, read back all-string with the
    declared columns (missing ones NULL)."""
    path = _raw_dir(ctx, "reviews_csv")
    loads.export_csv(loads.stringify(loads.conform(landing.legacy_reviews(ctx), loads.LEGACY_REVIEW_COLUMNS)), path)
    return loads.read_csv_text(ctx.spark, path, loads.LEGACY_REVIEW_COLUMNS)


_OUTBOX_COLS = "event_id, dedup_key, type, kpi, period_start, period_end, severity, data_class, created_at"


@register("stream_outbox", with_ctes(f"SELECT {_OUTBOX_COLS} FROM insight_rows", "insight_rows"))
def stream_outbox(ctx: Ctx) -> DataFrame:
    """Findings streamed with repeats into an empty outbox, which ends with every finding
    exactly once."""
    cols = _OUTBOX_COLS.split(", ")
    findings = queries_more.monthly_insights(ctx).select(*cols)
    existing = findings.limit(0)
    return streams.stream_outbox(ctx.spark, findings, existing).select(*cols)
