"""Registered queries: the raw layer loaded in two overlapping runs, and staging by newest load.

The runs are as of SPLIT and as of the simulation date. What the second run reads again had another
state at the first one (``_EARLIER``); one load of the second run brings rows that no audit lets
through and is repeated an hour later.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import kpi, rawstore, staging
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM_NEXT, WEB_SIM_NEXT, cte, with_ctes
from kpiforge.plans.queries_core import _dbl
from kpiforge.session import checkpoint_dir

SPLIT, WEB_SPLIT = date(2000, 12, 31), date(2024, 1, 15)
FIRST_RUN = datetime.combine(SPLIT + timedelta(days=1), time(2, 0))
SECOND_RUN = datetime.combine(config.SIM_DATE + timedelta(days=1), time(2, 0))
RETRY = SECOND_RUN + timedelta(hours=1)
BUILT = RETRY + timedelta(minutes=30)
#: Rows from here on change between the runs; the overlap of the second run reaches further back.
DRAFT, WEB_DRAFT = datetime.combine(SPLIT - timedelta(days=20), time()), WEB_SPLIT - timedelta(days=3)


def _draft(**values):
    """Rows newer than DRAFT (all rows of entities without a watermark) in an earlier state."""

    def change(df: DataFrame) -> DataFrame:
        new = F.col("_wm").cast("timestamp_ntz") > F.lit(DRAFT) if "_wm" in df.columns else F.lit(True)
        return df.withColumns({c: F.when(new, F.expr(v)).otherwise(F.col(c)) for c, v in values.items()})

    return change


_EARLIER = {
    "orders": _draft(
        order_status="'created'", order_approved_at="NULL", order_delivered_carrier_date="NULL", order_delivered_customer_date="NULL"
    ),
    # greater values than the final ones, so that only the load time can decide
    "order_items": _draft(price="price * 2", shipping_limit_date="shipping_limit_date + INTERVAL 400 DAYS", product_id="product_id + 1"),
    "payments": _draft(payment_type="'voucher'", payment_installments="99", payment_value="payment_value + 1"),
    "customers": _draft(customer_state="'zz'", customer_city="'zz'"),
    "sellers": _draft(seller_state="'zz'"),
    "products": _draft(product_category_name="'zz'", product_photos_qty="product_photos_qty + 1"),
    "reviews": _draft(review_score="'5'"),
    "daily": lambda df: df.withColumns({
        "sessions": F.when(F.col("date") > F.lit(WEB_DRAFT), F.col("sessions") + 1000).otherwise(F.col("sessions")),
        "ad_spend": F.when(F.col("date") > F.lit(WEB_DRAFT), F.col("ad_spend") + 5).otherwise(F.col("ad_spend")),
    }),
}


def _bad_payments(df: DataFrame) -> DataFrame:
    """A tenth of the payments with installments that are no number."""
    return df.withColumn(
        "payment_installments", F.when(F.col("order_id") % 10 == 3, "n/a").otherwise(F.col("payment_installments").cast("string"))
    )


def loaded(ctx: Ctx, names=tuple(rawstore.ENTITIES), faults: bool = False) -> rawstore.RawStore:
    """A raw store with the two runs of the named entities; ``faults``: with the failing load and its retry."""
    store = rawstore.RawStore(ctx.spark, f"{checkpoint_dir(ctx.spark).rstrip('/')}/raw/{uuid.uuid4().hex[:12]}")
    before = Ctx(ctx.tables, sim_date=SPLIT, web_sim_date=WEB_SPLIT)
    rawstore.run_day(store, before, names, FIRST_RUN, _EARLIER)
    failed = rawstore.run_day(store, ctx, names, SECOND_RUN, {"payments": _bad_payments} if faults else None)
    rawstore.run_day(store, ctx, failed, RETRY)
    return store


def _staged(ctx: Ctx, name: str, model) -> DataFrame:
    return model(Ctx(ctx.tables, materialize=False, raw=loaded(ctx, [name])))


@register("newest_orders", with_ctes("SELECT * FROM stg_orders", "stg_orders"))
def newest_orders(ctx: Ctx) -> DataFrame:
    """Orders staged from two overlapping raw loads, the newest load of each key."""
    return _staged(ctx, "orders", staging.stg_orders)


@register("newest_items", with_ctes(f"SELECT {_dbl('price', 'freight_value')} FROM stg_order_items", "stg_order_items"))
def newest_items(ctx: Ctx) -> DataFrame:
    """Line items staged from raw text; the newest load, then the tie-break within a load."""
    return _staged(ctx, "order_items", staging.stg_order_items)


@register("newest_payments", with_ctes(f"SELECT {_dbl('payment_value')} FROM stg_payments", "stg_payments"))
def newest_payments(ctx: Ctx) -> DataFrame:
    """Payments staged from raw text."""
    return _staged(ctx, "payments", staging.stg_payments)


@register("newest_customers", with_ctes("SELECT * FROM stg_customers", "stg_customers"))
def newest_customers(ctx: Ctx) -> DataFrame:
    """Customers staged from the newest full reload."""
    return _staged(ctx, "customers", staging.stg_customers)


@register("newest_sellers", with_ctes("SELECT * FROM stg_sellers", "stg_sellers"))
def newest_sellers(ctx: Ctx) -> DataFrame:
    """Sellers staged from the newest full reload."""
    return _staged(ctx, "sellers", staging.stg_sellers)


@register("newest_products", """
    SELECT p_partkey AS product_id, lower(p_type) AS category_name_pt, CAST(p_size AS INTEGER) AS photos_qty,
           CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS weight_g FROM part""")
def newest_products(ctx: Ctx) -> DataFrame:
    """Products staged from the newest full reload."""
    return _staged(ctx, "products", staging.stg_products)


@register("newest_reviews", with_ctes("SELECT * FROM stg_reviews", "stg_reviews"))
def newest_reviews(ctx: Ctx) -> DataFrame:
    """Reviews staged from raw text, extracted by text comparison with an overlap."""
    return _staged(ctx, "reviews", staging.stg_reviews)


@register("newest_marketing", with_ctes("SELECT marketing_date, channel, sessions, CAST(ad_spend AS DOUBLE) AS ad_spend FROM fct_marketing_daily", "fct_marketing_daily"))
def newest_marketing(ctx: Ctx) -> DataFrame:
    """Marketing days staged from raw text; the second extract has a ``from`` bound."""
    return _staged(ctx, "daily", staging.stg_marketing)


@register("kpi_daily_from_raw", with_ctes(f"SELECT {_dbl('numerator', 'denominator')} FROM kpi_daily", "kpi_daily"))
def kpi_daily_from_raw(ctx: Ctx) -> DataFrame:
    """The daily KPI mart from staged raw tables of all eight entities."""
    return kpi.kpi_daily(Ctx(ctx.tables, raw=loaded(ctx)))


_DAY = timedelta(days=1)
_BOUNDS = f"""CASE entity WHEN 'daily' THEN TIMESTAMP '{WEB_SPLIT + _DAY}' ELSE TIMESTAMP '{SPLIT + _DAY}' END"""
cte("raw_incremental", ["erp_orders", "erp_order_items", "stg_reviews", "stg_marketing"], f"""
    SELECT 'erp' AS source, 'orders' AS entity, order_id AS id, CAST(order_purchase_timestamp AS TIMESTAMP) AS wm FROM erp_orders
    UNION ALL SELECT 'erp', 'order_items', order_id, CAST(_wm AS TIMESTAMP) FROM erp_order_items
    UNION ALL SELECT 'erp', 'payments', o_orderkey, CAST(o_orderdate AS TIMESTAMP) FROM orders WHERE o_orderdate < TIMESTAMP '{SIM_NEXT}'
    UNION ALL SELECT 'legacy', 'reviews', review_id, created_at FROM stg_reviews
    UNION ALL SELECT 'marketing', 'daily', 0, CAST(marketing_date AS TIMESTAMP) FROM stg_marketing
              WHERE marketing_date < DATE '{WEB_SIM_NEXT}'""")
cte("raw_first", ["raw_incremental"], f"""
    SELECT source, entity, count(*) AS n, max(wm) AS wm FROM raw_incremental WHERE wm < {_BOUNDS} GROUP BY ALL""")
cte("raw_second", ["raw_incremental", "raw_first"], f"""
    SELECT source, entity, f.wm AS wm_from, count(*) AS n, max(r.wm) AS wm, count(*) FILTER (WHERE id % 10 = 3) AS bad
    FROM raw_incremental r JOIN raw_first f USING (source, entity)
    WHERE r.wm > f.wm - CASE entity WHEN 'daily' THEN INTERVAL {rawstore.WEB_OVERLAP.days} DAY ELSE INTERVAL {rawstore.OVERLAP.days} DAY END
    GROUP BY ALL""")
_TEXT = "CASE entity WHEN 'daily' THEN strftime({0}, '%Y-%m-%d') ELSE strftime({0}, '%Y-%m-%d %H:%M:%S') END"
_NO = "CAST(NULL AS VARCHAR)"


def _row(number: str, wm_from: str, wm_to: str, rows: str, day: tuple[date, date], at: datetime, error: str = _NO) -> str:
    status = "success" if error == _NO else "failed"
    when = f"TIMESTAMP '{at}'"
    return f"""source || '-' || entity || '-' || '{number}' AS load_id, source, entity, mode,
        CASE entity WHEN 'daily' THEN DATE '{day[1]}' ELSE DATE '{day[0]}' END AS sim_date, {wm_from} AS watermark_from,
        {wm_to} AS watermark_to, {rows} AS rows_loaded, '{status}' AS status, {error} AS error, {when} AS started_at, {when} AS finished_at"""


_NOW = (config.SIM_DATE, config.WEB_SIM_DATE)
_FROM2, _TO2 = _TEXT.format("wm_from"), _TEXT.format("wm")
cte("raw_full", [], """
    SELECT 'erp' AS source, 'customers' AS entity, 'full' AS mode, count(*) AS n FROM customer
    UNION ALL SELECT 'erp', 'sellers', 'full', count(*) FROM supplier
    UNION ALL SELECT 'erp', 'products', 'full', count(*) FROM part""")
cte("raw_log", ["raw_first", "raw_second", "raw_full"], f"""
    SELECT {_row("000001", _NO, _NO, "n", (SPLIT, WEB_SPLIT), FIRST_RUN)} FROM raw_full
    UNION ALL SELECT {_row("000002", _NO, _NO, "n", _NOW, SECOND_RUN)} FROM raw_full
    UNION ALL SELECT {_row("000001", _NO, _TO2, "n", (SPLIT, WEB_SPLIT), FIRST_RUN)} FROM (SELECT *, 'incremental' AS mode FROM raw_first)
    UNION ALL SELECT {_row("000002", _FROM2, _TO2, "n", _NOW, SECOND_RUN)}
              FROM (SELECT *, 'incremental' AS mode FROM raw_second WHERE entity <> 'payments')
    UNION ALL SELECT {_row("000002", _FROM2, _NO, "CAST(NULL AS BIGINT)", _NOW, SECOND_RUN,
                           "'LoadFailed(''payment_installments is no int in ' || bad || ' rows'')'")}
              FROM (SELECT *, 'incremental' AS mode FROM raw_second WHERE entity = 'payments')
    UNION ALL SELECT {_row("000003", _FROM2, _TO2, "n", _NOW, RETRY)}
              FROM (SELECT *, 'incremental' AS mode FROM raw_second WHERE entity = 'payments')""")


@register("raw_load_log", with_ctes("SELECT * FROM raw_log", "raw_log"))
def raw_load_log(ctx: Ctx) -> DataFrame:
    """The log of loads that ran, one of which failed its audit and left the watermark where it was."""
    return loaded(ctx, faults=True).log()


@register("raw_versions", with_ctes(
    """SELECT entity, CAST(sum(n) AS BIGINT) AS raw_rows, count(*) AS loads FROM (
         SELECT entity, n FROM raw_first UNION ALL SELECT entity, n FROM raw_second) GROUP BY entity
       UNION ALL SELECT entity, n, 1 FROM raw_full""", "raw_first", "raw_second", "raw_full"))
def raw_versions(ctx: Ctx) -> DataFrame:
    """Rows and loads that the raw tables show: appended loads all, full reloads the newest alone, failed ones never."""
    store, out = loaded(ctx, faults=True), None
    for e in rawstore.ENTITIES.values():
        one = store.table(e).agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("_load_id").alias("loads"))
        one = one.select(F.lit(e.name).alias("entity"), "raw_rows", "loads")
        out = one if out is None else out.unionByName(one)
    return out


@register("raw_pipeline_status", with_ctes(
    f"""SELECT DATE '{config.SIM_DATE}' AS sim_date, k.latest AS latest_kpi_date, l.ok AS last_successful_load_at,
               l.bad AS last_failed_load_at, TIMESTAMP '{BUILT}' AS built_at,
               CASE WHEN k.latest IS NULL THEN 'down' WHEN k.latest = DATE '{config.SIM_DATE}' THEN 'ok' ELSE 'stale' END AS status
        FROM (SELECT max(kpi_date) AS latest FROM kpi_daily WHERE kpi_key NOT IN ('conversion_rate', 'roas')) k,
             (SELECT max(finished_at) FILTER (WHERE status = 'success') AS ok,
                     max(finished_at) FILTER (WHERE status = 'failed') AS bad FROM raw_log) l""", "kpi_daily", "raw_log"))
def raw_pipeline_status(ctx: Ctx) -> DataFrame:
    """The status row from the loads that ran: no column of it is NULL."""
    from kpiforge.operators.ops import WEB_KPIS

    store = loaded(ctx, faults=True)
    days = kpi.kpi_daily(Ctx(ctx.tables, raw=store)).where(~F.col("kpi_key").isin(WEB_KPIS)).select("kpi_date")
    return rawstore.status(store.log(), days, ctx.sim_date, BUILT)


@register("raw_ingest_checks", with_ctes(
    """SELECT t.source, t.entity, CAST(t.n AS BIGINT) AS rows_present, l.status AS latest_status, CAST(l.rows_loaded AS BIGINT) AS rows_latest, f.failures
       FROM (SELECT source, entity, sum(rows_loaded) FILTER (WHERE status = 'success') AS n FROM raw_log WHERE mode = 'incremental' GROUP BY ALL
             UNION ALL SELECT source, entity, arg_max(rows_loaded, load_id) FROM raw_log WHERE mode = 'full' GROUP BY ALL) t
       JOIN (SELECT *, row_number() OVER (PARTITION BY source, entity ORDER BY finished_at DESC, load_id DESC) AS rn FROM raw_log) l
         ON l.source = t.source AND l.entity = t.entity AND l.rn = 1
       JOIN (SELECT source, entity, count(*) FILTER (WHERE status = 'failed') AS failures FROM raw_log GROUP BY ALL) f
         ON f.source = t.source AND f.entity = t.entity""", "raw_log"))
def raw_ingest_checks(ctx: Ctx) -> DataFrame:
    """Rows that each raw table holds, its newest load, and the loads that failed, from the log that the loads wrote."""
    store, counts = loaded(ctx, faults=True), None
    for e in rawstore.ENTITIES.values():
        one = store.table(e).agg(F.count(F.lit(1)).alias("rows_present")).select(
            F.lit(e.source).alias("source"), F.lit(e.name).alias("entity"), "rows_present"
        )
        counts = one if counts is None else counts.unionByName(one)
    latest = F.max_by(F.struct("status", "rows_loaded"), F.struct("finished_at", "load_id")).alias("l")
    log = store.log().groupBy("source", "entity").agg(latest, F.count_if(F.col("status") == "failed").alias("failures"))
    return counts.join(log, ["source", "entity"]).select(
        "source", "entity", "rows_present", F.col("l.status").alias("latest_status"), F.col("l.rows_loaded").alias("rows_latest"), "failures"
    )
