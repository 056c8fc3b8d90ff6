"""The raw layer: an append log of loads, read by newest load.

Write, audit, publish. A load's rows are conformed to the entity's declared columns, turned into
text and written, with load id and load time, to a folder of their own. One aggregation over what was written audits it:
required columns filled, every value castable to its declared type, the entity's rules kept. Then
one row goes to the load log. The log is what publishes: a raw table is the folders of its entity's
successful loads (of a fully reloaded entity the newest one), so a load that fails, or a driver that
dies half way, leaves nothing that a reader sees. Success moves the watermark to the newest extracted
row; failure keeps it and stores the error.

``newest`` types the text and keeps, per key, the row of the newest load: a partially aggregated
maximum of a struct that starts with the load time, so a key that was loaded very often is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators.loads import conform, stringify
from kpiforge.sources import files, landing

LOG_SCHEMA = (
    "load_id string, source string, entity string, mode string, sim_date date, watermark_from string, watermark_to string, "
    "rows_loaded long, status string, error string, started_at timestamp_ntz, finished_at timestamp_ntz"
)
#: FIXED: an error is stored up to this many characters.
ERROR_CHARS = 2000


class LoadFailed(Exception):
    """The rows of a load broke an audit."""


@dataclass(frozen=True)
class Entity:
    source: str
    name: str
    #: Declared columns in order, with the type that staging reads.
    columns: dict[str, str]
    keys: tuple[str, ...]
    #: (ctx of the run, watermark or None) -> extracted rows; incremental ones bring ``_wm``.
    extract: Callable[[Ctx, str | None], DataFrame]
    mode: str = "incremental"
    #: What else must hold for every row, by name (SQL over the text columns).
    rules: dict[str, str] = field(default_factory=dict)
    #: Decides between rows of one key within one load: greatest first.
    ties: tuple[str, ...] = ()

    @property
    def table(self) -> str:
        return f"{self.source}__{self.name}"


def _since(watermark: str | None, overlap: timedelta) -> datetime | None:
    return datetime.fromisoformat(watermark) - overlap if watermark else None


#: Incremental extracts start this long before the watermark, as rows change after their first load.
OVERLAP, WEB_OVERLAP = timedelta(days=30), timedelta(days=7)


def _reviews(ctx: Ctx, wm: str | None) -> DataFrame:
    since = _since(wm, OVERLAP)
    rows = landing.legacy_reviews(ctx, since.isoformat(sep=" ") if since else None)
    return rows.withColumn("_wm", F.col("review_creation_date"))


def _marketing(ctx: Ctx, wm: str | None) -> DataFrame:
    since = _since(wm, WEB_OVERLAP)
    rows = landing.marketing_daily(ctx, since.date() + timedelta(days=1) if since else None, ctx.web_sim_date)
    return rows.withColumn("_wm", F.col("date"))


ENTITIES = {
    e.name: e
    for e in (
        Entity("erp", "orders", {
            "order_id": "bigint", "customer_id": "bigint", "order_status": "string",
            "order_purchase_timestamp": "timestamp_ntz", "order_approved_at": "timestamp_ntz",
            "order_delivered_carrier_date": "timestamp_ntz", "order_delivered_customer_date": "timestamp_ntz",
            "order_estimated_delivery_date": "timestamp_ntz",
        }, ("order_id",), lambda c, wm: landing.erp_orders(c, _since(wm, OVERLAP)),
            rules={"order_status": "order_status IN (" + ", ".join(f"'{s}'" for s in config.ORDER_STATUSES) + ")"}),
        Entity("erp", "order_items", {
            "order_id": "bigint", "order_item_id": "int", "product_id": "bigint", "seller_id": "bigint",
            "shipping_limit_date": "timestamp_ntz", "price": "double", "quantity": "double", "discount": "double",
            "tax_rate": "double", "return_flag": "string", "line_status": "string",
        }, ("order_id", "order_item_id"), lambda c, wm: landing.erp_order_items(c, _since(wm, OVERLAP)),
            ties=("shipping_limit_date", "product_id", "seller_id", "price", "quantity", "discount", "tax_rate", "return_flag", "line_status")),
        Entity("erp", "payments", {
            "order_id": "bigint", "payment_sequential": "int", "payment_type": "string", "payment_installments": "int",
            "payment_value": "double",
        }, ("order_id", "payment_sequential"), lambda c, wm: landing.erp_payments(c, _since(wm, OVERLAP)),
            rules={"payment_type": "payment_type IN (" + ", ".join(f"'{s}'" for s in config.PAYMENT_TYPES) + ")"}),
        Entity("erp", "customers", {
            "customer_id": "bigint", "customer_unique_id": "bigint", "customer_zip_code_prefix": "string",
            "customer_city": "string", "customer_state": "string",
        }, ("customer_id",), lambda c, wm: landing.erp_customers(c), mode="full"),
        Entity("erp", "sellers", {
            "seller_id": "bigint", "seller_zip_code_prefix": "string", "seller_city": "string", "seller_state": "string",
        }, ("seller_id",), lambda c, wm: landing.erp_sellers(c), mode="full"),
        Entity("erp", "products", {
            "product_id": "bigint", "product_category_name": "string", "product_photos_qty": "int", "product_weight_g": "double",
        }, ("product_id",), lambda c, wm: landing.erp_products(c), mode="full"),
        Entity("legacy", "reviews", {
            "review_id": "bigint", "order_id": "bigint", "review_score": "string", "review_creation_date": "string",
        }, ("review_id", "order_id"), _reviews, rules={"review_score": "try_cast(review_score AS int) BETWEEN 1 AND 5"}),
        Entity("marketing", "daily", {
            "date": "date", "channel": "string", "sessions": "int", "ad_spend": "decimal(12,2)",
        }, ("date", "channel"), _marketing,
            rules={"channel": "channel IN (" + ", ".join(f"'{s}'" for s in config.MARKETING_CHANNELS) + ")"}),
    )
}


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order`` and then by the other columns (a total order)."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (*order, *rest)])


def audits(entity: Entity) -> dict[str, Column]:
    """Name -> condition that every row of a load must meet."""
    out = {f"{k} is missing": F.col(k).isNotNull() for k in entity.keys}
    for c, kind in entity.columns.items():
        if kind != "string":
            out[f"{c} is no {kind}"] = F.col(c).isNull() | F.col(c).try_cast(kind).isNotNull()
    for name, rule in entity.rules.items():
        out[f"{name} breaks its rule"] = F.coalesce(F.expr(rule), F.lit(False))
    return out


class RawStore:
    """Raw tables and their load log below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        path = f"{self.root}/load_log"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(path)

    def _own(self, entity: Entity) -> list:
        """The entity's log rows, oldest first (one per load: a few a day)."""
        own = self.log().where((F.col("source") == entity.source) & (F.col("entity") == entity.name))
        return sorted(own.collect(), key=lambda r: (r["finished_at"], r["load_id"]))

    def watermark(self, entity: Entity) -> str | None:
        """The newest successful watermark."""
        return self._watermark(self._own(entity))

    @staticmethod
    def _watermark(own: list) -> str | None:
        return next((r["watermark_to"] for r in reversed(own) if r["status"] == "success" and r["watermark_to"]), None)

    def load(
        self, ctx: Ctx, entity: Entity, at: datetime | None = None, change: Callable[[DataFrame], DataFrame] | None = None
    ) -> int:
        """One load as of the run's date; returns its rows. ``at`` is the run's time (now, if not given).

        A failure is logged and raised again. ``change`` edits the extract on its way in (another state of the source).
        """
        own = self._own(entity)
        load_id = f"{entity.source}-{entity.name}-{len(own) + 1:06d}"
        path = f"{self.root}/raw/{entity.table}/{load_id}"
        since = self._watermark(own) if entity.mode == "incremental" else None
        started = at or datetime.now()
        try:
            files.delete(self.spark, path)  # what a driver that died has left
            rows, newest = self._write(ctx, entity, since, path, load_id, started, change)
        except Exception as failure:
            self._note(ctx, entity, load_id, since, None, None, "failed", repr(failure)[:ERROR_CHARS], started, at)
            files.delete(self.spark, path)
            raise
        self._note(ctx, entity, load_id, since, newest or since, rows, "success", None, started, at)
        return rows

    def _write(self, ctx, entity, since, path, load_id, started, change):
        extract = entity.extract(ctx, since)
        extract = change(extract) if change else extract
        marked = extract if "_wm" in extract.columns else extract.withColumn("_wm", F.lit(None).cast("string"))
        stringify(conform(marked, [*entity.columns, "_wm"])).select(
            "*", F.lit(load_id).alias("_load_id"), F.lit(started).cast("timestamp_ntz").alias("_loaded_at")
        ).write.parquet(path)
        checks = audits(entity)
        counts = [F.count_if(~ok).alias(str(i)) for i, ok in enumerate(checks.values())]
        found = self._read(entity, [path]).agg(F.count(F.lit(1)).alias("rows"), F.max("_wm").alias("wm"), *counts).first()
        broken = [f"{name} in {found[str(i)]} rows" for i, name in enumerate(checks) if found[str(i)]]
        if broken:
            raise LoadFailed("; ".join(broken))
        return found["rows"], found["wm"]

    def _note(self, ctx, entity, load_id, wm_from, wm_to, rows, status, error, started, at) -> None:
        until = ctx.web_sim_date if entity.source == "marketing" else ctx.sim_date
        row = (load_id, entity.source, entity.name, entity.mode, until, wm_from, wm_to, rows, status, error, started, at or datetime.now())
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/load_log")

    def _read(self, entity: Entity, paths: list[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` string" for c in (*entity.columns, "_wm", "_load_id")) + ", _loaded_at timestamp_ntz"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, entity: Entity) -> DataFrame:
        """The raw table as text: the rows of every published load (a full entity's newest one)."""
        done = [r["load_id"] for r in self._own(entity) if r["status"] == "success"]
        done = done[-1:] if entity.mode == "full" else done
        return self._read(entity, [f"{self.root}/raw/{entity.table}/{i}" for i in done])

    def newest(self, entity: Entity) -> DataFrame:
        """Typed rows, per key the one of the newest load (ties within a load: the entity's order, then all columns)."""
        typed = self.table(entity).select(
            *[F.col(c).cast(kind).alias(c) for c, kind in entity.columns.items()], "_wm", "_load_id", "_loaded_at"
        )
        top = newest_per_key(typed, entity.keys, ["_loaded_at", "_load_id", *entity.ties])
        return top.select(*entity.columns)


def run_day(store: RawStore, ctx: Ctx, names: Sequence[str], at: datetime, changes: dict[str, Callable] | None = None) -> list[str]:
    """Load the named entities as of the run's dates; the names of those that failed (their errors are in the log)."""
    failed = []
    for name in names:
        try:
            store.load(ctx, ENTITIES[name], at, (changes or {}).get(name))
        except LoadFailed:
            failed.append(name)
    return failed


def status(log: DataFrame, latest_kpi: DataFrame, sim_date: date, built_at: datetime) -> DataFrame:
    """One row: as-of date, newest KPI day, last successful and last failed load, build time, health."""
    loads = log.select(F.lit(None).cast("date").alias("kpi_date"), "finished_at", "status")
    days = latest_kpi.select("kpi_date", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("status"))
    one = days.unionByName(loads).agg(
        F.max("kpi_date").alias("latest_kpi_date"),
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_successful_load_at"),
        F.max(F.when(F.col("status") == "failed", F.col("finished_at"))).alias("last_failed_load_at"),
    )
    health = F.when(F.col("latest_kpi_date").isNull(), "down").when(F.col("latest_kpi_date") == F.lit(sim_date), "ok").otherwise("stale")
    return one.select(F.lit(sim_date).alias("sim_date"), "*", F.lit(built_at).cast("timestamp_ntz").alias("built_at"), health.alias("status"))
