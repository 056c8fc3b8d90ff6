"""Structured Streaming versions of the incremental loads and the web KPIs.

* Sources are file streams over the landing tables (``Trigger.AvailableNow`` processes what
  is there and stops; a re-run resumes from the checkpoint, so loads are restartable).
* Results do not depend on how rows are spread over files or micro-batches. Aggregates are written
  per epoch as partial sums and counts and summed up again when read; deduplication compares
  every batch with the keys that have landed. Rows are never cut off by a watermark within a run.
* Every epoch has a folder of its own (``epoch=<n>``) that a replay overwrites, so an executor or
  driver restart never leaves a half-merged table.
* All output folders live under the session's shared checkpoint directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiforge import config
from kpiforge.functions.columns import day_after_ts
from kpiforge.session import checkpoint_dir, ensure_defaults


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Stream over one landing table (schema taken from the table, never inferred per file)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # The file source needs a directory or a glob; a one-character class globs the single file.
    return reader.parquet(path[:-1] + "[" + path[-1] + "]")


def versioned_sink(out_dir: str):
    """foreachBatch writer: each epoch's rows into their own folder (replay-safe overwrite)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    return write


def read_latest(spark: SparkSession, out_dir: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key across the epochs of a versioned sink."""
    df = spark.read.parquet(out_dir)
    w = Window.partitionBy(*keys).orderBy(F.col("epoch").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "epoch")


def partial_sums(out_dir: str, aggregate):
    """foreachBatch writer: each epoch's own aggregate, to be summed over the epochs when read."""
    write = versioned_sink(out_dir)

    def run(batch: DataFrame, epoch: int) -> None:
        write(aggregate(batch), epoch)

    return run


def insert_new(spark: SparkSession, out_dir: str, key: str):
    """foreachBatch writer: the rows of a batch whose key no other epoch holds, once per key."""

    def run(batch: DataFrame, epoch: int) -> None:
        landed = spark.read.schema(batch.schema.add("epoch", "long")).parquet(out_dir)
        landed = landed.filter(F.col("epoch") != epoch).select(key)  # a replayed epoch is written anew
        batch.dropDuplicates([key]).join(landed, key, "left_anti").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    return run


def run_available_now(query_builder) -> StreamingQuery:
    q = query_builder.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def event_time(df: DataFrame, col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Watermarked event time (the sources carry timezone-free timestamps; the session is UTC)."""
    return df.withColumn("event_time", F.col(col).cast("timestamp")).withWatermark("event_time", delay)


# --- R01: incremental load of the orders ---------------------------------------------------------
def stream_incremental_orders(spark: SparkSession, sf_dir: str, until: date = config.SIM_DATE) -> DataFrame:
    """Land the orders up to the as-of date with a restartable file stream (append sink)."""
    ensure_defaults(spark)
    base = scratch(spark, "orders_raw")
    s = file_stream(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(day_after_ts(until)))
    raw = s.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status_code"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_totalprice").alias("order_total"),
    )
    run_available_now(
        raw.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/_checkpoint")
    )
    return spark.read.parquet(f"{base}/data")


# --- R02: daily web KPIs --------------------------------------------------------------------------
def web_daily(events: DataFrame) -> DataFrame:
    """Sessions, ad spend, orders and revenue per day of event time."""
    money = F.col("value").cast("decimal(12,2)")
    zero = F.lit(0).cast("decimal(12,2)")
    return events.groupBy(F.to_date("ts").alias("kpi_date")).agg(
        F.count_if(F.col("event_type").isin("view", "click")).alias("sessions"),
        F.sum(F.when(F.col("event_type") == "click", money).otherwise(zero)).alias("ad_spend"),
        F.count_if(F.col("event_type") == "purchase").alias("web_orders"),
        F.sum(F.when(F.col("event_type") == "purchase", money).otherwise(zero)).alias("web_revenue"),
    )


def stream_kpi_daily(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """Run the daily web KPI stream over what is there (a given ``base`` resumes an earlier run);
    return conversion rate and ROAS rows in the long KPI format (numerator, denominator, rounded value)."""
    ensure_defaults(spark)
    base = base or scratch(spark, "web_daily")
    events = file_stream(spark, sf_dir, "events")
    run_available_now(
        events.writeStream.foreachBatch(partial_sums(f"{base}/data", web_daily)).option("checkpointLocation", f"{base}/_checkpoint")
    )
    parts = spark.read.parquet(f"{base}/data")
    daily = parts.groupBy("kpi_date").agg(*[F.sum(c).alias(c) for c in ("sessions", "ad_spend", "web_orders", "web_revenue")])
    long = daily.selectExpr(
        "kpi_date",
        "stack(2, 'conversion_rate', cast(web_orders as double), cast(sessions as double), "
        "'roas', cast(web_revenue as double), cast(ad_spend as double)) as (kpi_key, numerator, denominator)",
    )
    return long.select(
        "kpi_date", "kpi_key", "numerator", "denominator",
        F.round(F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)), 6).alias("value"),
    )


# --- R03: dedup against what has landed -----------------------------------------------------------
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an event id are dropped, whichever file or batch they come in; the result is
    counted per day and event type."""
    ensure_defaults(spark)
    base = scratch(spark, "dedup")
    events = file_stream(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    out = f"{base}/data"
    spark.createDataFrame([], events.schema).write.parquet(f"{out}/epoch=-1")
    run_available_now(
        events.writeStream.foreachBatch(insert_new(spark, out, "event_id")).option("checkpointLocation", f"{base}/_checkpoint")
    )
    d = spark.read.parquet(out)
    return d.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"))


# --- R04: idempotent event emission ----------------------------------------------------------------
def stream_outbox(spark: SparkSession, findings: DataFrame, existing: DataFrame, files: int = 8) -> DataFrame:
    """Findings arrive as files (with repeats); each micro-batch inserts, once per dedup key, those
    that the outbox does not hold yet. Returns the final outbox."""
    ensure_defaults(spark)
    base = scratch(spark, "outbox")
    landing, out = f"{base}/landing", f"{base}/outbox"
    findings.unionByName(findings).repartition(files).write.mode("overwrite").parquet(landing)
    existing.write.mode("overwrite").parquet(f"{out}/epoch=-1")
    s = spark.readStream.schema(findings.schema).parquet(landing)
    run_available_now(
        s.writeStream.foreachBatch(insert_new(spark, out, "dedup_key")).option("checkpointLocation", f"{base}/_checkpoint")
    )
    return spark.read.parquet(out).drop("epoch")


# --- R07: sliding per-client counts ---------------------------------------------------------------
def sliding_counts(events: DataFrame) -> DataFrame:
    """Events per user in 1-hour windows sliding every 5 minutes."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "5 minutes").alias("w")
    return events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events",
    )


def stream_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts per user, summed over the micro-batches."""
    ensure_defaults(spark)
    base = scratch(spark, "sliding")
    events = file_stream(spark, sf_dir, "events")
    run_available_now(
        events.writeStream.foreachBatch(partial_sums(f"{base}/data", sliding_counts)).option(
            "checkpointLocation", f"{base}/_checkpoint"
        )
    )
    parts = spark.read.parquet(f"{base}/data")
    return parts.groupBy("user_id", "window_start", "window_end").agg(F.sum("events").alias("events"))
