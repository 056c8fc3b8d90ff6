"""Raw-layer loads and control tables.

* ``conform`` / ``stringify`` / ``write_raw``: a source extract is conformed to the declared
  columns (extras dropped, missing ones NULL, declared order), turned into text (NULL stays
  NULL) and written with its load id and load time -- appended (incremental entities) or
  replacing the table (full entities). Writes go to the shared folder, one folder per table.
* ``advance_clock``: exactly-once ledger of simulated-day advances keyed by run key.
* ``backfill_from_payload``: fill a column from the JSON payload where it differs.
* ``export_csv`` / ``read_csv_text``: a legacy file export with a UTF-8 BOM and its all-string,
  explicitly typed read-back.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# FIXED: declared columns of the ERP entities (raw layer).
ERP_ORDER_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
]
ERP_CUSTOMER_COLUMNS = ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"]
LEGACY_REVIEW_COLUMNS = [
    "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
    "review_creation_date", "review_answer_timestamp",
]


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the declared columns in declared order; missing ones as NULL text."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns])


def stringify(df: DataFrame) -> DataFrame:
    """Every value as text; NULL stays NULL."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def write_raw(df: DataFrame, path: str, columns: Sequence[str], load_id: str, loaded_at: datetime, mode: str) -> DataFrame:
    """Conform, stringify and write with load metadata; returns the written rows."""
    out = stringify(conform(df, columns)).select(
        "*", F.lit(load_id).alias("_load_id"), F.lit(loaded_at).cast("timestamp_ntz").alias("_loaded_at")
    )
    out.write.mode(mode).parquet(path)
    return out


def advance_clock(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each run key advances the clock exactly once. Known keys keep their recorded
    date; new keys (first request wins) advance by their days in request order, starting at
    the ledger's latest date. The ledger is a sequence of runs, so its size is the number of
    runs, not of data rows."""
    first = Window.partitionBy("run_key").orderBy("requested_at")
    req = requests.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    known = req.join(ledger.select("run_key", "from_date", "to_date"), "run_key")
    new = req.join(ledger.select("run_key"), "run_key", "left_anti")
    base = ledger.agg(F.max("to_date")).scalar()  # uncorrelated scalar subquery
    order = Window.orderBy("requested_at", "run_key").rowsBetween(Window.unboundedPreceding, 0)
    steps = new.select("*", F.sum("days").over(order).alias("cum"), base.alias("base"))
    advanced = steps.select(
        "run_key",
        F.date_add("base", (F.col("cum") - F.col("days")).cast("int")).alias("from_date"),
        F.date_add("base", F.col("cum").cast("int")).alias("to_date"),
        F.lit(True).alias("is_new"),
    )
    return known.select("run_key", "from_date", "to_date", F.lit(False).alias("is_new")).unionByName(advanced)


def backfill_from_payload(events: DataFrame, column: str) -> DataFrame:
    """``column := payload->>column`` where the payload has the key and the values
    differ (NULL-safe)."""
    from_payload = F.get_json_object(F.col("payload"), f"$.{column}")
    has_key = F.array_contains(F.json_object_keys(F.col("payload")), column)
    changed = has_key & ~F.col(column).eqNullSafe(from_payload)
    return events.select(
        "event_id",
        F.when(changed, from_payload).otherwise(F.col(column)).alias(column),
        changed.alias("updated"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Legacy export: header line prefixed with a UTF-8 byte-order mark."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-string schema given explicitly (never inferred); the header, BOM included, is
    skipped, so the first column keeps its declared name."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
