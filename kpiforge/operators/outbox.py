"""insight.v1 rows, the idempotent event outbox and per-consumer delivery state.

State tables (outbox, deliveries) are DataFrames; a run computes the new state from the old
one with joins (anti-join = ``ON CONFLICT DO NOTHING``, left join + CASE = UPDATE) and writes it
to a new version, so nothing is overwritten while it is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.functions.columns import data_class_rank, severity_rank

DIMENSION_LABELS = {"region": "Region", "category": "Kategorie"}


# --- formatting (German number format by unit) --------------------------------------------------
def de_fixed(x: Column, digits: int) -> Column:
    """1234.5 -> '1.234,50'; the value is rounded in decimal first, so the text is exact."""
    fixed = F.format_number(F.round(x.cast("decimal(38,6)"), digits), digits)
    return F.translate(fixed, ",.", ".,")


def format_value(x: Column, unit: Column) -> Column:
    return (
        F.when(x.isNull(), F.lit("–"))
        .when(unit == "BRL", F.concat(de_fixed(x, 2), F.lit(" R$")))
        .when(unit == "ratio", F.concat(de_fixed(x * 100, 2), F.lit(" %")))
        .when(unit == "multiple", F.concat(de_fixed(x, 2), F.lit("×")))
        .when(unit == "days", F.concat(de_fixed(x, 1), F.lit(" Tage")))
        .when(unit == "score", de_fixed(x, 2))
        .when(x == F.floor(x), de_fixed(x, 0))
        .otherwise(de_fixed(x, 2))
    )


def format_signed_pct(x: Column) -> Column:
    sign = F.when(x > 0, F.lit("+")).when(x < 0, F.lit("−")).otherwise(F.lit("±"))
    return F.when(x.isNull(), F.lit("–")).otherwise(F.concat(sign, de_fixed(F.abs(x), 1), F.lit(" %")))


def _scope(dimension: Column, member: Column) -> Column:
    label = F.when(dimension == "region", F.lit(DIMENSION_LABELS["region"])).when(
        dimension == "category", F.lit(DIMENSION_LABELS["category"])
    ).otherwise(dimension)
    return F.when(dimension == "total", F.lit("")).otherwise(F.concat(F.lit(" ("), label, F.lit(" "), member, F.lit(")")))


def summary(d: DataFrame) -> Column:
    """the summary sentence of an insight."""
    scope = _scope(F.col("dimension"), F.col("dimension_value"))
    observed = format_value(F.col("observed"), F.col("unit"))
    daily = F.concat(
        F.col("label"), scope, F.lit(" am "), F.date_format("period_start", "dd.MM.yyyy"), F.lit(": "), observed,
        F.lit(" statt erwartet "), format_value(F.col("expected"), F.col("unit")),
        F.lit(" ("), format_signed_pct(F.col("deviation_pct")), F.lit(")."),
    )
    monthly = F.concat(
        F.col("label"), scope, F.lit(" "), F.date_format("period_start", "MM/yyyy"), F.lit(": "), observed,
        F.lit(", Grenze ±"), format_value(F.col("evidence_threshold"), F.col("unit")), F.lit(" überschritten."),
    )
    return F.when(F.col("method") == "threshold", monthly).otherwise(daily)


def query_ref(d: DataFrame) -> Column:
    """link to the series behind the finding (daily: its 120-day window)."""
    start = F.when(F.col("grain") == "day", F.date_sub("period_start", config.WINDOW_DAYS - 1)).otherwise(F.col("period_start"))
    end = F.when(F.col("grain") == "day", F.col("period_end")).otherwise(F.col("period_start"))
    base = F.concat(
        F.lit("/api/v1/kpis/"), F.col("kpi_key"), F.lit("/series?from="), start.cast("string"), F.lit("&to="), end.cast("string")
    )
    member = F.concat(F.lit("&dim="), F.col("dimension"), F.lit("&value="), F.col("dimension_value"))
    return F.when(F.col("dimension") == "total", base).otherwise(F.concat(base, member))


def entity_refs() -> Column:
    kpi_ref = F.struct(F.lit("kpi").alias("type"), F.concat(F.lit("kpi:"), F.col("kpi_key")).alias("id"))
    member_ref = F.struct(F.col("dimension").alias("type"), F.col("entity_id").alias("id"))
    return F.when(F.col("dimension") == "total", F.array(kpi_ref)).otherwise(F.array(member_ref, kpi_ref))


def dedup_key() -> Column:
    """type:kpi:sorted entity ids:grain:start:end."""
    ids = F.array_join(F.array_sort(F.transform(F.col("entity_refs"), lambda r: r["id"])), ",")
    return F.concat_ws(
        ":", F.col("type"), F.coalesce(F.col("kpi_key"), F.lit("-")), ids, F.col("grain"),
        F.col("period_start").cast("string"), F.col("period_end").cast("string"),
    )


def insight_rows(detections: DataFrame) -> DataFrame:
    """Detections -> outbox rows (columns + insight.v1 JSON payload).

    Ids and creation times are derived from the dedup key and the period (deterministic, so a
    re-run produces the same rows)."""
    d = detections.select(
        "*",
        entity_refs().alias("entity_refs"),
        F.round(F.col("observed"), 6).alias("observed_r"),
        F.round(F.col("expected"), 6).alias("expected_r"),
    )
    d = d.select("*", dedup_key().alias("dedup_key"), summary(d).alias("summary"), query_ref(d).alias("query_ref"))
    h = F.sha2(F.col("dedup_key"), 256)
    event_id = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    created = F.to_timestamp_ntz(F.concat(F.date_add("period_end", 1).cast("string"), F.lit(" 06:00:00")))
    d = d.select("*", event_id.alias("event_id"), created.alias("created_at"))
    payload = F.to_json(
        F.struct(
            F.lit(config.SCHEMA_VERSION).alias("schema_version"),
            F.col("event_id").alias("insight_id"),
            F.lit(config.EVENT_SOURCE).alias("source"),
            F.col("type"),
            F.col("kpi_key").alias("kpi"),
            F.struct(
                F.col("period_start").cast("string").alias("start"),
                F.col("period_end").cast("string").alias("end"),
                F.col("grain"),
            ).alias("period"),
            F.col("severity"),
            F.col("direction"),
            F.col("observed_r").alias("observed"),
            F.col("expected_r").alias("expected"),
            F.col("deviation_pct"),
            F.col("entity_refs"),
            F.struct(
                F.col("method"), F.col("score"), F.col("query_ref"), F.col("evidence_threshold").alias("threshold")
            ).alias("evidence"),
            F.lit(None).cast("string").alias("context_ref"),
            F.col("summary"),
            F.col("data_class"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        )
    )
    return d.select(
        "event_id",
        F.lit("insight").alias("event_type"),
        "dedup_key",
        "type",
        F.col("kpi_key").alias("kpi"),
        "period_start",
        "period_end",
        "severity",
        "data_class",
        "summary",
        payload.alias("payload"),
        "created_at",
    )


def insert_new(candidates: DataFrame, outbox: DataFrame) -> DataFrame:
    """``INSERT ... ON CONFLICT (dedup_key) DO NOTHING RETURNING``: the candidates
    (one per dedup key, the earliest created) that the outbox does not hold yet."""
    first = Window.partitionBy("dedup_key").orderBy("created_at", "event_id")
    unique = candidates.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return unique.join(outbox.select("dedup_key"), "dedup_key", "left_anti")


@dataclass(frozen=True)
class Consumer:
    name: str
    types: tuple[str, ...]
    min_severity: str
    max_data_class: str
    max_age_days: int


# Consumer subscriptions (E14): an email channel and an agent webhook.
CONSUMERS = (
    Consumer("email", ("anomaly", "briefing"), "info", "internal", 2),
    Consumer("hive-mind", ("anomaly", "briefing", "data_quality"), "info", "confidential", 7),
)


def enqueue(events: DataFrame, deliveries: DataFrame, sim_date: date, now, consumers=CONSUMERS) -> DataFrame:
    """One delivery row per (event, consumer) not seen yet; 'pending' when the
    consumer's filter admits it (type, severity, data class, simulated age), else 'skipped'.
    Consumers are configuration (a handful), so they are unrolled into a union instead of a
    cross join with the events."""
    parts = []
    for c in consumers:
        admitted = (
            F.col("type").isin(list(c.types))
            & (severity_rank(F.col("severity")) >= config.SEVERITY_RANK[c.min_severity])
            & (data_class_rank(F.col("data_class")) <= config.DATA_CLASS_RANK[c.max_data_class])
            & (F.col("period_end") >= F.lit(sim_date - timedelta(days=c.max_age_days)))
        )
        parts.append(
            events.select(
                "event_id",
                F.lit(c.name).alias("consumer"),
                F.when(admitted, F.lit("pending")).otherwise(F.lit("skipped")).alias("status"),
            )
        )
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    return new.join(deliveries.select("event_id", "consumer"), ["event_id", "consumer"], "left_anti").select(
        "event_id",
        "consumer",
        "status",
        F.lit(0).alias("attempts"),
        F.lit(now).alias("next_attempt_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp_ntz").alias("delivered_at"),
    )


def due(deliveries: DataFrame, events: DataFrame, now, batch: int = config.BATCH_SIZE) -> DataFrame:
    """Pending deliveries whose next attempt is due, oldest event first, at most
    ``batch`` per consumer."""
    d = deliveries.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now)))
    j = d.join(events.select("event_id", "created_at", "payload"), "event_id")
    order = Window.partitionBy("consumer").orderBy("created_at", "event_id")
    return j.withColumn("batch_pos", F.row_number().over(order)).filter(F.col("batch_pos") <= batch)


def transition(deliveries: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Success -> delivered; failure -> attempts + 1, retry after 1, 2, 4, 8 minutes,
    failed at the 5th attempt. ``outcomes``: (event_id, consumer, success, error)."""
    j = deliveries.join(outcomes, ["event_id", "consumer"], "left")
    attempted = F.col("success").isNotNull()
    attempts = F.when(attempted, F.col("attempts") + 1).otherwise(F.col("attempts"))
    failed_now = attempted & ~F.col("success")
    final = failed_now & (attempts >= config.MAX_ATTEMPTS)
    backoff_min = F.pow(F.lit(2.0), attempts - 1).cast("int") * config.BASE_BACKOFF_MINUTES
    status = (
        F.when(attempted & F.col("success"), F.lit("delivered"))
        .when(final, F.lit("failed"))
        .when(failed_now, F.lit("pending"))
        .otherwise(F.col("status"))
    )
    next_at = F.when(failed_now, F.lit(now) + F.make_interval(mins=backoff_min)).otherwise(F.col("next_attempt_at"))
    return j.select(
        "event_id",
        "consumer",
        status.alias("status"),
        attempts.alias("attempts"),
        next_at.alias("next_attempt_at"),
        F.when(failed_now, F.substring(F.col("error"), 1, 1000)).when(attempted, F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(attempted & F.col("success"), F.lit(now)).otherwise(F.col("delivered_at")).alias("delivered_at"),
        F.when(failed_now & ~final, F.lit("retrying")).when(final, F.lit("failed")).when(
            attempted & F.col("success"), F.lit("delivered")
        ).alias("outcome"),
    )


def dispatch_stats(transitioned: DataFrame, enqueued: DataFrame) -> DataFrame:
    """Per consumer enqueued / delivered / retrying / failed counts of one run."""
    enq = enqueued.groupBy("consumer").agg(F.count(F.lit(1)).alias("enqueued"))
    out = transitioned.groupBy("consumer").agg(
        F.count_if(F.col("outcome") == "delivered").alias("delivered"),
        F.count_if(F.col("outcome") == "retrying").alias("retrying"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    return enq.join(out, "consumer", "full_outer").select(
        "consumer",
        F.coalesce("enqueued", F.lit(0)).alias("enqueued"),
        F.coalesce("delivered", F.lit(0)).alias("delivered"),
        F.coalesce("retrying", F.lit(0)).alias("retrying"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )
