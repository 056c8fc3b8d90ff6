"""Registered queries: global trailing counts and rows behind an earlier run's watermark."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.context import Ctx
from kpiforge.functions.ordering import trailing_total
from kpiforge.plans.catalog import register
from kpiforge.streaming import late
from kpiforge.streaming.streams import scratch

DAY_US = 86_400 * 1_000_000
#: FIXED: sessions that all guests together may open in 24 hours.
PER_DAY = 300


@register("trailing_day_counts", f"""
    SELECT event_id, ts, n AS events_last_day, n > {PER_DAY} AS over_limit FROM (
      SELECT event_id, ts, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS n FROM events) c""")
def trailing_day_counts(ctx: Ctx) -> DataFrame:
    """Events of all clients in the 86 400 s up to each event, by a running total over ranges of time."""
    e = ctx.tables.events.select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    n = trailing_total(e.select("event_id", "t_us"), "event_id", "t_us", DAY_US, "events_last_day")
    return e.join(n, "event_id").select("event_id", "ts", "events_last_day", (F.col("events_last_day") > PER_DAY).alias("over_limit"))


FIRST_UNTIL, DELAY = datetime.combine(date(2024, 1, 20), time()), timedelta(days=2)
#: Every tenth event of the first run's time arrives with the second run only.
LATE = "ts < TIMESTAMP_NTZ'{0}' AND event_id % 10 <> 0"


@register("late_events", f"""
    WITH first AS (SELECT * FROM events WHERE ts < TIMESTAMP '{FIRST_UNTIL}' AND event_id % 10 <> 0),
    mark AS (SELECT max(ts) - INTERVAL {DELAY.days} DAY AS w FROM first),
    all_ AS (SELECT event_type, 0 AS run, false AS late, ts FROM first
             UNION ALL SELECT event_type, 1, coalesce(ts < w, false), ts FROM events, mark
                       WHERE NOT (ts < TIMESTAMP '{FIRST_UNTIL}' AND event_id % 10 <> 0))
    SELECT run, event_type, late, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM all_ GROUP BY run, event_type, late""")
def late_events(ctx: Ctx) -> DataFrame:
    """The events in two runs; rows older than the watermark that the first run left are kept apart by the second."""
    folder, state = scratch(ctx.spark, "late_in"), scratch(ctx.spark, "late")
    early = F.coalesce(F.expr(LATE.format(FIRST_UNTIL)), F.lit(False))
    for part in (early, ~early):
        ctx.tables.events.where(part).write.mode("append").parquet(folder)
        late.land(ctx.spark, folder, state, "events", "ts", DELAY)
    return late.rows(ctx.spark, state, "events").groupBy("run", "event_type", "late").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
