"""Window operators over KPI series and events.

Series windows are partitioned per series (bounded by the calendar). The per-client trailing
counts are partitioned per (client, hour bucket) with the previous hour's events added as
context rows, so even a client with a huge share of all events is split into hour-sized
partitions while every count stays exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions import stl
from kpiforge.operators import anomaly

SERIES = ["kpi_key", "dimension", "dimension_value"]


@model
def dense_totals(ctx: Ctx) -> DataFrame:
    """Every day between a total series' first and last row, value NULL where missing."""
    s = anomaly.alert_series(ctx).filter(F.col("dimension") == "total").select(*SERIES, "kpi_date", "value")
    spans = s.groupBy(*SERIES).agg(F.min("kpi_date").alias("a"), F.max("kpi_date").alias("b"))
    spine = spans.select(*SERIES, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("kpi_date"))
    return spine.join(s, [*SERIES, "kpi_date"], "left")


def _round9(x: Column) -> Column:
    return F.round(x + F.lit(1e-13), 9)


@model
def interpolate_gaps(ctx: Ctx) -> DataFrame:
    """Linear interpolation of NULL gaps by position, both ends filled with the nearest
    value (previous / next non-NULL value and their positions from ignore-nulls frames)."""
    d = dense_totals(ctx).select("*", anomaly.day_number(F.col("kpi_date")).alias("pos"))
    before = Window.partitionBy(*SERIES).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*SERIES).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    present = F.when(F.col("value").isNotNull(), F.col("pos"))
    w = d.select(
        "*",
        F.last("value", ignorenulls=True).over(before).alias("v0"),
        F.last(present, ignorenulls=True).over(before).alias("p0"),
        F.first("value", ignorenulls=True).over(after).alias("v1"),
        F.first(present, ignorenulls=True).over(after).alias("p1"),
    )
    interp = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("v0").isNull(), F.col("v1"))
        .when(F.col("v1").isNull(), F.col("v0"))
        .otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    )
    return w.select(*SERIES, "kpi_date", "value", _round9(interp).alias("filled"))


def _median_of(cols: list[Column]) -> Column:
    """Median of the non-NULL values of a few columns (average of the middle two)."""
    s = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(s)
    mid_odd = F.element_at(s, ((n + 1) / 2).cast("int"))
    mid_even = (F.element_at(s, (n / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, mid_odd).otherwise(mid_even)


@model
def weekday_effect_recent(ctx: Ctx) -> DataFrame:
    """Median of the same weekday over the last four weeks (lags 7, 14, 21, 28)."""
    d = dense_totals(ctx)
    w = Window.partitionBy(*SERIES).orderBy("kpi_date")
    lags = [F.lag("value", k * config.WEEKLY_PERIOD).over(w) for k in range(1, config.WEEKDAY_WEEKS + 1)]
    return d.select(*SERIES, "kpi_date", "value", _round9(_median_of(lags)).alias("same_weekday_median"))


@model
def trailing_counts(ctx: Ctx) -> DataFrame:
    """Per client, events in the trailing hour (inclusive) at every event."""
    e = ctx.tables.events.select("event_id", "user_id", "ts")
    hour_us = 3600 * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select("*", micros.alias("t"), F.floor(micros / hour_us).alias("hour"))
    own = e.select("*", F.col("hour").alias("part"), F.lit(True).alias("own"))
    ctx_rows = e.select("*", (F.col("hour") + 1).alias("part"), F.lit(False).alias("own"))
    both = own.unionByName(ctx_rows)
    w = Window.partitionBy("user_id", "part").orderBy("t").rangeBetween(-hour_us, 0)
    counted = both.select("event_id", "user_id", "ts", "own", F.count(F.lit(1)).over(w).alias("events_last_hour"))
    return counted.filter("own").drop("own")


def _seasonal_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("kpi_date")
    y = pdf["value"].to_numpy(dtype=float)[None, :]
    seasonal = stl.stl_seasonal(stl.interpolate_rows(y))[0] if np.isfinite(y).any() else np.full(y.shape[1], np.nan)
    return pd.DataFrame({"kpi_key": pdf["kpi_key"], "kpi_date": pdf["kpi_date"], "value": pdf["value"], "seasonal": seasonal})


@model
def stl_seasonal(ctx: Ctx) -> DataFrame:
    """Weekly component of a robust STL fit of each KPI total over its whole history
    (one group per KPI, one row per day)."""
    d = dense_totals(ctx).select("kpi_key", "kpi_date", "value")
    return d.groupBy("kpi_key").applyInPandas(_seasonal_group, "kpi_key string, kpi_date date, value double, seasonal double")
