"""Streams give the same result however the rows are spread over files, runs and micro-batches."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kpiforge.streaming import streams

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.mark.parametrize("files", [1, 4, 16])
def test_any_file_layout(spark, events, files):
    folder = tempfile.mkdtemp(prefix="layout-")
    events.orderBy(F.rand(files)).repartition(files).write.parquet(f"{folder}/events.parquet")
    for stream in (streams.stream_kpi_daily, streams.stream_dedup, streams.stream_trailing_counts):
        assert rows(stream(spark, folder)) == rows(stream(spark, SF))
    daily = streams.web_daily(events)
    got = streams.stream_kpi_daily(spark, folder).filter("kpi_key = 'conversion_rate'")
    want = daily.select("kpi_date", F.col("web_orders").cast("double").alias("numerator"), F.col("sessions").cast("double").alias("denominator"))
    assert rows(got.select("kpi_date", "numerator", "denominator")) == rows(want)


def test_two_runs_add_up(spark, events):
    """Late rows of a second run count too, and nothing that the first run read is read again."""
    folder, base = tempfile.mkdtemp(prefix="runs-"), tempfile.mkdtemp(prefix="state-")
    late = F.col("event_id") % 2 == 0
    events.filter(~late).write.parquet(f"{folder}/events.parquet")
    streams.stream_kpi_daily(spark, folder, base)
    events.filter(late).write.mode("append").parquet(f"{folder}/events.parquet")
    assert rows(streams.stream_kpi_daily(spark, folder, base)) == rows(streams.stream_kpi_daily(spark, SF))


def test_outbox_from_empty_and_partly_filled(spark):
    found = spark.range(100).select(F.concat(F.lit("k"), "id").alias("dedup_key"), F.col("id").alias("v"))
    for held in (0, 30):
        out = streams.stream_outbox(spark, found, found.filter(F.col("v") < held))
        assert rows(out) == rows(found)
