"""Column helpers: JSON canonicalisation and field removal, presets, ratios, conversion median."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from kpiforge.functions import columns as C


def test_canonical_json_and_drop_field(spark):
    df = spark.createDataFrame([("b", 1, "a")], "z string, a int, m string")
    assert df.select(C.canonical_json("z", "a", "m").alias("j")).first().j == '{"a":1,"m":"a","z":"b"}'
    payload = json.dumps({"kpi": "gmv", "details": {"context": {"x": 1}, "sections": ["a"]}})
    p = spark.createDataFrame([(payload,)], "p string")
    schema = "kpi string, details struct<context: struct<x: int>, sections: array<string>>"
    out = json.loads(p.select(C.drop_json_field(F.col("p"), schema, "details.context").alias("j")).first().j)
    assert out == {"kpi": "gmv", "details": {"sections": ["a"]}}


def test_preset_windows(spark):
    df = spark.createDataFrame([(date(2018, 3, 31),)], "d date")
    s, e = C.preset_window(F.col("d"), "90d")
    r = df.select(s.alias("s"), e.alias("e")).first()
    assert (r.s, r.e) == (date(2018, 1, 1), date(2018, 3, 31))
    s, e = C.preset_window(F.col("d"), "365d", grain="month")
    r = df.select(s.alias("s"), e.alias("e")).first()
    assert (r.s, r.e) == (date(2017, 4, 1), date(2018, 3, 1))


def test_safe_ratio_and_kpi_value(spark):
    df = spark.createDataFrame([("ratio", 1.0, 3.0), ("ratio", 1.0, 0.0), ("sum", 5.0, None)], "a string, n double, d double")
    got = [r.v for r in df.select(C.kpi_value(F.col("a"), F.col("n"), F.col("d")).alias("v")).collect()]
    assert got == [0.333333, None, 5.0]


def test_daily_conversion_median(spark):
    """Daily conversion = orders / sessions, its median over the days."""
    df = spark.createDataFrame([(1, 10, 500), (2, 11, 500), (3, 30, 500)], "day int, orders int, sessions int")
    med = df.select((F.col("orders") / F.col("sessions")).alias("c")).agg(F.median("c").alias("m")).first().m
    assert abs(med - 0.022) < 1e-12
