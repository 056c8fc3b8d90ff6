"""The mart store: shared by contexts, renewed by day, old versions removed."""

from __future__ import annotations

import os
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from kpiforge.context import Ctx
from kpiforge.martstore import INPUTS, MartStore
from kpiforge.operators import kpi
from kpiforge.sources import files

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set("spark.kpiforge.marts.dir", str(tmp_path / "marts"))
    for t in INPUTS:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    yield str(tmp_path)
    spark.conf.unset("spark.kpiforge.marts.dir")


def rewrite(spark, folder, table, change):
    """Replace a table file by a changed one."""
    df = change(spark.read.parquet(f"{SF}/{table}.parquet")).toPandas()
    os.chmod(f"{folder}/{table}.parquet", 0o644)
    spark.createDataFrame(df, spark.read.parquet(f"{SF}/{table}.parquet").schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/new_{table}")
    part = next(p for p in os.listdir(f"{folder}/new_{table}") if p.startswith("part"))
    shutil.copyfile(f"{folder}/new_{table}/{part}", f"{folder}/{table}.parquet")


def rows(df):
    return sorted(map(str, df.collect()))


def test_contexts_share_marts_and_read_them_in_one_scan(spark, folder):
    first = Ctx.of(spark, folder)
    mart = kpi.kpi_daily(first)
    assert rows(mart) == rows(kpi.kpi_rows(Ctx.of(spark, folder, materialize=False)))
    again = Ctx.of(spark, folder)
    assert again.store.version == first.store.version
    other = Ctx.of(spark, folder, sim_date=date(2000, 1, 1))
    assert other.store.slot != first.store.slot
    plan = kpi.kpi_daily(again)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_only_the_changed_day_is_written(spark, folder):
    before = Ctx.of(spark, folder)
    kpi.kpi_daily(before)
    order = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderdate < '2001-01-01'").join(
        spark.read.parquet(f"{SF}/lineitem.parquet"), F.col("l_orderkey") == F.col("o_orderkey")
    ).orderBy("o_orderkey").first()
    day = order["o_orderdate"].date()
    rewrite(spark, folder, "lineitem", lambda df: df.withColumn(
        "l_extendedprice", F.when(F.col("l_orderkey") == order["o_orderkey"], F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    ))
    after = Ctx.of(spark, folder)
    assert after.store.version != before.store.version
    mart = kpi.kpi_daily(after)
    parts = after.store._manifest(after.store.version, "kpi_daily")
    assert len(parts) == 2 and parts[1]["days"] == [day.isoformat()]
    assert {r["kpi_date"] for r in spark.read.parquet(parts[1]["path"]).select("kpi_date").distinct().collect()} == {day}
    assert rows(mart) == rows(kpi.kpi_rows(Ctx.of(spark, folder, materialize=False)))


def test_new_first_day_and_old_versions(spark, folder):
    versions = []
    for step, shift in enumerate((0, 1, 2, 3)):
        if step:
            rewrite(spark, folder, "orders", lambda df: df.withColumn(
                "o_orderdate", F.when(F.col("o_orderkey") == 1, F.lit(f"1994-12-{31 - shift}").cast("timestamp_ntz")).otherwise(F.col("o_orderdate"))
            ))
        ctx = Ctx.of(spark, folder)
        assert rows(kpi.kpi_daily(ctx)) == rows(kpi.kpi_rows(Ctx.of(spark, folder, materialize=False)))
        versions.append(ctx.store.version)
    store = ctx.store
    left = set(files.children(spark, store.slot)) - {"_used", "_pending"}
    read = {p["path"].split("/")[-2] for v in store.versions() for p in store._manifest(v, "kpi_daily")}
    assert left == set(versions[-2:]) | read and len(set(versions)) == 4
    assert versions[0] in left  # its files are the base of the newest


def test_a_second_builder_does_not_mix_in(spark, folder):
    store = MartStore(spark, folder, ("x",), version="v1")
    assert store.get("m", lambda: spark.range(3)).count() == 3
    assert not store._publish(spark.range(9), store.path("m"))
    assert store.get("m", lambda: spark.range(9)).count() == 3
