"""Running totals over ranges and watermarks that outlive a run."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kpiforge.functions.ordering import running_total, trailing_total
from kpiforge.streaming import late


def test_trailing_total_with_ties(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, rng.randint(0, 60)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t long").repartition(5)
    got = {r["id"]: r["n"] for r in trailing_total(df, "id", "t", 10, "n").collect()}
    assert got == {i: sum(t - 10 <= u <= t for _, u in rows) for i, t in rows}
    assert trailing_total(df.limit(0), "id", "t", 10, "n").count() == 0


def test_running_total_in_order(spark):
    df = spark.createDataFrame([(i % 3, i, i) for i in range(50)], "a long, b long, x long").repartition(4)
    got = running_total(df, ["a", "b"], F.col("x"), "s").orderBy("a", "b").collect()
    total = 0
    for r in got:
        total += r["x"]
        assert r["s"] == total


def test_plan_has_no_single_partition(spark):
    df = spark.range(100).select("id", (F.col("id") * 3).alias("t"))
    plan = trailing_total(df, "id", "t", 10, "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_rows_behind_the_last_runs_watermark(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(3).write.mode("append").parquet(folder)
        late.land(spark, folder, state, "s", "ts", timedelta(days=2))
        found = late.rows(spark, state, "s")
        return {r["id"]: (r["run"], r["late"]) for r in found.collect()}

    # out of order within a run: nothing is late
    assert run([(1, day(10)), (2, day(3)), (3, None)]) == {1: (0, False), 2: (0, False), 3: (0, False)}
    assert late.watermark(spark, state, "s") == (1, day(8))
    got = run([(4, day(8)), (5, day(7)), (6, day(20)), (7, day(1))])
    assert {i: got[i] for i in (4, 5, 6, 7)} == {4: (1, False), 5: (1, True), 6: (1, False), 7: (1, True)}
    # a run of late rows alone does not move the watermark back
    assert run([(8, day(9))])[8] == (2, True)
    assert late.watermark(spark, state, "s") == (3, day(18))
