"""Running totals over a whole table without a window that has no partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.session import checkpoint_dir


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one, in the given order.

    The rows are dealt into ranges of the order and cut from their lineage once; the ranges' own totals (one row per
    partition) give each its offset, and a window runs within a range only. ``order`` must be total, so that a
    frequent first key is spread over ranges by the others.
    """
    checkpoint_dir(df.sparkSession)
    dealt = df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    offset, offsets = 0, []
    for part, total in sorted((r[0], r[1]) for r in dealt.groupBy("_part").agg(F.sum("_v")).collect()):
        offsets.append((part, offset))
        offset += total
    begins = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long"))
    up_to = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(begins, "_part").withColumn(name, F.sum("_v").over(up_to) + F.col("_before")).drop("_part", "_before", "_v")


def trailing_total(events: DataFrame, key: str, micros: str, width: int, name: str) -> DataFrame:
    """(key, name): per event the number of events in the ``width`` microseconds that end with it, both ends included.

    Every event asks how many events lie up to its time and how many before its window's start; the
    questions are sorted in between the events and answered by one running total. ``key`` is unique.
    """
    at = F.col(micros)
    kind = lambda t, place: events.select(F.col(key), t.alias("t"), F.lit(place).alias("place"))
    # at one time: window starts first, then the events, then the questions of those events
    rows = kind(at - width, 0).unionByName(kind(at, 1)).unionByName(kind(at, 2))
    counted = running_total(rows, ["t", "place", key], (F.col("place") == 1).cast("long"), "n")
    upper, lower = (F.max(F.when(F.col("place") == p, F.col("n"))) for p in (2, 0))
    return counted.where("place <> 1").groupBy(key).agg((upper - lower).alias(name))
