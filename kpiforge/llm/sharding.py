"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile splitters; records are range-partitioned by them, and
ranges that turn out overfull are subdivided by splitters sampled inside them. The sums of the ranges
(one row each) place every record in one global order, which is cut into shards of equal bytes
(law ``bytes``) or equal counts (law ``rows``). The key is (hash of the text, id), so equal texts
stand together and only a group that a cut falls into is split.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiforge.llm.common import cut

#: Rows aimed at in a range, samples drawn for each range, most ranges of the first splitters.
RANGE_ROWS = 20_000
OVERSAMPLE = 20
FIRST_RANGES = 1024


def _hash_unit(*cols):
    return F.pmod(F.xxhash64(F.lit("splitters"), *cols), F.lit(1 << 52)) / float(1 << 52)


def _range_of(splitters: list[tuple[int, int]]):
    hs = np.array([h for h, _ in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        low, high = np.searchsorted(hs, h.to_numpy(), "left"), np.searchsorted(hs, h.to_numpy(), "right")
        for at in np.flatnonzero(low < high):  # keys that share the hash of a splitter
            low[at] = bisect_right(splitters, (int(h.iat[at]), int(i.iat[at])))
        return pd.Series(low.astype(np.int32))

    return place


def _splitters(sample, parts: int) -> list[tuple[int, int]]:
    keys = sorted((r["h"], r["key"]) for r in sample)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def shard(
    docs: DataFrame, id_col="doc_id", text_col="text", shards: int = 8, law: str = "bytes",
    range_rows: int = RANGE_ROWS, first_ranges: int = FIRST_RANGES,
) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot.

    ``id_col`` is an integer column; null ids sort first. Size is the UTF-8 length plus 1, so null
    and empty texts have size 1 and crc 0. Repeated rows (same id and text) are counted before the
    shuffle and get slots of their own. Slots are gapless from 0 in each shard; an empty table gives
    no rows. Texts of the same hash with other ids stay in the order of the ids.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"),
    ).groupBy("id", "size", "crc", "h").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))))
    total = rows.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not total["k"]:
        return _result(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), id_col, law)

    parts = max(8, min(first_ranges, -(-total["k"] // range_rows)))
    share = (F.col("size") * F.col("n") / total["bytes"] + 1.0 / total["k"]) / 2
    drawn = rows.where(_hash_unit("h", "key") < share * (parts * OVERSAMPLE)).select("h", "key").collect()
    placed = rows.withColumn("range", _range_of(_splitters(drawn, parts))("h", "key"))
    placed = cut(_subdivide(placed, range_rows))

    sums = placed.groupBy("range", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n")).collect()
    begins, b, n = [], 0, 0
    for r in sorted(sums, key=lambda r: (r["range"], r["sub"])):
        begins.append((r["range"], r["sub"], b, n))
        b, n = b + r["b"], n + r["n"]
    offsets = docs.sparkSession.createDataFrame(begins, "range int, sub int, b0 long, n0 long")
    inside = Window.partitionBy("range", "sub").orderBy("h", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    ordered = placed.withColumns({"b": before(F.col("size") * F.col("n")), "at": before(F.col("n"))})
    ordered = (
        ordered.join(F.broadcast(offsets), ["range", "sub"])
        .withColumn("twin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumns({
            "b": F.col("b") + F.col("b0") + F.col("twin") * F.col("size"), "at": F.col("at") + F.col("n0") + F.col("twin")
        })
    )
    middle = (F.col("b") + F.col("size") / 2) / total["bytes"] if law == "bytes" else F.col("at") / total["n"]
    if law == "rows":
        number = F.floor(F.expr(f"(at * {shards}) div {total['n']}"))
    else:
        number = F.least(F.floor(middle * shards), F.lit(shards - 1))
    dealt = cut(ordered.select("id", "size", "crc", "at", number.cast("int").alias("shard")))
    first = dealt.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    dealt = dealt.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first"))
    return _result(dealt, id_col, law)


def _subdivide(placed: DataFrame, range_rows: int) -> DataFrame:
    """Adds ``sub``: the part of an overfull range, by splitters sampled inside it (0 elsewhere)."""
    counts = placed.groupBy("range").count().where(F.col("count") > 2 * range_rows).collect()
    if not counts:
        return placed.withColumn("sub", F.lit(0))
    spark = placed.sparkSession
    full = spark.createDataFrame([(r["range"], r["count"], -(-r["count"] // range_rows)) for r in counts], "range int, k long, parts long")
    joined = placed.join(F.broadcast(full), "range", "left")
    drawn = joined.where(_hash_unit("key", "h", F.lit(2)) < F.col("parts") * OVERSAMPLE / F.col("k"))
    keys = F.sort_array(F.collect_list(F.struct("h", "key")))
    picks = drawn.groupBy("range").agg(keys.alias("keys"), F.first("parts").alias("parts"))
    places = F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)
    picks = picks.select("range", F.transform(places, lambda i: F.get("keys", F.expr("cast(0 as int)") + F.floor(i * F.size("keys") / F.col("parts")).cast("int"))).alias("cuts"))
    key = F.struct("h", "key")
    sub = F.size(F.filter("cuts", lambda c: c <= key))
    return placed.join(F.broadcast(cut(picks)), "range", "left").withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(sub)).drop("cuts")


def _result(rows: DataFrame, id_col: str, law: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot"
    )
