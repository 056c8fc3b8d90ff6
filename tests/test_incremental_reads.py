"""Incremental extracts of orders and reviews read only the line items that can matter, and bring the same rows."""

from __future__ import annotations

from datetime import datetime

import pytest

from kpiforge.context import Ctx
from kpiforge.sources import landing

SINCE = datetime(2000, 6, 1)


@pytest.fixture
def ctx(spark, tmp_path):
    day = lambda m, d: datetime(2000, m, d)
    orders = [(1, 1, "F", day(3, 1)), (2, 2, "F", day(6, 10)), (3, 3, "F", day(6, 20)), (4, 4, "O", day(7, 1)), (5, 5, "F", day(5, 1))]
    items = [
        (1, day(3, 5)), (1, day(3, 9)),
        (2, day(5, 1)), (2, day(6, 12)), (2, day(6, 15)),  # one shipped before the purchase
        (3, day(6, 1)), (3, None),  # none that counts
        (4, day(7, 4)),
        (5, day(5, 3)), (5, day(6, 9)),  # first item long before the last one
    ]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    spark.createDataFrame(items, "l_orderkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return Ctx.of(spark, str(tmp_path), materialize=False)


def ship_filter(df):
    """The filters of the optimized plan on the ship date."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return " ".join(x for x in lines if "Filter" in x and "l_shipdate" in x)


def test_incremental_orders_equal_those_of_the_whole_extract(ctx):
    whole = [r for r in landing.erp_orders(ctx).collect() if r["_wm"] > SINCE]
    part = landing.erp_orders(ctx, SINCE)
    assert sorted(part.collect()) == sorted(whole) and len(whole) == 3
    assert "2000-06-01" in ship_filter(part)


@pytest.mark.parametrize("since", ["2000-06-10 00:00:00", "2000-06-18", "2000-03", "x", None])
def test_incremental_reviews_equal_those_of_the_whole_extract(ctx, since):
    whole = landing.legacy_reviews(ctx, since, orders=landing.erp_orders(ctx))
    assert sorted(landing.legacy_reviews(ctx, since).collect()) == sorted(whole.collect())


def test_reviews_read_no_items_shipped_long_before(ctx):
    assert "2000-06-" in ship_filter(landing.legacy_reviews(ctx, "2000-06-10 00:00:00"))
