"""Task sizes follow the input; shuffles of the marts carry no column that is not needed."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kpiforge import session
from kpiforge.context import Ctx
from kpiforge.operators import kpi, marts, staging

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
BOUGHT = datetime(2000, 3, 1)
ITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


@pytest.fixture
def folder(spark, tmp_path):
    """Two orders of four products; the first order's item comes three times."""
    ship = BOUGHT + timedelta(days=3)
    items = [
        (1, 1, 1, 1, 2.0, 10.0, 0.0, 0.05, "A", "F", ship),
        (1, 1, 1, 1, 2.0, 10.0, 0.0, 0.08, "A", "F", ship),
        (1, 1, 1, 1, 2.0, 10.0, 0.0, 0.08, "R", "O", ship),
        (2, 2, 1, 1, 1.0, 20.0, 0.0, 0.00, "N", "O", ship),
        (2, 3, 1, 2, 1.0, 30.0, 0.0, 0.00, "N", "O", ship),
        (2, 9, 1, 3, 1.0, 40.0, 0.0, 0.00, "N", "O", ship),
        (2, 2, 1, 4, 1.0, 50.0, 0.0, 0.00, "N", "O", ship),
    ]
    orders = [(k, k, "F", 10.0, BOUGHT, "1-URGENT") for k in (1, 2)]
    tables = {
        "lineitem": (items, ITEM),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(k, "c", 0, 1.0, "AUTO") for k in (1, 2)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(k, "p", "b", f"T{k}", 1, 5.0) for k in (1, 2, 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "nation": ([(0, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_more_input_means_more_partitions(spark):
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.size_tasks(spark, 1000)
    assert int(spark.conf.get(PARTITIONS)) == before
    session.size_tasks(spark, 1 << 30)
    one = int(spark.conf.get(PARTITIONS))
    session.size_tasks(spark, 6 << 30)
    assert one >= 100 and int(spark.conf.get(PARTITIONS)) == 6 * one
    session.size_tasks(spark, 0)


def test_a_given_size_of_tasks_stays(spark):
    old = spark.conf.getAll.get(ADVISORY)
    spark.conf.set(ADVISORY, "3m")
    try:
        session.size_tasks(spark, 1000)
        assert spark.conf.get(ADVISORY) == "3m"
    finally:
        spark.conf.set(ADVISORY, old) if old else spark.conf.unset(ADVISORY)


def test_a_context_sizes_the_tasks_of_its_input(spark, folder):
    spark.conf.unset(PARTITIONS)
    Ctx.of(spark, folder)
    assert int(spark.conf.get(PARTITIONS)) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get(ADVISORY) != "64MB"


def plan(df):
    """The optimized plan without the lines of the scans, which list every column of their files."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(x for x in lines if "Relation [" not in x)


def test_items_are_shuffled_without_columns_that_decide_nothing(spark, folder):
    items = staging.stg_order_items(Ctx.of(spark, folder, materialize=False))
    assert "l_returnflag" not in plan(items) and "l_linestatus" not in plan(items)
    kept = items.where("order_id = 1").collect()
    assert [r["freight_value"] for r in kept] == [Decimal("0.80")]


def test_item_facts_keep_their_rows(spark, folder):
    facts = marts.fct_order_items(Ctx.of(spark, folder, materialize=False))
    got = {(r["order_id"], r["order_item_id"], r["category_name_en"], float(r["price"])) for r in facts.collect()}
    assert got == {(1, 1, "t1", 10.0), (2, 1, "t2", 20.0), (2, 2, "t3", 30.0), (2, 4, "t2", 50.0)}  # product 9 is unknown
    assert facts.select(F.count_if("is_canceled")).first()[0] == 0


def test_orders_are_counted_by_marks_of_the_item_mart(spark, folder):
    ctx = Ctx.of(spark, folder, materialize=False)
    marked = marts.counted_order_items(ctx).select(F.count_if("first_of_order"), F.count_if("first_of_group")).first()
    assert tuple(marked) == (2, 3)
    got = {(r["dimension"], r["dimension_value"]): (r["items"], r["orders_with_items"], float(r["gmv"])) for r in kpi.kpi_items_agg(ctx).collect()}
    assert got == {
        ("total", "all"): (4, 2, 110.0), ("region", "FRANCE"): (4, 2, 110.0),
        ("category", "t1"): (1, 1, 10.0), ("category", "t2"): (2, 1, 70.0), ("category", "t3"): (1, 1, 30.0),
    }
