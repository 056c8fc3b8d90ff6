"""The raw store: newest load wins, audits before publishing, watermarks, what failures leave behind."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kpiforge.context import Ctx
from kpiforge.operators import rawstore, staging
from kpiforge.sources import files

SF_SMALL = "/root/testdata/sf0.001"

AT = datetime(2001, 8, 2, 2)
COLUMNS = "key long, part int, value double, day date, _wm timestamp_ntz"


def entity(spark, rows, mode="incremental", **more):
    def extract(ctx, since):
        df = spark.createDataFrame(rows, COLUMNS)
        return df.where(F.col("_wm") > F.lit(since).cast("timestamp_ntz")) if since else df

    return rawstore.Entity("src", "things", {"key": "bigint", "part": "int", "value": "double", "day": "date"}, ("key",), extract, mode, **more)


@pytest.fixture
def store(spark, tmp_path):
    return rawstore.RawStore(spark, str(tmp_path / "raw"))


@pytest.fixture
def ctx(spark):
    return Ctx.of(spark, SF_SMALL)


def at(day):
    return datetime(2000, 1, day)


def test_newest_load_wins_over_greater_values(store, ctx, spark):
    store.load(ctx, entity(spark, [(1, 9, 99.5, date(2030, 1, 1), at(1)), (2, None, 1.25, None, at(2))]), AT)
    again = [(1, 1, 0.1, date(2000, 1, 1), at(3)), (3, 3, None, None, at(4)), (3, 2, 7.0, None, at(4))]
    store.load(ctx, entity(spark, again), AT + timedelta(days=1))
    e = entity(spark, [], ties=("part",))
    assert sorted(map(tuple, store.newest(e).collect()), key=str) == sorted(
        [(1, 1, 0.1, date(2000, 1, 1)), (2, None, 1.25, None), (3, 3, None, None)], key=str
    )
    assert store.table(e).count() == 5 and dict(store.table(e).dtypes)["value"] == "string"
    assert store.watermark(e) == "2000-01-04 00:00:00"


def test_full_reload_replaces_and_empty_extract_keeps_the_watermark(store, ctx, spark):
    full = entity(spark, [(1, 1, 1.0, None, at(1)), (2, 1, 1.0, None, at(1))], mode="full")
    store.load(ctx, full, AT)
    store.load(ctx, entity(spark, [(5, 1, 1.0, None, at(1))], mode="full"), AT + timedelta(days=1))
    assert [r["key"] for r in store.newest(full).collect()] == [5]
    empty = entity(spark, [(9, 1, 1.0, None, at(1))])
    assert store.load(ctx, empty, AT + timedelta(days=2)) == 0
    assert store.log().where("load_id = 'src-things-000003'").first()["watermark_to"] == "2000-01-01 00:00:00"


def test_bad_rows_leave_a_failed_load_and_nothing_else(store, ctx, spark):
    good = entity(spark, [(1, 1, 1.0, None, at(1))])
    store.load(ctx, good, AT)
    bad = entity(spark, [(2, 1, 1.0, None, at(5)), (None, 1, 1.0, None, at(5))], rules={"part": "cast(part AS int) < 0"})
    with pytest.raises(rawstore.LoadFailed):
        store.load(ctx, bad, AT + timedelta(days=1), lambda df: df.withColumn("value", F.lit("x")))
    row = store.log().where("status = 'failed'").first()
    assert row["error"] == "LoadFailed('key is missing in 1 rows; value is no double in 2 rows; part breaks its rule in 2 rows')"
    assert row["rows_loaded"] is None and row["watermark_to"] is None and row["watermark_from"] == "2000-01-01 00:00:00"
    assert store.watermark(good) == "2000-01-01 00:00:00" and store.newest(good).count() == 1
    assert files.children(spark, f"{store.root}/raw/src__things") == ["src-things-000001"]


def test_errors_of_the_extract_are_logged_and_cut(store, ctx, spark):
    def fails(ctx, since):
        raise RuntimeError("y" * 5000)

    e = rawstore.Entity("src", "things", {"key": "bigint"}, ("key",), fails)
    with pytest.raises(RuntimeError):
        store.load(ctx, e, AT)
    assert len(store.log().first()["error"]) == rawstore.ERROR_CHARS


def test_folder_of_a_driver_that_died_is_not_read(store, ctx, spark):
    e = entity(spark, [(1, 1, 1.0, None, at(1))])
    spark.range(3).write.parquet(f"{store.root}/raw/src__things/src-things-000001")  # written, never logged
    assert store.table(e).count() == 0
    store.load(ctx, e, AT)
    assert store.table(e).count() == 1


def test_unloaded_entity_stages_to_no_rows(store, ctx):
    assert staging.stg_orders(Ctx(ctx.tables, materialize=False, raw=store)).count() == 0
