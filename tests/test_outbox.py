"""Outbox: idempotent insert, consumer filters, retries with backoff, dispatch counts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from kpiforge.operators import outbox

SIM = date(2018, 3, 31)
NOW = datetime(2018, 3, 31, 6, 0)


def _events(spark):
    rows = [
        ("e1", "insight", "anomaly:gmv:kpi:gmv:day:2018-03-31:2018-03-31", "anomaly", "gmv", SIM, SIM, "warning", "public", datetime(2018, 3, 31, 5)),
        ("e2", "insight", "briefing:-:-:day:2018-03-01:2018-03-01", "briefing", None, SIM - timedelta(30), SIM - timedelta(30), "info", "confidential", datetime(2018, 3, 1, 5)),
    ]
    schema = "event_id string, event_type string, dedup_key string, type string, kpi string, period_start date, period_end date, severity string, data_class string, created_at timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_insert_new_is_idempotent(spark):
    ev = _events(spark)
    first = outbox.insert_new(ev, ev.limit(0))
    assert first.count() == 2
    again = outbox.insert_new(ev, ev)
    assert again.count() == 0


def test_enqueue_pending_and_skipped(spark):
    ev = _events(spark)
    empty = spark.createDataFrame([], "event_id string, consumer string")
    d = outbox.enqueue(ev, empty, SIM, NOW, consumers=outbox.CONSUMERS[:1])
    status = {r.event_id: r.status for r in d.collect()}
    assert status == {"e1": "pending", "e2": "skipped"}
    # already enqueued rows are not enqueued twice
    assert outbox.enqueue(ev, d, SIM, NOW, consumers=outbox.CONSUMERS[:1]).count() == 0


def test_retry_backoff_then_delivered_then_failed(spark):
    ev = _events(spark)
    empty = spark.createDataFrame([], "event_id string, consumer string")
    d = outbox.enqueue(ev, empty, SIM, NOW, consumers=outbox.CONSUMERS[:1]).filter("event_id = 'e1'")
    fail = spark.createDataFrame([("e1", "email", False, "boom")], "event_id string, consumer string, success boolean, error string")
    ok = spark.createDataFrame([("e1", "email", True, None)], "event_id string, consumer string, success boolean, error string")
    t1 = outbox.transition(d, fail, NOW).first()
    assert (t1.status, t1.attempts, t1.outcome) == ("pending", 1, "retrying")
    assert t1.next_attempt_at == NOW + timedelta(minutes=1)
    t2 = outbox.transition(outbox.transition(d, fail, NOW).drop("outcome"), ok, NOW).first()
    assert (t2.status, t2.attempts, t2.outcome) == ("delivered", 2, "delivered")
    state = d
    for _ in range(5):
        state = outbox.transition(state, fail, NOW).drop("outcome")
    last = state.first()
    assert (last.status, last.attempts) == ("failed", 5)


def test_due_batch_limit_and_order(spark):
    ev = _events(spark)
    rows = [("e1", "email", "pending", 0, NOW, None, None), ("e2", "email", "pending", 0, NOW + timedelta(hours=1), None, None)]
    d = spark.createDataFrame(rows, "event_id string, consumer string, status string, attempts int, next_attempt_at timestamp_ntz, last_error string, delivered_at timestamp_ntz")
    due = outbox.due(d, ev.withColumn("payload", F.lit("{}")), NOW, batch=1).collect()
    assert [r.event_id for r in due] == ["e1"]


def test_briefing_events(spark):
    from kpiforge.operators.analyst import briefing_events

    docs = spark.createDataFrame(
        [(date(2018, 3, 31), "internal", "warning", "{}")], "as_of date, data_class string, briefing_severity string, document string"
    )
    r = briefing_events(docs).first()
    assert r.dedup_key == "briefing:-:-:day:2018-03-31:2018-03-31"
    assert (r.type, r.severity, r.data_class, r.kpi) == ("briefing", "warning", "internal", None)
    assert r.created_at == datetime(2018, 4, 1, 7, 0)
    assert len(r.event_id) == 36


def test_dedup_key_sorts_entity_ids(spark):
    df = spark.createDataFrame(
        [("anomaly", "gmv", "category", "category:toys", date(2018, 1, 1), date(2018, 1, 1), "day")],
        "type string, kpi_key string, dimension string, entity_id string, period_start date, period_end date, grain string",
    ).withColumn("entity_refs", outbox.entity_refs())
    key = df.select(outbox.dedup_key().alias("k")).first().k
    assert key == "anomaly:gmv:category:toys,kpi:gmv:day:2018-01-01:2018-01-01"
