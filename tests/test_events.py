"""Event chain and context: three-way joins, evidence, recent findings, briefings without their context."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from kpiforge.functions.payload import remove_path
from kpiforge.operators import analyst, audits, kpi


def test_join_frames_keeps_keys_of_one_input(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "x", 20)], "d int, m string, sessions int")
    b = spark.createDataFrame([(2, "x", 5), (3, "y", 6)], "d int, m string, orders int")
    c = spark.createDataFrame([(2, "x", 1.5), (4, "z", None)], "d int, m string, revenue double")
    got = kpi.join_frames({"a": a, "b": b, "c": c}, ["d", "m"])
    assert sorted(map(tuple, got.collect())) == [
        (1, "x", 10, None, None, True, False, False), (2, "x", 20, 5, 1.5, True, True, True),
        (3, "y", None, 6, None, False, True, False), (4, "z", None, None, None, False, False, True),
    ]
    assert got.where("in_a AND in_b AND in_c").count() == 1
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def _findings(spark, rows):
    schema = "event_id string, type string, severity string, summary string, period_end date, data_class string, created_at timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_recent_anomalies_of_two_days(spark):
    day = lambda d: date(2001, 1, d)
    at = lambda h: datetime(2001, 1, 5, h)
    rows = [("a", "anomaly", "warning", "s", day(1), "public", at(1)), ("b", "anomaly", "critical", "s", day(2), "internal", at(3)),
            ("c", "anomaly", "warning", "s", day(2), "public", at(2)), ("d", "anomaly", "critical", "s", day(2), "confidential", at(1)),
            ("e", "briefing", "info", "s", day(2), "public", at(1))]
    rows += [(f"z{i:02d}", "anomaly", "warning", "s", day(9), "public", at(4)) for i in range(25)]
    got = analyst.recent_anomalies(_findings(spark, rows)).orderBy("as_of", "place").collect()
    assert [(r["as_of"].day, r["place"], r["id"]) for r in got if r["as_of"].day < 9] == [
        (1, 1, "insight:a"), (2, 1, "insight:b"), (2, 2, "insight:a"), (2, 3, "insight:c"), (3, 1, "insight:b"), (3, 2, "insight:c"),
    ]
    assert sum(r["as_of"].day == 9 for r in got) == analyst.MAX_ANOMALIES


_ENTRY = "as_of date, section string, place int, id string, parent string, label string, direction string, data_origin string, " \
    "current string, previous string, change string, severity string, data_class string"


def entries(spark):
    d, e = date(2001, 1, 31), date(2001, 2, 1)
    return spark.createDataFrame([
        (d, "kpi", 0, "kpi:gmv", None, "GMV", "up_good", "erp", "2", "1", "+100 %", None, "public"),
        (d, "driver", 2, "region:SP", "kpi:gmv", None, None, None, "1", "0", "+1 %", None, None),
        (d, "driver", 1, "region:RJ", "kpi:gmv", None, None, None, "1", "0", "+1 %", None, None),
        (d, "month", 0, "kpi:budget_deviation", None, "Budget", None, "plan", "3", "01/2001", None, None, "internal"),
        (d, "anomaly", 1, "insight:x", None, "bad", None, None, None, None, None, "critical", "public"),
        (e, "kpi", 0, "kpi:gmv", None, "GMV", "up_good", "erp", "2", "1", "+100 %", None, "public"),
    ], _ENTRY)


def test_document_holds_drivers_direction_and_origin(spark):
    got = {r["as_of"].day: r for r in analyst.context_document(entries(spark)).collect()}
    assert (got[31]["data_class"], got[31]["briefing_severity"]) == ("internal", "warning")
    assert (got[1]["data_class"], got[1]["briefing_severity"]) == ("public", "info")
    doc = json.loads(got[31]["document"])
    (gmv,) = doc["kpis"]
    assert (gmv["direction"], gmv["data_origin"]) == ("up_good", "erp")
    assert [x["id"] for x in gmv["top_drivers"]] == ["region:RJ", "region:SP"]
    assert doc["monthly_kpis"] == [{"id": "kpi:budget_deviation", "label": "Budget", "data_origin": "plan", "month": "01/2001", "value": "3"}]
    assert doc["anomalies"] == [{"id": "insight:x", "severity": "critical", "summary": "bad"}]


def test_planted_evidence_is_found(spark):
    d, e = date(2001, 1, 31), date(2001, 2, 1)
    cited = spark.createDataFrame([(d, "f1", "kpi:gmv"), (d, "f1", "region:SP"), (d, "f2", "region:XX"), (e, "f3", "region:SP"), (e, "f3", "kpi:gmv")],
                                  "as_of date, finding string, ref string")
    got = analyst.unsupported_evidence(cited, entries(spark))
    assert sorted((r["finding"], r["ref"]) for r in got.collect()) == [("f2", "region:XX"), ("f3", "region:SP")]


def test_briefing_keeps_the_contract_and_loses_its_context(spark):
    events = analyst.briefing_events(analyst.context_document(entries(spark)))
    assert audits.insight_contract_violations(events).count() == 0
    row = events.withColumn("public", remove_path(F.col("payload"), ["details", "context"])).where("period_end = '2001-01-31'").first()
    assert json.loads(row["payload"])["details"]["context"]["kpis"][0]["id"] == "kpi:gmv"
    public = json.loads(row["public"])
    assert public["details"] == {"format": "context.v1"} and public["summary"] == "Briefing 31.01.2001"
