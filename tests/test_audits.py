"""Audits: number provenance, insight contract, registry rules, data-quality helpers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kpiforge.operators import audits, quality
from kpiforge.sources.registry import registry_df


def test_number_provenance(spark):
    source = spark.createDataFrame(
        [(1, "Umsatz 215 R$ (Vortag 1.234,56 R$), Quote 87,84 %, Stichtag 13.05.1998.")], "k int, text string"
    )
    outputs = spark.createDataFrame(
        [
            (1, "Quote 87,8 %"),  # rounds from 87,84 -> supported
            (1, "Umsatz 215.000 R$"),  # 215000 is not 215 -> unsupported
            (1, "Vortag 1.234,6 R$"),  # 1234.56 rounded to one decimal
            (1, "am 13.05.1998"),  # date verbatim
            (1, "am 14.05.1998"),  # unknown date
            (1, "minus −87,84"),  # sign ignored, value matches
        ],
        "k int, text string",
    ).withColumn("id", F.monotonically_increasing_id())
    problems = audits.number_provenance(outputs.select("k", "id", "text"), source.select("k", "text"), ["k"])
    bad = sorted((r.kind, r.token) for r in problems.collect())
    assert bad == [("date", "14.05.1998"), ("number", "215.000")]


def test_number_provenance_any_decimals(spark):
    source = spark.createDataFrame([(1, "Kurs 0,123456789012345 und 9,995, Menge 12.345")], "k int, text string")
    outputs = spark.createDataFrame(
        [
            (1, "Kurs 0,12345679"),  # eight decimals, rounded up
            (1, "Kurs 0,12345678"),  # cut instead of rounded -> unsupported
            (1, "Kurs 0,12345678901235"),  # fourteen decimals, rounded up
            (1, "10,00 und 10"),  # the carry reaches the whole number
            (1, "Menge 12.345,000"),  # more decimals than the source has
            (1, "am 01.02.2020 und 01.02.2020"),  # unknown date, reported once
        ],
        "k int, text string",
    )
    problems = audits.number_provenance(outputs, source, ["k"])
    bad = sorted((r.kind, r.token) for r in problems.collect())
    assert bad == [("date", "01.02.2020"), ("number", "0,12345678")]


def test_draft_acceptance(spark):
    drafts = spark.createDataFrame([(c, t) for c in (1, 2, 3) for t in (2, 4, 6, 8)], "conv_id int, turn int")
    problems = spark.createDataFrame(
        [(1, 2), (1, 2), (1, 6), (2, 2), (2, 4), (2, 6), (2, 8)], "conv_id int, turn int"
    )
    got = sorted(tuple(r) for r in audits.draft_acceptance(problems, drafts).collect())
    # failures after the accepted draft do not count; without one, all drafts are rejected
    assert got == [(1, 2, 1), (2, None, 4), (3, 1, 0)]


def _payload(region_id: str) -> str:
    return json.dumps(
        {
            "schema_version": "insight.v1",
            "insight_id": "88a7e9be-4fc2-3c74-2cbe-32c11c31afd7",
            "source": "kpiforge",
            "type": "anomaly",
            "kpi": "gmv",
            "period": {"start": "2018-01-01", "end": "2018-01-01", "grain": "day"},
            "severity": "warning",
            "direction": "up",
            "entity_refs": [{"type": "region", "id": region_id}, {"type": "kpi", "id": "kpi:gmv"}],
            "evidence": {"method": "stl_mad", "score": 4.2},
            "summary": "x",
            "data_class": "public",
            "created_at": "2018-04-01T06:00:00",
        }
    )


def test_insight_contract(spark):
    ev = spark.createDataFrame([("a", _payload("region:SP")), ("b", _payload("region:NATION_2"))], "event_id string, payload string")
    got = [(r.event_id, r.rule) for r in audits.insight_contract_violations(ev).collect()]
    assert got == [("b", "entity_refs")]


def test_registry_rules(spark):
    reg = registry_df(spark)
    assert audits.registry_rule_violations(reg).count() == 0
    broken = reg.withColumn("min_history_days", F.when(F.col("key") == "gmv", F.lit(7)).otherwise(F.col("min_history_days")))
    broken = broken.unionByName(reg.filter(F.col("key") == "roas"))
    got = sorted((r.key, r.rule) for r in audits.registry_rule_violations(broken).collect())
    assert got == [("gmv", "stl_needs_history"), ("roas", "duplicate_key")]


def test_dq_helpers(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "id int, s string")
    assert [(r.column_name, r.failures) for r in quality.not_null("t", df, ["id", "s"]).collect()] == [("s", 1)]
    assert [(r.key_value, r.n) for r in quality.unique("t", df, ["id"]).collect()] == [("1", 2)]
    assert [(r.value, r.n) for r in quality.accepted_values("t", df, "s", ["a", "b"]).collect()] == [("z", 1)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert [(r.orphan_key, r.n) for r in quality.relationships("t", df, "id", parent, "id").collect()] == [("2", 1)]
