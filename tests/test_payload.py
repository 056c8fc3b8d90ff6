"""JSON payloads without a fixed schema: canonical text, removal of a path, contract walks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kpiforge.functions import payload
from kpiforge.operators import audits

GOOD = {
    "schema_version": "insight.v1", "insight_id": "12345678-1234-1234-1234-123456789abc", "source": "kpiforge", "type": "anomaly",
    "kpi": "gmv", "period": {"start": "2001-01-01", "end": "2001-01-02", "grain": "day"}, "severity": "warning", "direction": None,
    "observed": 1, "expected": 2.5, "entity_refs": [{"type": "region", "id": "region:SP"}, {"type": "kpi", "id": "kpi:gmv"}],
    "evidence": {"method": "stl_mad", "score": 4.1, "anything": [1]}, "summary": "s", "data_class": "public",
    "created_at": "2001-01-03T06:00:00",
}


def rules(spark, *payloads):
    rows = [(str(i), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    found = audits.insight_contract_violations(spark.createDataFrame(rows, "event_id string, payload string"))
    out = [set() for _ in payloads]
    for r in found.collect():
        out[int(r["event_id"])].add(r["rule"])
    return out


def changed(**values):
    return {k: v for k, v in (GOOD | values).items() if v != "GONE"}


def test_planted_violations(spark):
    cases = [
        (GOOD, set()),
        (changed(kpi=None, direction="up", details={"x": 1}), set()),
        (changed(colour="red"), {"colour: unknown"}),
        (changed(summary="GONE", evidence="GONE"), {"summary: missing", "evidence: missing"}),
        (changed(period=GOOD["period"] | {"zone": "x"}), {"period.zone: unknown"}),
        (changed(period={"start": "2001-01-01", "grain": "week"}), {"period.end: missing", "period.grain: value"}),
        (changed(period=GOOD["period"] | {"start": "2001-02-01"}), {"period: order"}),
        (changed(period="2001"), {"period: type"}),
        (changed(severity="bad", observed="1"), {"severity: value", "observed: type"}),
        (changed(severity=None), {"severity: type"}),
        (changed(summary="", created_at="yesterday"), {"summary: length", "created_at: pattern"}),
        (changed(evidence={"score": "high"}), {"evidence.method: missing", "evidence.score: type"}),
        (changed(entity_refs=[{"type": "shop", "id": "kpi:gmv"}]), {"entity_refs[].type: value"}),
        (changed(entity_refs=[{"id": "kpi:gmv", "x": 1}]), {"entity_refs[].type: missing", "entity_refs[].x: unknown"}),
        (changed(entity_refs=[{"type": "region", "id": "region:Nowhere 1"}]), {"entity_refs"}),
        (changed(schema_version="insight.v2", insight_id="1"), {"schema_version: value", "insight_id: pattern"}),
    ]
    assert rules(spark, *[c for c, _ in cases]) == [r for _, r in cases]
    assert "payload: type" in rules(spark, "[1]")[0] and "payload: type" in rules(spark, "no json")[0]


def test_canonical_order_at_every_level(spark):
    text = '{"b": {"z": 1, "a": [ {"d": null, "c": "x"} ]}, "a": 1.5, "é": true, "B": "1"}'
    df = spark.createDataFrame([(text,), ("no json",), (None,)], "p string")
    got = [r[0] for r in df.select(payload.canonical(F.col("p"))).collect()]
    assert got == ['{"B":"1","a":1.5,"b":{"a":[{"c":"x","d":null}],"z":1},"é":true}', None, None]


@pytest.mark.parametrize("path, want", [
    (["details"], '{"a":"1"}'),
    (["details", "context"], '{"a":"1","details":{"keep":[1,{"x":2}],"n":7}}'),
    (["details", "n"], '{"a":"1","details":{"context":{"deep":{"er":1}},"keep":[1,{"x":2}]}}'),
    (["details", "context", "deep", "er"], '{"a":"1","details":{"context":{"deep":{}},"keep":[1,{"x":2}],"n":7}}'),
    (["missing", "x"], '{"a":"1","details":{"context":{"deep":{"er":1}},"keep":[1,{"x":2}],"n":7}}'),
    (["a", "x"], '{"a":"1","details":{"context":{"deep":{"er":1}},"keep":[1,{"x":2}],"n":7}}'),
])
def test_remove_path(spark, path, want):
    text = '{"details":{"context":{"deep":{"er":1}},"n":7,"keep":[1,{"x":2}]},"a":"1"}'
    df = spark.createDataFrame([(text,), ("[3]",), (None,)], "p string")
    assert [r[0] for r in df.select(payload.remove_path(F.col("p"), path)).collect()] == [want, "[3]", None]
