"""Contract audits: one valid document per contract passes; single-field mutations fail with
the expected rule."""

from __future__ import annotations

import copy
import json

import pytest

from kpiforge.operators import contracts as C

TASK = {
    "task_id": "t1", "parent_task_id": None, "depth": 1, "requested_by": {"kind": "central", "department": None},
    "department": "sales", "allowed_tools": ["kpi_series", "kpi_breakdown"],
    "budget": {"max_steps": 10, "max_tokens": 20000, "max_cost_eur": 0.5}, "status": "running", "status_reason": None,
}
CHILD = {**TASK, "task_id": "t2", "parent_task_id": "t1", "depth": 2,
         "requested_by": {"kind": "department", "department": "sales"}, "department": "supply"}
FINDING = {
    "finding_id": "f1", "task_id": "t2", "department": "supply",
    "statements": [{"text": "GMV fell", "evidence": [{"kind": "query", "ref": "/api/v1/kpis/gmv/series"}]}],
    "hypotheses": [{"text": "supplier outage", "confidence": 0.7, "status": "supported",
                    "evidence": [{"kind": "insight", "ref": "insight:1"}]}],
    "no_cause_found": False,
}
ACTION = {
    "action_id": "a1", "trigger": {"kind": "finding", "id": "f1"}, "type": "notify",
    "payload": {"channel": "email", "message": "check supplier"}, "autonomy_level": "L1", "risk": "low",
    "status": "executed", "approved_by": "person:leitung-vertrieb", "result_ref": "mail:1", "error": None,
}
METRICS = {
    "sim_date": "2018-01-10", "role": "department", "department": "sales",
    "metrics": {"runs": 3, "tasks_started": 3, "tasks_completed": 2, "tasks_failed": 1, "error_rate": 0.33,
                "tokens_in": 100, "tokens_out": 50, "cost_eur": 0.01, "spawns_requested": 1,
                "spawns_rejected": {k: 0 for k in C.SPAWN_REJECTIONS}},
}
SNAPSHOT = {"snapshot_id": "s1", "sim_date": "2018-01-10",
            "departments": [{"department": "sales", "score": 0.8, "open_insights": 2}]}


def _df(spark, docs, schema):
    return C.parse(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"), schema)


def _rules(df):
    return sorted((r.id, r.rule) for r in df.collect())


def test_valid_documents_pass(spark):
    tasks = _df(spark, [TASK, CHILD], C.TASK_SCHEMA)
    findings = _df(spark, [FINDING], C.FINDING_SCHEMA)
    actions = _df(spark, [ACTION], C.ACTION_SCHEMA)
    assert _rules(C.task_violations(tasks)) == []
    assert _rules(C.finding_violations(findings)) == []
    assert _rules(C.action_violations(actions)) == []
    assert _rules(C.metrics_violations(_df(spark, [METRICS], C.METRICS_SCHEMA))) == []
    assert _rules(C.snapshot_violations(_df(spark, [SNAPSHOT], C.SNAPSHOT_SCHEMA))) == []
    assert _rules(C.lineage_violations(tasks, findings, actions)) == []


def _mut(doc, path, value):
    d = copy.deepcopy(doc)
    cur = d
    for p in path[:-1]:
        cur = cur[p]
    cur[path[-1]] = value
    return d


@pytest.mark.parametrize(
    "doc, schema, fn, path, value, rule",
    [
        (TASK, C.TASK_SCHEMA, C.task_violations, ["depth"], 2, "parent_iff_depth_1"),
        (TASK, C.TASK_SCHEMA, C.task_violations, ["status"], "failed", "terminal_reason"),
        (TASK, C.TASK_SCHEMA, C.task_violations, ["allowed_tools"], ["kpi_series", "kpi_series"], "tools_unique"),
        (TASK, C.TASK_SCHEMA, C.task_violations, ["allowed_tools"], ["Bad-Tool"], "tools_pattern"),
        (TASK, C.TASK_SCHEMA, C.task_violations, ["budget", "max_steps"], 51, "budget_steps"),
        (FINDING, C.FINDING_SCHEMA, C.finding_violations, ["statements", 0, "evidence"], [], "statement_evidence"),
        (FINDING, C.FINDING_SCHEMA, C.finding_violations, ["hypotheses", 0, "confidence"], 1.5, "confidence_range"),
        (FINDING, C.FINDING_SCHEMA, C.finding_violations, ["hypotheses"], [], "hypothesis_or_no_cause"),
        (FINDING, C.FINDING_SCHEMA, C.finding_violations, ["statements", 0, "evidence", 0, "ref"], "http://x", "query_evidence"),
        (ACTION, C.ACTION_SCHEMA, C.action_violations, ["approved_by"], None, "l1_approved"),
        (ACTION, C.ACTION_SCHEMA, C.action_violations, ["result_ref"], None, "executed_result"),
        (ACTION, C.ACTION_SCHEMA, C.action_violations, ["payload", "secret"], "x", "closed_payload"),
        (METRICS, C.METRICS_SCHEMA, C.metrics_violations, ["department"], None, "department_iff_role"),
        (METRICS, C.METRICS_SCHEMA, C.metrics_violations, ["metrics", "error_rate"], 1.2, "error_rate_range"),
        (SNAPSHOT, C.SNAPSHOT_SCHEMA, C.snapshot_violations, ["departments"], [], "departments_present"),
        (SNAPSHOT, C.SNAPSHOT_SCHEMA, C.snapshot_violations, ["sim_date"], "10.01.2018", "iso_date"),
    ],
)
def test_single_field_mutation_fails(spark, doc, schema, fn, path, value, rule):
    bad = _mut(doc, path, value)
    got = {r for _, r in _rules(fn(_df(spark, [bad], schema)))}
    assert rule in got


def test_action_high_risk_and_l0(spark):
    high = _mut(_mut(ACTION, ["risk"], "high"), ["autonomy_level"], "L2")
    l0 = _mut(ACTION, ["autonomy_level"], "L0")
    got = _rules(C.action_violations(_df(spark, [high, _mut(l0, ["action_id"], "a2")], C.ACTION_SCHEMA)))
    assert ("a1", "high_risk_not_l2") in got and ("a2", "l0_proposal_only") in got


def test_lineage_breaks(spark):
    child = _mut(_mut(CHILD, ["depth"], 3), ["requested_by", "department"], "finance")
    tasks = _df(spark, [TASK, child], C.TASK_SCHEMA)
    findings = _df(spark, [_mut(FINDING, ["department"], "sales")], C.FINDING_SCHEMA)
    actions = _df(spark, [_mut(ACTION, ["trigger", "id"], "missing")], C.ACTION_SCHEMA)
    got = _rules(C.lineage_violations(tasks, findings, actions))
    assert got == [("a1", "trigger_exists"), ("f1", "finding_department"), ("t2", "child_depth"), ("t2", "requester_is_parent_department")]
