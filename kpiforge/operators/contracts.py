"""Contract audits for the agent-side documents (task, finding, action, agent metrics, daily
snapshot) and their cross-document lineage.

Each audit parses a JSON column with an explicit schema and evaluates the contract's rules as
column predicates, returning one row per violation (``id``, ``rule``). A NULL rule result
counts as a violation. The given tables hold no such documents, so these run on whatever
document tables a deployment provides (tests build small ones inline).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED: department codes.
DEPARTMENTS = ["marketing", "sales", "finance", "customer", "supply", "operations", "hr", "projects", "it", "management", "ai_ops"]
TERMINAL_WITH_REASON = ["failed", "budget_exceeded", "rejected", "cancelled"]
TOOL_PATTERN = r"^[a-z][a-z0-9_]*$"
SPAWN_REJECTIONS = ["permission", "depth", "breadth", "budget", "duplicate", "cycle"]
# Payload keys an action of each type may carry (closed payloads).
ACTION_PAYLOAD_KEYS = {"notify": ["channel", "message"], "ticket": ["title", "queue", "priority"], "task": ["task_id"]}

TASK_SCHEMA = (
    "task_id string, parent_task_id string, depth int, requested_by struct<kind: string, department: string>, "
    "department string, allowed_tools array<string>, budget struct<max_steps: int, max_tokens: bigint, max_cost_eur: double>, "
    "status string, status_reason string"
)
EVIDENCE = "array<struct<kind: string, ref: string>>"
FINDING_SCHEMA = (
    f"finding_id string, task_id string, department string, statements array<struct<text: string, evidence: {EVIDENCE}>>, "
    f"hypotheses array<struct<text: string, confidence: double, status: string, evidence: {EVIDENCE}>>, no_cause_found boolean"
)
ACTION_SCHEMA = (
    "action_id string, trigger struct<kind: string, id: string>, type string, payload map<string, string>, "
    "autonomy_level string, risk string, status string, approved_by string, result_ref string, error string"
)
METRICS_SCHEMA = (
    "sim_date string, role string, department string, metrics struct<runs: int, tasks_started: int, tasks_completed: int, "
    "tasks_failed: int, error_rate: double, tokens_in: bigint, tokens_out: bigint, cost_eur: double, "
    "spawns_requested: int, spawns_rejected: map<string, int>>"
)
SNAPSHOT_SCHEMA = (
    "snapshot_id string, sim_date string, departments array<struct<department: string, score: double, open_insights: int>>"
)


def parse(docs: DataFrame, schema: str, col: str = "json") -> DataFrame:
    return docs.select(F.from_json(F.col(col), schema).alias("d")).select("d.*")


def _violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    checks = F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(checks)).alias("rule"))


def task_violations(tasks: DataFrame) -> DataFrame:
    """depth/parent consistency, department requester named, reasons for terminal states,
    tool names valid, non-empty and unique, step budget 1..50."""
    tools = F.coalesce(F.col("allowed_tools"), F.array().cast("array<string>"))
    return _violations(tasks, "task_id", {
        "parent_iff_depth_1": F.col("parent_task_id").isNull() == (F.col("depth") == 1),
        "spawn_depth": F.col("parent_task_id").isNull() | (F.col("depth") >= 2),
        "department_requester_named": (F.col("requested_by.kind") != "department") | F.col("requested_by.department").isin(DEPARTMENTS),
        "department": F.col("department").isin(DEPARTMENTS),
        "terminal_reason": ~F.col("status").isin(TERMINAL_WITH_REASON) | (F.length(F.trim(F.col("status_reason"))) > 0),
        "tools_non_empty": F.size(tools) > 0,
        "tools_unique": F.size(F.array_distinct(tools)) == F.size(tools),
        "tools_pattern": F.forall(tools, lambda t: t.rlike(TOOL_PATTERN)),
        "budget_steps": F.col("budget.max_steps").between(1, 50),
    })


def _queries_ok(evidence: Column) -> Column:
    ev = F.coalesce(evidence, F.array().cast(EVIDENCE))
    return F.forall(ev, lambda e: (e["kind"] != "query") | e["ref"].startswith("/api/v1/"))


def finding_violations(findings: DataFrame) -> DataFrame:
    """Statements carry evidence, supported hypotheses carry evidence, a cause-less
    finding says so (else at least one hypothesis), confidences in [0, 1], query evidence
    points at the API."""
    st = F.coalesce(F.col("statements"), F.array().cast(f"array<struct<text: string, evidence: {EVIDENCE}>>"))
    hy = F.coalesce(F.col("hypotheses"), F.array().cast(f"array<struct<text: string, confidence: double, status: string, evidence: {EVIDENCE}>>"))
    return _violations(findings, "finding_id", {
        "statement_evidence": F.forall(st, lambda s: F.size(F.coalesce(s["evidence"], F.array())) >= 1),
        "supported_hypothesis_evidence": F.forall(hy, lambda h: (h["status"] != "supported") | (F.size(F.coalesce(h["evidence"], F.array())) >= 1)),
        "hypothesis_or_no_cause": F.col("no_cause_found") | (F.size(hy) >= 1),
        "confidence_range": F.forall(hy, lambda h: h["confidence"].between(0, 1)),
        "query_evidence": F.forall(st, lambda s: _queries_ok(s["evidence"])) & F.forall(hy, lambda h: _queries_ok(h["evidence"])),
        "department": F.col("department").isin(DEPARTMENTS),
    })


def action_violations(actions: DataFrame) -> DataFrame:
    """Autonomy and risk rules, approvals, results and errors by status, closed payloads."""
    def key_in(keys: list[str]):
        return lambda k: k.isin(keys)

    allowed = None
    for typ, keys in ACTION_PAYLOAD_KEYS.items():
        cond = F.forall(F.map_keys(F.col("payload")), key_in(keys))
        allowed = F.when(F.col("type") == typ, cond) if allowed is None else allowed.when(F.col("type") == typ, cond)
    allowed = allowed.otherwise(F.lit(False))
    return _violations(actions, "action_id", {
        "high_risk_not_l2": ~((F.col("risk") == "high") & (F.col("autonomy_level") == "L2")),
        "l1_approved": ~((F.col("autonomy_level") == "L1") & F.col("status").isin("approved", "executed", "failed"))
        | F.col("approved_by").isNotNull(),
        "l0_proposal_only": (F.col("autonomy_level") != "L0") | F.col("status").isin("proposed", "rejected"),
        "executed_result": (F.col("status") != "executed") | F.col("result_ref").isNotNull(),
        "failed_error": (F.col("status") != "failed") | F.col("error").isNotNull(),
        "closed_payload": allowed,
    })


def metrics_violations(metrics: DataFrame) -> DataFrame:
    """Department iff department role, non-negative counters, error rate in [0, 1], all
    six spawn-rejection counters, one record per (sim_date, role, department)."""
    m = metrics.select("*", F.concat_ws("|", "sim_date", "role", F.coalesce("department", F.lit("-"))).alias("key"))
    counters = ["runs", "tasks_started", "tasks_completed", "tasks_failed", "tokens_in", "tokens_out", "spawns_requested"]
    rej = F.coalesce(F.col("metrics.spawns_rejected"), F.create_map().cast("map<string,int>"))
    rules = {
        "department_iff_role": (F.col("role") == "department") == F.col("department").isNotNull(),
        "counters_non_negative": functools.reduce(lambda a, b: a & b, [F.col(f"metrics.{c}") >= 0 for c in counters]),
        "error_rate_range": F.col("metrics.error_rate").isNull() | F.col("metrics.error_rate").between(0, 1),
        "cost_non_negative": F.col("metrics.cost_eur") >= 0,
        "rejection_counters": F.forall(F.array(*[F.lit(k) for k in SPAWN_REJECTIONS]), lambda k: rej[k].isNotNull()),
    }
    v = _violations(m, "key", rules)
    dup = m.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("id"), F.lit("unique_record").alias("rule"))
    return v.unionByName(dup)


def snapshot_violations(snaps: DataFrame) -> DataFrame:
    """At least one department, department codes, scores in [0, 1], ISO date."""
    deps = F.coalesce(F.col("departments"), F.array().cast("array<struct<department: string, score: double, open_insights: int>>"))
    return _violations(snaps, "snapshot_id", {
        "departments_present": F.size(deps) >= 1,
        "department_codes": F.forall(deps, lambda d: d["department"].isin(DEPARTMENTS)),
        "score_range": F.forall(deps, lambda d: d["score"].isNull() | d["score"].between(0, 1)),
        "iso_date": F.col("sim_date").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "open_insights_non_negative": F.forall(deps, lambda d: d["open_insights"] >= 0),
    })


def lineage_violations(tasks: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Child depth = parent depth + 1 and the child's requester is the parent's
    department (self-join on the parent id); a finding's department is its task's; an action
    triggered by a finding points at an existing one."""
    parent = tasks.select(F.col("task_id").alias("parent_task_id"), F.col("depth").alias("p_depth"), F.col("department").alias("p_dept"))
    child = tasks.filter(F.col("parent_task_id").isNotNull()).join(parent, "parent_task_id", "left")
    c = _violations(child, "task_id", {
        "parent_exists": F.col("p_depth").isNotNull(),
        "child_depth": F.col("depth") == F.col("p_depth") + 1,
        "requester_is_parent_department": F.col("requested_by.department") == F.col("p_dept"),
    })
    f = findings.join(tasks.select("task_id", F.col("department").alias("t_dept")), "task_id", "left")
    fv = _violations(f, "finding_id", {"finding_department": F.col("department") == F.col("t_dept")})
    a = actions.filter(F.col("trigger.kind") == "finding").join(
        findings.select(F.col("finding_id").alias("tid"), F.lit(True).alias("found")), F.col("trigger.id") == F.col("tid"), "left"
    )
    av = _violations(a, "action_id", {"trigger_exists": F.col("found")})
    return c.unionByName(fv).unionByName(av)
