"""Registered queries: contract, provenance and routing audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.context import Ctx
from kpiforge.operators import analyst, anomaly, audits, outbox
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import with_ctes
from kpiforge.plans.queries_context import documents


def _turn_pairs(ctx: Ctx) -> tuple[DataFrame, DataFrame]:
    """Assistant turns (drafts) and, as their source, the turn right before them (equi-join
    on (conversation, turn - 1); whole texts)."""
    c = ctx.tables.conversations
    drafts = c.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    sources = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return drafts, sources


@register("contract_insight_audit")
def contract_insight_audit(ctx: Ctx) -> DataFrame:
    """Insight.v1 rules over the payloads of every finding (daily and monthly)."""
    found = outbox.insight_rows(anomaly.detect_daily(ctx).unionByName(anomaly.detect_monthly(ctx)))
    return audits.insight_contract_violations(found)


@register("number_provenance")
def number_provenance(ctx: Ctx) -> DataFrame:
    """Numbers and dates of each assistant turn not supported by the turn before
    (Java-regex lookbehind tokens; rows-only check)."""
    drafts, sources = _turn_pairs(ctx)
    return audits.number_provenance(drafts, sources, ["conv_id", "turn"])


@register("draft_acceptance")
def draft_acceptance(ctx: Ctx) -> DataFrame:
    """First draft per conversation that passes the number audit, and the drafts rejected
    before it (conversations name no evidence, so F41 has nothing to check)."""
    drafts, sources = _turn_pairs(ctx)
    problems = audits.number_provenance(drafts, sources, ["conv_id", "turn"])
    return audits.draft_acceptance(problems, drafts)


_ALLOWED_SQL = " ".join(
    f"WHEN '{name}' THEN p.data_class IN ({', '.join(repr(c) for c in classes)})" for name, classes in audits.PROVIDERS
)
_PROVIDERS_SQL = ", ".join(f"('{name}')" for name, _ in audits.PROVIDERS)


@register("class_route_audit", with_ctes(
    f"""SELECT p.as_of, p.data_class, v.provider, CASE v.provider {_ALLOWED_SQL} END AS allowed
        FROM (SELECT as_of, CASE max(rank) WHEN 2 THEN 'confidential' WHEN 1 THEN 'internal' ELSE 'public' END AS data_class
              FROM (SELECT as_of, CASE data_class WHEN 'confidential' THEN 2 WHEN 'internal' THEN 1 ELSE 0 END AS rank
                    FROM (SELECT as_of, data_class FROM week_change
                          UNION ALL
                          SELECT w.as_of, m.data_class FROM (SELECT DISTINCT as_of FROM week_change) w JOIN monthly_entries m
                            ON m.month_start = CASE WHEN last_day(w.as_of) = w.as_of THEN date_trunc('month', w.as_of)
                                                    ELSE date_trunc('month', w.as_of) - INTERVAL 1 MONTH END
                          UNION ALL
                          SELECT w.as_of, i.data_class FROM (SELECT DISTINCT as_of FROM week_change) w JOIN insight_rows i
                            ON w.as_of - i.period_end BETWEEN 0 AND 1
                          WHERE i.type = 'anomaly' AND i.data_class IN ('public', 'internal')) x) y
              GROUP BY as_of) p
        CROSS JOIN (VALUES {_PROVIDERS_SQL}) v(provider)""", "week_change", "monthly_entries", "insight_rows"))
def class_route_audit(ctx: Ctx) -> DataFrame:
    """The data class of each day's analyst prompt against every provider's clearance
    (prompt class = highest class of all that its context document holds)."""
    prompts = documents(ctx).select("as_of", "data_class")
    return audits.route_audit(prompts)
