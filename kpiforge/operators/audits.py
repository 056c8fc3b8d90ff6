"""Audits: insight.v1 payload conformance, number provenance of generated text, provider
routing by data class, draft acceptance, registry rules.

All are column predicates / explodes over whole tables; regexes run JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.functions.payload import Member, Shape, is_object, violations
from kpiforge.operators.quality import ENTITY_PATTERNS

# FIXED: date and German-number token patterns (numbers: '.' thousands groups, ',' decimals).
DATE_PATTERN = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b|\b\d{1,2}/\d{4}\b"
NUMBER_PATTERN = r"(?<![\d,.])[-−+]?\d{1,3}(?:\.\d{3})+(?:,\d+)?(?![\d])|(?<![\d,.])[-−+]?\d+(?:,\d+)?(?![\d])"

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _valid_entity(id_: Column) -> Column:
    typ = F.substring_index(id_, ":", 1)
    ok = F.lit(False)
    for name, pattern in ENTITY_PATTERNS.items():
        ok = ok | ((typ == name) & id_.rlike(pattern))
    return ok


# FIXED: members of insight.v1, of its period, evidence and entity references.
_DAY, _TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
INSIGHT = Shape({
    "schema_version": Member(("string",), True, (config.SCHEMA_VERSION,)),
    "insight_id": Member(("string",), True, pattern=UUID),
    "source": Member(("string",), True, (config.EVENT_SOURCE,)),
    "type": Member(("string",), True, ("anomaly", "briefing", "forecast_deviation", "data_quality")),
    "kpi": Member(("string", "null"), pattern=r"^[a-z][a-z0-9_]*$"),
    "period": Member(("object",), True),
    "severity": Member(("string",), True, ("info", "warning", "critical")),
    "direction": Member(("string", "null"), values=("up", "down")),
    "observed": Member(("number", "null")),
    "expected": Member(("number", "null")),
    "deviation_pct": Member(("number", "null")),
    "entity_refs": Member(("array",)),
    "evidence": Member(("object",), True),
    "context_ref": Member(("string", "null")),
    "summary": Member(("string",), True, least=1),
    "data_class": Member(("string",), True, ("public", "internal", "confidential")),
    "created_at": Member(("string",), True, pattern=_TIME),
    "details": Member(("object", "null")),
})
PERIOD = Shape({
    "start": Member(("string",), True, pattern=_DAY), "end": Member(("string",), True, pattern=_DAY),
    "grain": Member(("string",), True, ("day", "month")),
})
EVIDENCE = Shape({
    "method": Member(("string",), True), "score": Member(("number", "null")), "query_ref": Member(("string", "null")),
}, closed=False)
ENTITY_REF = Shape({"type": Member(("string",), True, tuple(ENTITY_PATTERNS)), "id": Member(("string",), True)})


def insight_contract_violations(events: DataFrame) -> DataFrame:
    """Insight.v1 rules on the JSON payload -> (event_id, rule) per violation.

    The objects at every level are walked by their own keys: unknown members of closed objects, missing
    ones, types, allowed values and patterns; then the order of the period and the ids' namespaces.
    """
    at = lambda path: F.get_json_object("payload", f"$.{path}")
    refs = F.coalesce(F.from_json(at("entity_refs"), "array<variant>"), F.array())
    broken = F.flatten(F.array(
        F.when(is_object(F.col("payload")), F.array()).otherwise(F.array(F.lit("payload: type"))),
        violations(F.col("payload"), INSIGHT),
        F.when(is_object(at("period")), violations(at("period"), PERIOD, "period")).otherwise(F.array()),
        F.when(is_object(at("evidence")), violations(at("evidence"), EVIDENCE, "evidence")).otherwise(F.array()),
        F.flatten(F.transform(refs, lambda r: F.when(is_object(F.to_json(r)), violations(F.to_json(r), ENTITY_REF, "entity_refs[]")).otherwise(
            F.array(F.lit("entity_refs[]: type"))))),
        F.transform(
            F.filter(refs, lambda r: ~F.coalesce(_valid_entity(F.try_variant_get(r, "$.id", "string")), F.lit(False))),
            lambda r: F.lit("entity_refs"),
        ),
        F.when(at("period.start") > at("period.end"), F.array(F.lit("period: order"))).otherwise(F.array()),
    ))
    return events.select("event_id", F.explode(F.array_distinct(broken)).alias("rule"))


def _magnitude(token: Column) -> Column:
    """A number token without sign and thousands marks: digits, or digits,decimals."""
    return F.regexp_replace(token, "[-−+.]", "")


def _decimals(magnitude: Column) -> Column:
    return F.regexp_extract(magnitude, ",(.*)$", 1)


def _scaled(magnitude: Column, k: Column) -> Column:
    """The number times 10^k, rounded half-up: its digits up to the k-th decimal as an integer,
    plus one where the next decimal is 5 or more."""
    whole, decimals = F.substring_index(magnitude, ",", 1), _decimals(magnitude)
    kept = F.concat(whole, F.rpad(F.substring(decimals, F.lit(1), k), k, "0")).try_cast("decimal(38,0)")
    return kept + F.when(F.substring(decimals, k + 1, F.lit(1)) >= "5", 1).otherwise(0)


def _rounds_to(allowed: Column, magnitude: Column) -> Column:
    """Some allowed number, rounded half-up to the token's decimals (however many), equals it.
    Numbers of more than 38 digits must be spelled alike."""
    k = F.length(_decimals(magnitude))
    own = _scaled(magnitude, k)
    return F.exists(allowed, lambda a: F.coalesce(_scaled(a, k) == own, a == magnitude))


def number_provenance(outputs: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Dates and numbers in generated text that the source does not support.
    ``outputs`` / ``sources``: keys + text. Dates must occur verbatim in the source (each reported
    once per text); numbers match a source value rounded half-up to the token's decimals."""
    src = sources.select(
        *keys,
        F.regexp_extract_all("text", F.lit(DATE_PATTERN), 0).alias("src_dates"),
        F.transform(
            F.regexp_extract_all(F.regexp_replace("text", DATE_PATTERN, " "), F.lit(NUMBER_PATTERN), 0), _magnitude
        ).alias("allowed"),
    )
    out = outputs.select(
        *keys,
        F.array_distinct(F.regexp_extract_all("text", F.lit(DATE_PATTERN), 0)).alias("dates"),
        F.regexp_extract_all(F.regexp_replace("text", DATE_PATTERN, " "), F.lit(NUMBER_PATTERN), 0).alias("numbers"),
    ).join(src, keys, "left")
    dates = out.select(*keys, F.explode("dates").alias("token"), "src_dates").filter(
        ~F.array_contains(F.coalesce("src_dates", F.array().cast("array<string>")), F.col("token"))
    ).select(*keys, "token", F.lit("date").alias("kind"))
    nums = out.select(*keys, F.posexplode("numbers").alias("position", "token"), "allowed")
    ok = _rounds_to(F.coalesce("allowed", F.array().cast("array<string>")), _magnitude(F.col("token")))
    bad_nums = nums.filter(~F.coalesce(ok, F.lit(False))).select(*keys, "token", F.lit("number").alias("kind"))
    return dates.unionByName(bad_nums)


# Providers and the data classes they are cleared for (configuration).
PROVIDERS = [("mistral", ["public", "internal"]), ("anthropic", ["public"]), ("local", ["public", "internal", "confidential"])]


def route_audit(prompts: DataFrame) -> DataFrame:
    """Every (prompt, provider) pair with the verdict; providers are a handful of config
    rows, unrolled with a union (no cross join)."""
    parts = [
        prompts.select("*", F.lit(name).alias("provider"), F.col("data_class").isin(list(allowed)).alias("allowed"))
        for name, allowed in PROVIDERS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def draft_acceptance(problems: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per conversation, the first of its drafts without unsupported numbers or dates, and
    the drafts rejected before it (all of them where none passes)."""
    bad = problems.select("conv_id", "turn").distinct().withColumn("_bad", F.lit(True))
    order = Window.partitionBy("conv_id").orderBy("turn")
    d = drafts.select("conv_id", "turn", F.row_number().over(order).alias("attempt"))
    accepted = F.min(F.when(F.col("_bad").isNull(), F.col("attempt")))
    return d.join(bad, ["conv_id", "turn"], "left").groupBy("conv_id").agg(
        accepted.alias("accepted_attempt"),
        F.coalesce(accepted.cast("long") - 1, F.count(F.lit(1))).alias("rejected_attempts"),
    )


def registry_rule_violations(reg: DataFrame) -> DataFrame:
    """Registry row rules -> (key, rule) per violation."""
    rules = {
        "key_pattern": F.col("key").rlike(r"^[a-z][a-z0-9_]*$"),
        "owner_pattern": F.col("owner").rlike(r"^person:[a-z0-9]+(-[a-z0-9]+)*$"),
        "entity_type_in_dimensions": F.col("entity_type").isNull() | F.array_contains("dimensions", F.col("entity_type")),
        "grain_matches_source": F.when(F.col("grain") == "day", F.col("source") == "marts.kpi_daily").otherwise(
            F.col("source") == "marts.kpi_monthly"
        ),
        "no_duplicate_dimensions": F.size(F.array_distinct("dimensions")) == F.size("dimensions"),
        "stl_needs_history": ~F.col("alert_method").eqNullSafe("stl_mad") | (F.col("min_history_days") >= 14),
        "threshold_has_no_history": ~F.col("alert_method").eqNullSafe("threshold") | F.col("min_history_days").isNull(),
        "threshold_positive": F.col("alert_method").isNull() | (F.col("alert_threshold") > 0),
        "unit": F.col("unit").isin("BRL", "count", "ratio", "multiple", "days", "score"),
        "data_class": F.col("data_class").isin("public", "internal", "confidential"),
    }
    checks = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    dup = Window.partitionBy("key")
    flagged = reg.select("*", F.count(F.lit(1)).over(dup).alias("_n"))
    out = flagged.select("key", F.explode(F.array_compact(checks)).alias("rule"))
    dups = flagged.filter(F.col("_n") > 1).select("key", F.lit("duplicate_key").alias("rule")).distinct()
    return out.unionByName(dups)
