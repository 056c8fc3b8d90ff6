"""Analyst context: computed, formatted KPI facts for every as-of day (no raw rows, no free
text), each citable by id.

* week change: last 7 days vs the 7 before, per KPI total, from range-window sums over the
  day number (one pass; partitions are per KPI and bounded by the calendar);
* top drivers: members present in both windows; additive KPIs ranked by absolute change,
  ratios first narrowed to the 10 largest by volume, then ranked by |change %|;
* monthly entries and the nested context document (one row per as-of day, lists bounded by
  the number of KPIs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions.columns import latest_complete_month
from kpiforge.operators import anomaly, kpi
from kpiforge.operators.outbox import format_signed_pct, format_value

WINDOW = 7
TOP_DRIVERS = 3
RATIO_CANDIDATES = 10
MAX_ANOMALIES = 20
ALLOWED_CLASSES = ["public", "internal"]


def day_num(c: Column) -> Column:
    return anomaly.day_number(c)


def _pct(cur: Column, prev: Column) -> Column:
    # + 0.0 turns a negative zero into 0.0 (a tiny negative change rounds to "±0,0 %").
    return F.when(cur.isNotNull() & prev.isNotNull() & (prev != 0), F.round((cur - prev) / F.abs(prev) * 100, 1) + F.lit(0.0))


def _value(num: Column, den: Column, cnt: Column, additive: Column) -> Column:
    return F.when(cnt > 0, F.when(additive, num.cast("double")).otherwise(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))))


@model
def daily_registry(ctx: Ctx) -> DataFrame:
    reg = anomaly.registry(ctx)
    return reg.filter((F.col("grain") == "day") & F.col("data_class").isin(ALLOWED_CLASSES)).select(
        F.col("key").alias("kpi_key"), "label", "unit", "direction", "data_origin", "data_class", "entity_type"
    )


@model
def week_change(ctx: Ctx) -> DataFrame:
    """For every as-of day with a total row: last 7 days, previous 7 days, change."""
    reg = F.broadcast(daily_registry(ctx))
    d = kpi.kpi_daily(ctx).filter(F.col("dimension") == "total").join(reg, "kpi_key")
    d = d.select("*", day_num(F.col("kpi_date")).alias("dn"), (F.col("aggregation") == "sum").alias("additive"))
    by_day = Window.partitionBy("kpi_key").orderBy("dn")
    cur = by_day.rangeBetween(-(WINDOW - 1), 0)
    prev = by_day.rangeBetween(-(2 * WINDOW - 1), -WINDOW)
    w = d.select(
        "kpi_key", "label", "unit", "data_class", F.col("kpi_date").alias("as_of"),
        _value(F.sum("numerator").over(cur), F.sum("denominator").over(cur), F.count(F.lit(1)).over(cur), F.col("additive")).alias("last_7_days"),
        _value(F.sum("numerator").over(prev), F.sum("denominator").over(prev), F.count(F.lit(1)).over(prev), F.col("additive")).alias("previous_7_days"),
    )
    w = w.select("*", _pct(F.col("last_7_days"), F.col("previous_7_days")).alias("change_pct"))
    return w.select(
        "kpi_key", "as_of", "last_7_days", "previous_7_days", "change_pct",
        F.concat(F.lit("kpi:"), F.col("kpi_key")).alias("id"),
        format_value(F.col("last_7_days"), F.col("unit")).alias("last_7_days_text"),
        format_value(F.col("previous_7_days"), F.col("unit")).alias("previous_7_days_text"),
        format_signed_pct(F.col("change_pct")).alias("change_text"),
        "label", "data_class",
    )


@model
def top_drivers(ctx: Ctx) -> DataFrame:
    """Top 3 members behind each KPI's week change, for every as-of day."""
    reg = F.broadcast(daily_registry(ctx).filter(F.col("entity_type").isNotNull()))
    d = kpi.kpi_daily(ctx).join(reg, "kpi_key").filter(F.col("dimension") == F.col("entity_type"))
    keys = ["kpi_key", "dimension", "dimension_value"]
    additive = d.groupBy("kpi_key").agg(F.bool_and(F.col("aggregation") == "sum").alias("additive"))
    spans = d.groupBy(*keys).agg(F.min("kpi_date").alias("first_day"))
    spine = spans.select(
        *keys, F.explode(F.sequence("first_day", F.lit(ctx.sim_date), F.expr("INTERVAL 1 DAY"))).alias("kpi_date")
    )
    dense = spine.join(d.select(*keys, "kpi_date", "numerator", "denominator"), [*keys, "kpi_date"], "left").join(
        F.broadcast(additive), "kpi_key"
    )
    by_day = Window.partitionBy(*keys).orderBy("kpi_date")
    cur = by_day.rowsBetween(-(WINDOW - 1), 0)
    prev = by_day.rowsBetween(-(2 * WINDOW - 1), -WINDOW)
    m = dense.select(
        *keys, F.col("kpi_date").alias("as_of"), "additive",
        _value(F.sum("numerator").over(cur), F.sum("denominator").over(cur), F.count("numerator").over(cur), F.col("additive")).alias("cur"),
        _value(F.sum("numerator").over(prev), F.sum("denominator").over(prev), F.count("numerator").over(prev), F.col("additive")).alias("prev"),
        F.coalesce(F.sum("denominator").over(cur), F.sum("numerator").over(cur), F.lit(0)).cast("double").alias("volume"),
    )
    m = m.filter(F.col("cur").isNotNull() & F.col("prev").isNotNull())
    by_vol = Window.partitionBy("kpi_key", "dimension", "as_of").orderBy(F.col("volume").desc(), F.col("dimension_value"))
    m = m.withColumn("vol_rank", F.row_number().over(by_vol)).filter(F.col("additive") | (F.col("vol_rank") <= RATIO_CANDIDATES))
    m = m.select("*", _pct(F.col("cur"), F.col("prev")).alias("change_pct")).filter(F.col("change_pct").isNotNull())
    strength = F.when(F.col("additive"), F.abs(F.col("cur") - F.col("prev"))).otherwise(F.abs(F.col("change_pct")))
    by_move = Window.partitionBy("kpi_key", "dimension", "as_of").orderBy(strength.desc(), F.col("dimension_value"))
    top = m.withColumn("driver_rank", F.row_number().over(by_move)).filter(F.col("driver_rank") <= TOP_DRIVERS)
    return top.select(
        "kpi_key", "as_of", "driver_rank",
        F.concat(F.col("dimension"), F.lit(":"), F.col("dimension_value")).alias("id"),
        F.round("cur", 6).alias("last_7_days"), F.round("prev", 6).alias("previous_7_days"), "change_pct",
    )


@model
def monthly_entries(ctx: Ctx) -> DataFrame:
    """Every complete month's total of the monthly KPIs, formatted."""
    reg = anomaly.registry(ctx).filter((F.col("grain") == "month") & F.col("data_class").isin(ALLOWED_CLASSES))
    reg = F.broadcast(reg.select(F.col("key").alias("kpi_key"), "label", "unit", "data_origin", "data_class"))
    m = kpi.kpi_monthly(ctx).filter((F.col("dimension") == "total") & F.col("is_complete")).join(reg, "kpi_key")
    return m.select(
        "kpi_key", "month_start",
        F.concat(F.lit("kpi:"), F.col("kpi_key")).alias("id"),
        "label", "data_origin",
        F.date_format("month_start", "MM/yyyy").alias("month"),
        format_value(F.col("value"), F.col("unit")).alias("value_text"),
        "data_class",
    )


def highest_class(classes: Column) -> Column:
    """A27 (aggregate): the highest data class in a group, 'public' when empty."""
    rank = F.when(classes == "confidential", 2).when(classes == "internal", 1).when(classes == "public", 0)
    return F.coalesce(F.max_by(classes, rank), F.lit("public"))


def recent_anomalies(findings: DataFrame) -> DataFrame:
    """E09/L08 for every as-of day: the findings that ended on it or the day before, critical ones first, then by
    creation, at most MAX_ANOMALIES."""
    visible = findings.filter((F.col("type") == "anomaly") & F.col("data_class").isin(ALLOWED_CLASSES))
    fields = ["event_id", "severity", "summary", "created_at", "data_class"]
    both = visible.select(F.col("period_end").alias("as_of"), *fields).unionByName(
        visible.select(F.date_add("period_end", 1).alias("as_of"), *fields)
    )
    order = Window.partitionBy("as_of").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "created_at", "event_id")
    ranked = both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MAX_ANOMALIES)
    return ranked.select("as_of", "place", F.concat(F.lit("insight:"), F.col("event_id")).alias("id"), "severity", "summary", "data_class")


def context_entries(ctx: Ctx, findings: DataFrame) -> DataFrame:
    """Every entry of each as-of day's context as a row: KPIs with direction and data origin, their
    drivers (``parent``: the KPI's id), the latest complete month, recent anomalies."""
    reg = F.broadcast(daily_registry(ctx).select("kpi_key", "unit", "direction", "data_origin"))
    text = lambda x=None: (F.lit(None) if x is None else x).cast("string")

    def rows(df: DataFrame, section: str, place: Column, **fields: Column) -> DataFrame:
        names = ("parent", "label", "direction", "data_origin", "current", "previous", "change", "severity", "data_class")
        return df.select(
            "as_of", F.lit(section).alias("section"), place.cast("int").alias("place"), "id", *[text(fields.get(n)).alias(n) for n in names]
        )

    week = week_change(ctx).join(reg, "kpi_key")
    parts = [
        rows(week, "kpi", F.lit(0), label=F.col("label"), direction=F.col("direction"), data_origin=F.col("data_origin"),
             current=F.col("last_7_days_text"), previous=F.col("previous_7_days_text"), change=F.col("change_text"),
             data_class=F.col("data_class")),
    ]
    known = week_change(ctx).select("kpi_key", "as_of")
    drivers = top_drivers(ctx).join(reg, "kpi_key").join(known, ["kpi_key", "as_of"], "left_semi")
    parts.append(rows(
        drivers, "driver", F.col("driver_rank"), parent=F.concat(F.lit("kpi:"), F.col("kpi_key")),
        current=format_value(F.col("last_7_days"), F.col("unit")), previous=format_value(F.col("previous_7_days"), F.col("unit")),
        change=format_signed_pct(F.col("change_pct")),
    ))
    days = week_change(ctx).select("as_of", latest_complete_month(F.col("as_of")).alias("month_start")).distinct()
    parts.append(rows(
        days.join(monthly_entries(ctx), "month_start"), "month", F.lit(0), label=F.col("label"), data_origin=F.col("data_origin"),
        current=F.col("value_text"), previous=F.col("month"), data_class=F.col("data_class"),
    ))
    recent = recent_anomalies(findings).join(days.select("as_of"), "as_of", "left_semi")
    parts.append(rows(recent, "anomaly", F.col("place"), label=F.col("summary"), severity=F.col("severity"), data_class=F.col("data_class")))
    return reduce(DataFrame.unionByName, parts)


def context_document(entries: DataFrame) -> DataFrame:
    """One nested document per as-of day from its entries, as JSON: KPIs with their drivers, the latest complete
    month, anomalies. Its data class is the highest of everything that it holds."""
    own = entries.filter(F.col("section") == "driver").groupBy("as_of", "parent").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "current", "previous", "change"))).alias("drivers")
    ).select("as_of", F.col("parent").alias("id"), "drivers")
    rest = entries.filter(F.col("section") != "driver").join(own, ["as_of", "id"], "left")
    of = lambda section, *cols: F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct(*cols))))
    doc = rest.groupBy("as_of").agg(
        of("kpi", "id", "label", "direction", "data_origin", "current", "previous", "change", "drivers").alias("k"),
        of("month", "id", "label", "data_origin", "previous", "current").alias("m"),
        of("anomaly", "place", "id", "severity", "label").alias("a"),
        highest_class(F.col("data_class")).alias("data_class"),
        F.bool_or((F.col("section") == "anomaly") & (F.col("severity") == "critical")).alias("any_critical"),
    )
    week = lambda x: [x["current"].alias("last_7_days"), x["previous"].alias("previous_7_days"), x["change"].alias("change")]
    driver = lambda d: F.struct(d["id"].alias("id"), *week(d))
    body = F.struct(
        F.col("as_of").cast("string").alias("date"),
        F.lit(f"letzte {WINDOW} Tage gegenüber den {WINDOW} Tagen davor").alias("comparison"),
        F.transform("k", lambda k: F.struct(
            k["id"].alias("id"), k["label"].alias("label"), k["direction"].alias("direction"), k["data_origin"].alias("data_origin"),
            *week(k), F.transform(k["drivers"], driver).alias("top_drivers"))).alias("kpis"),
        F.transform("m", lambda m: F.struct(
            m["id"].alias("id"), m["label"].alias("label"), m["data_origin"].alias("data_origin"), m["previous"].alias("month"),
            m["current"].alias("value"))).alias("monthly_kpis"),
        F.transform("a", lambda a: F.struct(a["id"].alias("id"), a["severity"].alias("severity"), a["label"].alias("summary"))).alias("anomalies"),
        "data_class",
    )
    briefing = F.when(F.coalesce(F.col("any_critical"), F.lit(False)), F.lit("warning")).otherwise(F.lit("info"))
    return doc.select("as_of", "data_class", briefing.alias("briefing_severity"), F.to_json(body).alias("document"))


def unsupported_evidence(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations (as_of, finding, ref) whose id no entry of that day's context has."""
    ids = entries.select("as_of", F.col("id").alias("ref")).distinct()
    return cited.join(ids, ["as_of", "ref"], "left_anti").select("as_of", "finding", "ref")


def briefing_events(documents: DataFrame) -> DataFrame:
    """One 'briefing' insight per as-of day from its context document (severity from E12,
    class from A27); ids and times derived from the dedup key, like the other insights."""
    key = F.concat_ws(":", F.lit("briefing"), F.lit("-"), F.lit("-"), F.lit("day"), F.col("as_of").cast("string"), F.col("as_of").cast("string"))
    h = F.sha2(key, 256)
    event_id = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    created = F.to_timestamp_ntz(F.concat(F.date_add("as_of", 1).cast("string"), F.lit(" 07:00:00")))
    day = F.col("as_of").cast("string")
    payload = F.to_json(F.struct(
        F.lit(config.SCHEMA_VERSION).alias("schema_version"), event_id.alias("insight_id"), F.lit(config.EVENT_SOURCE).alias("source"),
        F.lit("briefing").alias("type"), F.struct(day.alias("start"), day.alias("end"), F.lit("day").alias("grain")).alias("period"),
        F.col("briefing_severity").alias("severity"), F.array().cast("array<string>").alias("entity_refs"),
        F.struct(F.lit("context").alias("method")).alias("evidence"),
        F.concat(F.lit("Briefing "), F.date_format("as_of", "dd.MM.yyyy")).alias("summary"), "data_class",
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.struct(F.parse_json("document").alias("context"), F.lit("context.v1").alias("format")).alias("details"),
    ))
    return documents.select(
        event_id.alias("event_id"),
        F.lit("insight").alias("event_type"),
        key.alias("dedup_key"),
        F.lit("briefing").alias("type"),
        F.lit(None).cast("string").alias("kpi"),
        F.col("as_of").alias("period_start"),
        F.col("as_of").alias("period_end"),
        F.col("briefing_severity").alias("severity"),
        "data_class",
        created.alias("created_at"),
        payload.alias("payload"),
    )


def entity_split(entity: Column) -> tuple[Column, Column]:
    """(type, key) of a '<type>:<key>' id, split at the first ':'."""
    return F.substring_index(entity, ":", 1), F.regexp_extract(entity, r"^[^:]*:(.*)$", 1)


def check_violations(name: str, df: DataFrame, predicate: Column) -> DataFrame:
    """Rows breaking a CHECK predicate (NULL passes, like a SQL CHECK)."""
    return df.filter(F.coalesce(~predicate, F.lit(False))).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def ingest_checks(log: DataFrame) -> DataFrame:
    """Per entity, rows present (fail if none) and new rows in the latest load (warn
    if none)."""
    latest = Window.partitionBy("source", "entity").orderBy(F.col("finished_at").desc(), F.col("load_id").desc())
    last = log.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").select(
        "source", "entity", F.col("rows_loaded").alias("new_rows")
    )
    total = log.groupBy("source", "entity").agg(F.sum("rows_loaded").alias("rows_present"))
    j = total.join(last, ["source", "entity"])
    return j.select(
        "source", "entity", "rows_present", "new_rows",
        F.when(F.col("rows_present") > 0, F.lit("pass")).otherwise(F.lit("fail")).alias("rows_present_check"),
        F.when(F.col("new_rows") > 0, F.lit("pass")).otherwise(F.lit("warn")).alias("new_rows_check"),
    )


MAX_INSIGHT_LINK_DAYS = {"day": 30, "month": 365}
