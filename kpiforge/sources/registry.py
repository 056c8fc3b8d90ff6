"""KPI registry source: YAML -> validated rows -> small DataFrame (bounded by the number of
KPIs, so it may be broadcast)."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

REGISTRY_FILE = Path(__file__).resolve().parent / "registry.yaml"

REGISTRY_SCHEMA = (
    "key string, label string, source string, grain string, unit string, direction string, "
    "dimensions array<string>, entity_type string, alert_method string, alert_threshold double, "
    "min_history_days int, data_origin string, data_class string, owner string"
)

_ALLOWED = {
    "key", "label", "description", "source", "grain", "unit", "direction", "dimensions",
    "entity_type", "alert", "data_origin", "data_class", "owner",
}


def load_entries(path: Path = REGISTRY_FILE) -> list[dict]:
    entries = yaml.safe_load(path.read_text(encoding="utf-8")) or []
    for e in entries:
        unknown = set(e) - _ALLOWED
        if unknown:
            raise ValueError(f"{e.get('key')}: unknown fields {sorted(unknown)}")
    return entries


def registry_rows(entries: list[dict]) -> list[tuple]:
    rows = []
    for e in entries:
        alert = e.get("alert") or {}
        rows.append(
            (
                e["key"], e["label"], e["source"], e["grain"], e["unit"], e["direction"],
                list(e.get("dimensions") or []), e.get("entity_type"), alert.get("method"),
                None if alert.get("threshold") is None else float(alert["threshold"]),
                alert.get("min_history_days"), e["data_origin"], e["data_class"], e["owner"],
            )
        )
    return rows


def registry_df(spark: SparkSession, path: Path = REGISTRY_FILE) -> DataFrame:
    return spark.createDataFrame(registry_rows(load_entries(path)), REGISTRY_SCHEMA)


def registry_values_sql(path: Path = REGISTRY_FILE) -> str:
    """The same registry as an inline DuckDB relation (for oracle SQL)."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    rows = registry_rows(load_entries(path))
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    cols = "key, label, source, grain, unit, direction, dimensions, entity_type, alert_method, alert_threshold, min_history_days, data_origin, data_class, owner"
    return (
        "SELECT key, label, source, grain, unit, direction, dimensions, entity_type, alert_method, "
        "CAST(alert_threshold AS DOUBLE) AS alert_threshold, CAST(min_history_days AS INTEGER) AS min_history_days, "
        f"data_origin, data_class, owner FROM (VALUES {body}) t({cols})"
    )
