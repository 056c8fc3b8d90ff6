"""kpiforge: a PySpark-native KPI warehouse -- source extracts, star schema, long-format KPI
marts, query layer, data quality, robust seasonal anomaly detection, event outbox, analyst
context and Structured Streaming loads. Entry points: ``kpiforge.plans.catalog`` (registered
queries) and ``kpiforge.context.Ctx`` (models over one data directory)."""
