"""Parquet table access.

Reads are lazy; Catalyst prunes columns and pushes filters into the Parquet scan, so callers
simply select/filter what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiforge.session import ensure_defaults

TABLE_NAMES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


class Tables:
    """Lazy handles on the parquet tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_defaults(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(f"unknown table {name!r}")
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.read(name)
