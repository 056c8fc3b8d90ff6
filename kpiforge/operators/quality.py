"""Data-quality checks as DataFrames of failures (empty = pass).

Each check is one pass over its table: all not-null columns of a table are counted in one
aggregation, duplicate keys in one group by, orphans in one anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED: entity namespace patterns '<type>:<key>'.
ENTITY_PATTERNS = {
    "kpi": r"^kpi:[a-z][a-z0-9_]*$",
    "region": r"^region:[A-Z]{2}$",
    "category": r"^category:[a-z0-9_]+$",
    "product": r"^product:[0-9a-f]{32}$",
    "customer": r"^customer:[0-9a-f]{32}$",
    "seller": r"^seller:[0-9a-f]{32}$",
    "person": r"^person:[a-z0-9]+(-[a-z0-9]+)*$",
    "team": r"^team:[a-z0-9]+(-[a-z0-9]+)*$",
    "decision": r"^decision:[a-z0-9]+(-[a-z0-9]+)*$",
    "meeting": r"^meeting:[a-z0-9]+(-[a-z0-9]+)*$",
    "topic": r"^topic:[a-z0-9]+(-[a-z0-9]+)*$",
    "department": r"^department:(marketing|sales|finance|customer|supply|operations|hr|projects|it|management|ai_ops)$",
    "insight": r"^insight:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}


def not_null(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count per column, all columns in one aggregation; rows only for failures."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = counts.selectExpr(f"stack({len(columns)}, {stack}) as (column_name, failures)")
    return long.filter(F.col("failures") > 0).select(F.lit(table).alias("table_name"), "column_name", "failures")


def unique(table: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (group by ... having count(*) > 1)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return dup.select(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"),
        "n",
    )


def relationships(child: str, df: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Non-NULL child keys without a parent row."""
    orphans = (
        df.filter(F.col(fk).isNotNull())
        .groupBy(F.col(fk).alias("_k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(parent.select(F.col(pk).alias("_k")).distinct(), "_k", "left_anti")
    )
    return orphans.select(
        F.lit(child).alias("table_name"), F.lit(fk).alias("column_name"), F.col("_k").cast("string").alias("orphan_key"), "n"
    )


def accepted_values(table: str, df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the accepted set (NULL passes), with counts."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))
    return bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n"
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_audit(ids: DataFrame) -> DataFrame:
    """Ids (column ``entity_id``) whose type is unknown or whose key breaks the
    type's pattern."""
    typ = F.substring_index(F.col("entity_id"), ":", 1)
    valid = F.lit(False)
    known = F.lit(False)
    for name, pattern in ENTITY_PATTERNS.items():
        valid = valid | ((typ == name) & F.col("entity_id").rlike(pattern))
        known = known | (typ == name)
    return ids.select(
        "source", "entity_id", typ.alias("entity_type"),
        F.when(~known, F.lit("unknown_type")).otherwise(F.lit("pattern")).alias("problem"),
        valid.alias("_valid"),
    ).filter(~F.col("_valid")).drop("_valid")
