"""Registered queries: name -> (spark callable, oracle SQL or None).

Every callable takes (spark, sf_dir) and returns a lazy DataFrame over the whole tables of that
directory. Decimal outputs are cast to double at this boundary (exact sums first, then one
conversion), so both engines hand back the same value types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from kpiforge.context import Ctx

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double (values are exact decimals up to this point)."""
    cols = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def register(name: str, sql: str | None = None, materialize: bool = True):
    """Register ``fn(ctx) -> DataFrame`` as a query (and its oracle SQL, if any).

    ``materialize``: write the marts the query reads once per run (multi-stage pipelines that
    reach the marts from several jobs: detection, backtest, outbox, context); single-plan
    queries over the star schema stay one lazy plan, where shared subtrees reuse exchanges."""

    def deco(fn: Callable[[Ctx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(Ctx.of(spark, sf_dir, materialize=materialize)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    # Order matters: later modules reuse SQL twins defined by earlier ones.
    from kpiforge.plans import queries_core  # noqa: F401  (registration)
    from kpiforge.plans import queries_more  # noqa: F401
    from kpiforge.plans import queries_quality  # noqa: F401
    from kpiforge.plans import queries_stream  # noqa: F401
    from kpiforge.plans import queries_detect  # noqa: F401
    from kpiforge.plans import queries_context  # noqa: F401
    from kpiforge.plans import queries_backtest  # noqa: F401
    from kpiforge.plans import queries_windows  # noqa: F401
    from kpiforge.plans import queries_loads  # noqa: F401
    from kpiforge.plans import queries_audits  # noqa: F401
    from kpiforge.plans import queries_raw  # noqa: F401
    from kpiforge.plans import queries_late  # noqa: F401
    from kpiforge.plans import queries_events  # noqa: F401

    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    all_queries()
    return dict(ORACLE)
