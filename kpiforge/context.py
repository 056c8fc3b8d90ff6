"""Build context shared by all models of one run: tables, as-of dates, memoised DataFrames.

Models are plain functions ``ctx -> DataFrame``. Memoising them per context means a model read
by several downstream models is one logical subtree. Marts (``@model(table=True)``) are
additionally written to the mart store (``kpiforge.martstore``) and read back: the lineage is cut (a
lost executor recomputes nothing upstream), every reader gets column pruning and filter pushdown
on the written table, and contexts over the same input files and dates share it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from kpiforge import config
from kpiforge.martstore import INPUTS, MartStore
from kpiforge.session import size_tasks
from kpiforge.sources import files
from kpiforge.sources.tables import Tables

if TYPE_CHECKING:
    from kpiforge.operators.rawstore import RawStore


@dataclass
class Ctx:
    tables: Tables
    sim_date: date = config.SIM_DATE
    web_sim_date: date = config.WEB_SIM_DATE
    materialize: bool = True
    #: Raw tables that staging reads by newest load; None reads the sources directly.
    raw: RawStore | None = None
    #: First and last evaluation day of the backtest; the year up to the as-of date when not given.
    eval_start: date | None = None
    eval_end: date | None = None
    #: The days that the daily mart is built for; all, if not given.
    only_days: tuple[date, ...] | None = None
    memo: dict[str, DataFrame] = field(default_factory=dict)
    _store: MartStore | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **kw) -> Ctx:
        tables = Tables(spark, sf_dir)
        there = [p for p in map(tables.path, INPUTS) if files.exists(spark, p)]
        size_tasks(spark, sum(length for p in there for _, length, _ in files.listing(spark, p)))
        return cls(tables, **kw)

    @property
    def store(self) -> MartStore:
        """The marts of this context's inputs and dates; raw tables, which change, have marts of their own."""
        if self._store is None:
            dates = (self.sim_date, self.web_sim_date, self.eval_start, self.eval_end)
            own = uuid.uuid4().hex[:16] if self.raw is not None else None
            source = self.raw.root if self.raw is not None else self.tables.sf_dir
            self._store = MartStore(self.spark, source, dates, version=own)
        return self._store

    def on_days(self, days: list[date] | None) -> Ctx:
        """This context for some days of the daily mart."""
        return self if days is None else replace(self, only_days=tuple(days), memo={}, _store=self.store)


def model(fn: Callable[[Ctx], DataFrame] | None = None, *, table: bool = False):
    """Memoise a model per context; ``table=True`` also materialises it (see module doc)."""

    def deco(f: Callable[[Ctx], DataFrame]) -> Callable[[Ctx], DataFrame]:
        @functools.wraps(f)
        def wrapper(ctx: Ctx) -> DataFrame:
            key = f.__module__ + "." + f.__name__
            if key not in ctx.memo:
                ctx.memo[key] = ctx.store.get(f.__name__, lambda: f(ctx)) if table and ctx.materialize else f(ctx)
            return ctx.memo[key]

        return wrapper

    return deco(fn) if fn is not None else deco
