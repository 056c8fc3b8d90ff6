"""Long-format KPI marts.

``kpi_daily``: one row per day, KPI and dimension member. Ratio KPIs keep numerator and
denominator, so every coarser grain re-sums both and divides (ratios are never averaged).
Totals of order- and item-based KPIs are zero-filled over the date spine; member rows exist
only where there is data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.context import Ctx, model
from kpiforge.functions.columns import KPI_DEC, kpi_value
from kpiforge.operators import marts

KPI_COLUMNS = [
    "kpi_date",
    "kpi_key",
    "dimension",
    "dimension_value",
    "entity_id",
    "value",
    "numerator",
    "denominator",
    "aggregation",
]


def grouped_by_dimension(
    df: DataFrame, date_col: str, dims: Sequence[tuple[str, str]], aggs: dict[str, Column]
) -> DataFrame:
    """GROUPING SETS ((date), (date, dim1), (date, dim2), ...) labelled as
    (kpi_date, dimension, dimension_value); the grand total per day is dimension 'total'.

    One Expand + one (partially pre-aggregated) shuffle instead of one scan per grouping.
    """
    dim_cols = [c for _, c in dims]
    sets = [[date_col]] + [[date_col, c] for c in dim_cols]
    g = df.groupingSets(sets, date_col, *dim_cols).agg(
        *[a.alias(n) for n, a in aggs.items()], *[F.grouping(c).alias(f"_g_{c}") for c in dim_cols]
    )
    dimension = F.lit("total")
    member = F.lit("all")
    for name, c in reversed(dims):
        dimension = F.when(F.col(f"_g_{c}") == 0, F.lit(name)).otherwise(dimension)
        member = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(member)
    return g.select(
        F.col(date_col).alias("kpi_date"), dimension.alias("dimension"), member.alias("dimension_value"), *aggs
    )


def date_spine(ctx: Ctx) -> DataFrame:
    """Every day from the first purchase date to the simulation date (explode of a sequence
    computed from a one-row aggregate, so no cross join)."""
    first = marts.fct_orders(ctx).agg(F.min("purchase_date").alias("first_day"))
    return first.select(
        F.explode(F.sequence(F.col("first_day"), F.lit(ctx.sim_date), F.expr("INTERVAL 1 DAY"))).alias("kpi_date")
    )


def densify_totals(ctx: Ctx, agg: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Zero-filled total rows on the spine + member rows as they are: the aggregate and a row of zeros per day, summed once."""
    spine = on_days(ctx, date_spine(ctx), "kpi_date")
    zeros = spine.select("kpi_date", F.lit("total").alias("dimension"), F.lit("all").alias("dimension_value"), *[F.lit(0).alias(m) for m in measures])
    both = agg.select("kpi_date", "dimension", "dimension_value", *measures).unionByName(zeros)
    return both.groupBy("kpi_date", "dimension", "dimension_value").agg(*[F.sum(m).alias(m) for m in measures])


def on_days(ctx: Ctx, df: DataFrame, day: str) -> DataFrame:
    """The rows of the days that the context asks for."""
    return df if ctx.only_days is None else df.where(F.col(day).isin(list(ctx.only_days)))


def unpivot(df: DataFrame, rows: Sequence[tuple[str, str, str, str | None]]) -> DataFrame:
    """Wide measures -> long (kpi_key, aggregation, numerator, denominator) rows via stack()."""
    parts = []
    for key, agg, num, den in rows:
        den_sql = f"cast({den} as {KPI_DEC})" if den else f"cast(null as {KPI_DEC})"
        parts.append(f"'{key}', '{agg}', cast({num} as {KPI_DEC}), {den_sql}")
    stack = f"stack({len(rows)}, {', '.join(parts)}) as (kpi_key, aggregation, numerator, denominator)"
    return df.selectExpr("kpi_date", "dimension", "dimension_value", stack)


@model
def kpi_orders_agg(ctx: Ctx) -> DataFrame:
    o = on_days(ctx, marts.fct_orders(ctx), "purchase_date")
    return grouped_by_dimension(
        o,
        "purchase_date",
        [("region", "state_code")],
        {
            "orders_all": F.count(F.lit(1)),
            "orders_valid": F.count_if(~F.col("is_canceled")),
            "orders_canceled": F.count_if(F.col("is_canceled")),
            "new_customers": F.count_if(F.col("is_first_order")),
            "returning_customers": F.count_if(~F.col("is_first_order")),
        },
    )


@model
def kpi_items_agg(ctx: Ctx) -> DataFrame:
    """Item measures per day, region and category with the number of different orders.

    The item mart marks one of an order's items, and one of those of each category, so that orders are counted by
    sums (a day's and a region's by the former marks, a category's by the latter) and no order id is shuffled.
    """
    i = on_days(ctx, marts.counted_order_items(ctx).filter(~F.col("is_canceled")), "purchase_date")
    counted = grouped_by_dimension(
        i,
        "purchase_date",
        [("region", "state_code"), ("category", "category_name_en")],
        {
            "gmv": F.sum("price"),
            "freight": F.sum("freight_value"),
            "items": F.count(F.lit(1)),
            "firsts": F.count_if("first_of_order"),
            "order_rows": F.count_if("first_of_group"),
        },
    )
    orders = F.when(F.col("dimension") == "category", F.col("order_rows")).otherwise(F.col("firsts"))
    return counted.select("kpi_date", "dimension", "dimension_value", "gmv", "freight", "items", orders.alias("orders_with_items"))


@model
def kpi_delivery_agg(ctx: Ctx) -> DataFrame:
    o = on_days(ctx, marts.fct_orders(ctx).filter(F.col("delivery_date").isNotNull()), "delivery_date")
    return grouped_by_dimension(
        o,
        "delivery_date",
        [("region", "state_code")],
        {
            "delivery_days_sum": F.sum("delivery_days"),
            "delivered": F.count(F.lit(1)),
            "delivered_on_time": F.count_if(F.col("is_on_time")),
        },
    )


@model
def kpi_review_agg(ctx: Ctx) -> DataFrame:
    r = on_days(ctx, marts.fct_reviews(ctx), "review_date")
    return grouped_by_dimension(
        r,
        "review_date",
        [("region", "state_code")],
        {"score_sum": F.sum("review_score"), "reviews": F.count(F.lit(1))},
    )


def join_frames(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of any number of inputs with one row per key: a tagged union and one aggregation.

    Every input's other columns come along, NULL where it has no such key; ``in_<name>`` tells which inputs
    have the key, so that an inner or left join is a filter on the result. One shuffle whatever the number of inputs, and no key of a
    single input is lost.
    """
    others = {name: [c for c in df.columns if c not in keys] for name, df in frames.items()}
    parts = [
        df.select(*keys, *others[name], F.lit(True).alias(f"in_{name}")) for name, df in frames.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    measures = [F.max(c).alias(c) for own in others.values() for c in own]
    present = [F.coalesce(F.bool_or(f"in_{name}"), F.lit(False)).alias(f"in_{name}") for name in frames]
    return union.groupBy(*keys).agg(*measures, *present)


@model
def kpi_marketing(ctx: Ctx) -> DataFrame:
    """Daily sessions and spend across channels with the web orders of the same day."""
    from kpiforge.sources import landing

    m = marts.fct_marketing_daily(ctx).groupBy(F.col("marketing_date").alias("kpi_date")).agg(
        F.sum("sessions").alias("sessions"), F.sum("ad_spend").alias("ad_spend")
    )
    both = join_frames({"marketing": m, "orders": landing.web_orders_daily(ctx)}, ["kpi_date"])
    return both.where("in_marketing").select(
        "kpi_date",
        F.lit("total").alias("dimension"),
        F.lit("all").alias("dimension_value"),
        "sessions",
        "ad_spend",
        F.coalesce(F.col("web_orders"), F.lit(0)).alias("web_orders"),
        F.coalesce(F.col("web_revenue"), F.lit(0)).alias("web_revenue"),
    )


@model
def kpi_inputs(ctx: Ctx) -> DataFrame:
    orders = densify_totals(
        ctx, kpi_orders_agg(ctx), ["orders_all", "orders_valid", "orders_canceled", "new_customers", "returning_customers"]
    )
    items = densify_totals(ctx, kpi_items_agg(ctx), ["gmv", "freight", "items", "orders_with_items"])
    branches = [
        unpivot(
            orders,
            [
                ("orders_count", "sum", "orders_valid", None),
                ("cancellation_rate", "ratio", "orders_canceled", "orders_all"),
                ("new_customers", "sum", "new_customers", None),
                ("returning_customers", "sum", "returning_customers", None),
            ],
        ),
        unpivot(
            items,
            [
                ("gmv", "sum", "gmv", None),
                ("avg_order_value", "ratio", "gmv", "orders_with_items"),
                ("freight_ratio", "ratio", "freight", "gmv"),
                ("items_per_order", "ratio", "items", "orders_with_items"),
            ],
        ).filter(~(F.col("kpi_key").isin("avg_order_value", "items_per_order") & (F.col("dimension") == "category"))),
        unpivot(
            kpi_delivery_agg(ctx),
            [
                ("delivery_time_avg_days", "ratio", "delivery_days_sum", "delivered"),
                ("on_time_rate", "ratio", "delivered_on_time", "delivered"),
            ],
        ),
        unpivot(kpi_review_agg(ctx), [("review_score_avg", "ratio", "score_sum", "reviews")]),
        unpivot(
            on_days(ctx, kpi_marketing(ctx), "kpi_date"),
            [
                ("conversion_rate", "ratio", "web_orders", "sessions"),
                ("roas", "ratio", "web_revenue", "ad_spend"),
            ],
        ),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def kpi_entity_id(dimension: Column, member: Column, kpi_key: Column) -> Column:
    return (
        F.when(dimension == "region", F.concat(F.lit("region:"), member))
        .when(dimension == "category", F.concat(F.lit("category:"), member))
        .otherwise(F.concat(F.lit("kpi:"), kpi_key))
    )


def kpi_rows(ctx: Ctx) -> DataFrame:
    k = kpi_inputs(ctx)
    return k.select(
        "kpi_date",
        "kpi_key",
        "dimension",
        "dimension_value",
        kpi_entity_id(F.col("dimension"), F.col("dimension_value"), F.col("kpi_key")).alias("entity_id"),
        kpi_value(F.col("aggregation"), F.col("numerator"), F.col("denominator")).alias("value"),
        "numerator",
        "denominator",
        "aggregation",
    )


def day_digests(ctx: Ctx) -> DataFrame:
    """(part, day, n, digest): per day of each input of the daily mart, its rows' number and the sum of their hashes."""
    orders = marts.fct_orders(ctx)
    parts = {
        "orders": ("purchase_date", orders.select("purchase_date", "state_code", "is_canceled", "is_first_order")),
        "delivery": ("delivery_date", orders.where("delivery_date IS NOT NULL").select("delivery_date", "state_code", "delivery_days", "is_on_time")),
        "items": ("purchase_date", marts.fct_order_items(ctx).where("NOT is_canceled").select(
            "purchase_date", "order_id", "state_code", "category_name_en", "price", "freight_value")),
        "reviews": ("review_date", marts.fct_reviews(ctx).select("review_date", "state_code", "review_score")),
        "marketing": ("kpi_date", kpi_marketing(ctx)),
    }
    out = None
    for part, (day, df) in parts.items():
        own = df.groupBy(F.col(day).alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")
        ).select(F.lit(part).alias("part"), "day", "n", "digest")
        out = own if out is None else out.unionByName(own)
    return out


@model
def kpi_daily(ctx: Ctx) -> DataFrame:
    """The daily mart; from the mart store, if the context writes marts, where only changed days are built."""
    if not ctx.materialize:
        return kpi_rows(ctx)
    return ctx.store.by_day("kpi_daily", "kpi_date", lambda: day_digests(ctx), lambda days: kpi_rows(ctx.on_days(days)))


@model
def kpi_budget(ctx: Ctx) -> DataFrame:
    """budget_deviation per month: total and per category (grouping sets)."""
    b = marts.budget_vs_actual(ctx)
    g = grouped_by_dimension(
        b,
        "month_start",
        [("category", "category_name_en")],
        {"numerator": F.sum("deviation_abs"), "denominator": F.sum("budget_brl")},
    )
    return g.select(
        F.col("kpi_date").alias("month_start"),
        F.lit("budget_deviation").alias("kpi_key"),
        "dimension",
        "dimension_value",
        F.when(F.col("dimension") == "category", F.concat(F.lit("category:"), F.col("dimension_value")))
        .otherwise(F.lit("kpi:budget_deviation"))
        .alias("entity_id"),
        F.lit("ratio").alias("aggregation"),
        F.col("numerator").cast(KPI_DEC).alias("numerator"),
        F.col("denominator").cast(KPI_DEC).alias("denominator"),
    )


@model(table=True)
def kpi_monthly(ctx: Ctx) -> DataFrame:
    d = kpi_daily(ctx)
    from_daily = d.groupBy(
        F.trunc("kpi_date", "month").alias("month_start"),
        "kpi_key",
        "dimension",
        "dimension_value",
        "entity_id",
        "aggregation",
    ).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    combined = from_daily.unionByName(kpi_budget(ctx))
    return combined.select(
        "month_start",
        "kpi_key",
        "dimension",
        "dimension_value",
        "entity_id",
        kpi_value(F.col("aggregation"), F.col("numerator"), F.col("denominator")).alias("value"),
        "numerator",
        "denominator",
        "aggregation",
        (F.last_day("month_start") <= F.lit(ctx.sim_date)).alias("is_complete"),
    )
