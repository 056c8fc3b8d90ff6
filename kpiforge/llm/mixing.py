"""Mixing sources to target weights.

Tokens are aggregated per source, targets are set from weights, each source's repetition rate is
target / size, and every document is emitted floor(rate) times plus one more time if a number
hashed from its id and the seed is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import attach, cut, fresh, ranked, unit_hash, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_RATE = 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """Targets per source from a table (source, source_size).

    The sources, in code-point order with null last, weigh ``weights`` in turn and share
    ``share`` times all tokens; none gets more than ``max_rate`` times its size, and what is cut off
    goes to the others by weight until none is above. Each round is one aggregate over the sources.
    An empty table gives an empty table; sources of size 0 have target 0. ``max_rate`` is at
    least ``share``, so the targets can be met.
    """
    if max_rate < share:
        raise ValueError("max_rate must be at least share")
    table = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut(
        table.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_rate).alias("cap"))
    )
    whole = table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(capped >= 0) & (F.lit(level) * F.col("weight") >= F.col("cap"))
        row = table.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("cap"))).alias("caps"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped = row["n"]
        level = (share * whole - (row["caps"] or 0.0)) / row["weights"]
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("cap")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed="mix", **how) -> DataFrame:
    """One row per document with its size, its source's size and target, its rate and ``copies``.

    ``docs`` keeps its columns; the results are in the struct ``mix`` (a fresh name if that is
    taken, always the last column). Null texts have size 0, null sources form one source, null ids
    draw as the text 'null'; repeated rows draw alike. Documents of size 0 are drawn like any other.
    """
    out, key, size = fresh(docs, "mix"), "source", fresh(docs, "__size")
    sized = docs.withColumn(size, F.size(words(F.col(text_col))).cast("long"))
    sizes = sized.groupBy(F.col(source_col).alias(key)).agg(F.sum(size).alias("source_size"))
    of, source = fresh(docs, "__of"), fresh(docs, "__source")
    side = cut(
        source_targets(sizes, **how).select(F.col("source").alias(source), F.struct("source_size", "target").alias(of))
    )
    keyed = sized.withColumn(source, F.col(f"`{source_col}`"))
    joined = attach(keyed, side, [source])
    full, target = F.col(f"{of}.source_size"), F.col(f"{of}.target")
    rate = F.when(full > 0, target / full).otherwise(0.0)
    whole = F.floor(rate)
    extra = (unit_hash(F.col(id_col), seed=seed) < rate - whole).cast("int")
    made = F.struct(
        F.col(size).alias("size"), full.alias("source_size"), target.alias("target"), rate.alias("rate"),
        (whole + extra).cast("int").alias("copies"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(out))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as ``mix`` says."""
    mixed = mix(docs, **how)
    out = mixed.columns[-1]
    twin = fresh(mixed, "__copy")
    return (
        mixed.where(F.col(f"{out}.copies") > 0)
        .withColumn(twin, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies"))))
        .select(*docs.columns)
    )
