"""Line dedup by site-relative frequency.

Pages are grouped by host; a line is boilerplate of a host if the pages that contain it are more
than ``ratio`` of the host's pages, and at least ``min_pages``. Such lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import SPACE, attach, cut, fresh

RATIO = 0.05
#: A line of one page alone is no boilerplate, whatever its share.
MIN_PAGES = 2


def _line_keys(lines):
    return F.transform(lines, lambda x: F.md5(x))


def boilerplate(docs: DataFrame, host_col="source", text_col="text", ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """(host, lines): the MD5 keys of each host's boilerplate lines.

    A page counts once for a line that it repeats, so the shuffle holds one partial count of
    (host, key) per task. A host's list is bounded: with d different lines on an average page it has
    at most d / ratio keys.
    """
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    host = F.col(host_col).alias("host")
    seen = docs.select(host, F.explode(F.array_distinct(_line_keys(lines))).alias("line")).groupBy("host", "line").count()
    seen = seen.where(F.col("count") >= min_pages)
    pages = docs.groupBy(host).agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "of")
    frequent = seen.join(pages, F.col("host").eqNullSafe(F.col("of"))).where(F.col("count") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col="source", text_col="text", ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of the text, and a struct of counts as last column.

    The struct (named ``lines``, or a fresh name if that is taken) has ``n_lines``, ``n_dropped``.
    Lines are split at \\n and compared whole; lines of white space only are neither counted as
    boilerplate nor dropped. Null hosts form one host. A null text stays null with 0 lines, an empty
    text is one blank line; a text whose lines all go is left empty. Repeated rows are pages of
    their own. Tables without rows give none.
    """
    out, lines, keys, host = (fresh(docs, c) for c in ("lines", "__lines", "__keys", "__host"))
    gone = cut(boilerplate(docs, host_col, text_col, ratio, min_pages).select(
        F.col("host").alias(host), F.col("lines").alias(keys)
    ))
    joined = attach(docs.withColumn(host, F.col(f"`{host_col}`")), gone, [host])
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col(keys).isNull(), split).otherwise(
        F.filter(split, lambda x: ~F.array_contains(F.col(keys), F.md5(x)))
    )
    joined = joined.withColumn(lines, F.struct(F.size(split).alias("n"), kept.alias("kept")))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.col(f"{lines}.n"))
    left = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(f"{lines}.kept"))
    counts = F.struct(n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"))
    text = F.array_join(F.col(f"{lines}.kept"), "\n")
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], counts.alias(out))
