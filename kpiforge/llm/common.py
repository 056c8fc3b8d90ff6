"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiforge.session import checkpoint_dir, ensure_defaults

#: ASCII white space: the characters that end a word.
SPACE = " \t\n\x0b\f\r"

#: A table of at most this many rows and bytes (as JSON) may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


#: Rows of one Arrow batch between the JVM and Python; texts are large, so batches are short.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> None:
    ensure_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    prepared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a Zstandard Parquet table in the shared checkpoint folder (``options``: of the writer) and read it back."""
    prepared(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{uuid.uuid4().hex}"
    writer = df.write.options(compression="zstd", **(options or {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame, only: str = "") -> None:
    """Delete the files of stored tables (``only``: those whose path has this in it), once nothing will read them again, and let Spark drop old shuffles."""
    jvm, conf = tables[0].sparkSession._jvm, tables[0].sparkSession._jsc.hadoopConfiguration()
    for df in tables:
        for name in filter(lambda n: only in n, df.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            path.getFileSystem(conf).delete(path, False)
    gc.collect()
    jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when a lambda in it uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def unit_hash(*cols: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of the columns and a seed; the same in every run."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def attach(docs: DataFrame, small: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Left join of ``docs`` with a table of one row per key; nulls in a key match each other.

    ``small`` must be cut (it is counted): up to BROADCAST_ROWS rows and BROADCAST_BYTES bytes it is
    broadcast, beyond that its rows are repeated for each salt, so that a key with a third of all
    documents is spread over ``salts`` partitions.
    """
    s = small.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in small.columns if c not in on])
    match = reduce(lambda a, b: a & b, [docs[c].eqNullSafe(s[f"__r_{c}"]) for c in on])
    spelt = F.octet_length(F.to_json(F.struct(*small.columns)))
    counted = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(spelt), F.lit(0)).alias("bytes")).first()
    if counted["n"] <= BROADCAST_ROWS and counted["bytes"] <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(s), match, "left")
    else:
        salt = fresh(docs, "__salt")
        d = docs.withColumn(salt, F.floor(F.rand(17) * salts).cast("int"))
        s = s.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match = reduce(lambda a, b: a & b, [d[c].eqNullSafe(s[f"__r_{c}"]) for c in on])
        joined = d.join(s, match & (d[salt] == s["__r_salt"]), "left").drop(salt, "__r_salt")
    return joined.drop(*[f"__r_{c}" for c in on])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's place from 0 in the given order, without a single-task sort.

    The rows are range-partitioned and written once; the counts of the partitions (one row each)
    give every partition its offset.
    """
    part = fresh(df, "__part")
    cutted = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    start, begins = 0, []
    for p, n in sorted((r[0], r[1]) for r in cutted.groupBy(part).count().collect()):
        begins.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(begins or [(0, 0)], "__p int, __begin long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long") - 1
    return (
        cutted.withColumn(name, place)
        .join(F.broadcast(offsets), F.col(part) == F.col("__p"))
        .withColumn(name, F.col(name) + F.col("__begin"))
        .drop(part, "__p", "__begin")
    )
