"""Event-time watermarks that outlive a run, and the rows that come behind them.

A run lands the files that are there and stops. It applies, strictly, the watermark that the run before
has left: rows older than it go to a table of late rows instead of the landed ones. Within a run
nothing is cut off, so the result does not depend on how rows are spread over files or micro-batches. At its
end the run stores the new watermark: the newest event time landed so far less the allowed delay, never
moving back. A run that dies before that is resumed by the stream's checkpoint under the old watermark.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.sources import files
from kpiforge.streaming.streams import run_available_now

MARK_SCHEMA = "run int, source string, watermark timestamp_ntz"


def watermark(spark: SparkSession, state: str, source: str) -> tuple[int, datetime | None]:
    """(finished runs, watermark) of a source; one row per run."""
    path = f"{state}/{source}/marks"
    if not files.exists(spark, path):
        return 0, None
    row = spark.read.schema(MARK_SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.max("watermark")).first()
    return row[0], row[1]


def land(spark: SparkSession, folder: str, state: str, source: str, ts: str, delay: timedelta) -> int:
    """One run over the files of ``folder`` that no earlier run has read; returns the run's number."""
    run, mark = watermark(spark, state, source)
    base = f"{state}/{source}"
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        batch.withColumn("late", late).withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    run_available_now(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_checkpoint"))
    newest = rows(spark, state, source).where("NOT late").agg(F.max(ts)).first()[0]
    moved = max((m for m in (mark, newest - delay if newest else None) if m), default=None)
    spark.createDataFrame([(run, source, moved)], MARK_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/marks")
    return run


def rows(spark: SparkSession, state: str, source: str) -> DataFrame:
    """Everything that has come, with the run that read it and whether it was late."""
    return spark.read.parquet(f"{state}/{source}/rows").drop("epoch")
