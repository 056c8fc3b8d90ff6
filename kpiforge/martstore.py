"""Finished marts below the shared folder, keyed by what they were built from.

A slot is a data directory with its as-of dates; a version of it is the fingerprint of the input
files (name, length, modification time) and of this package's code. A mart is written to a folder of
its own and published by renaming it, so readers see all of it or nothing, and two builders of one version do not mix. Publishing
a new version removes the older ones, except the newest two and those whose files the newest still reads.

``kpi_daily`` is renewed by day: digests of its inputs per day tell which days differ from the
version before, only those are computed, and the new version reads the old files without them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import checkpoint_dir
from kpiforge.sources import files

INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Published versions of a slot that are kept besides those still read.
KEEP = 2
#: Beyond this share of changed days, or this many patches, a mart is written anew.
MAX_CHANGED, MAX_PATCHES = 0.25, 8
#: Session setting: where marts are stored (a folder that all executors share).
DIR = "spark.kpiforge.marts.dir"
#: Marks a version in use; the newest mark is the newest version.
MARK = "_used"


def store_dir(spark: SparkSession) -> str:
    """The folder that the setting DIR names, or one in the shared checkpoint folder."""
    return (spark.conf.get(DIR, None) or f"{checkpoint_dir(spark).rstrip('/')}/marts").rstrip("/")


@functools.lru_cache(maxsize=1)
def code_hash() -> str:
    """Hash of the package's sources, so that changed code never reads marts of other code."""
    root = Path(__file__).resolve().parent
    h = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        if "llm" not in f.relative_to(root).parts:
            h.update(f.read_bytes())
    return h.hexdigest()


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of the input files, listed by Spark and summed up in one aggregation; their contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .load([f"{sf_dir}/{t}.parquet" for t in INPUTS]).select("path", "length", "modificationTime")
    )
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}:{code_hash()}".encode()).hexdigest()[:16]


class MartStore:
    """The marts of one version of a slot."""

    def __init__(self, spark: SparkSession, sf_dir: str, dates: tuple, version: str | None = None):
        self.spark = spark
        slot = hashlib.sha256(f"{sf_dir}|{'|'.join(map(str, dates))}".encode()).hexdigest()[:16]
        self.slot = f"{store_dir(spark)}/{slot}"
        self.version = version or fingerprint(spark, sf_dir)
        self.root = f"{self.slot}/{self.version}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The published mart, built and published first if it is not there."""
        path = self.path(name)
        if not files.exists(self.spark, path):
            self._publish(build(), path)
        return self.spark.read.parquet(path)

    def _publish(self, df: DataFrame, path: str, kind: str = "parquet") -> bool:
        """Write aside, then rename; False if another builder was first."""
        pending = f"{self.slot}/_pending/{uuid.uuid4().hex}"
        (df.write.option("compression", "zstd") if kind == "parquet" else df.write).format(kind).save(pending)
        if files.rename(self.spark, pending, path):
            return True
        files.delete(self.spark, pending)
        return False

    # --- renewal by day ---------------------------------------------------------------------

    def _manifest(self, version: str, name: str) -> list[dict] | None:
        """The parts of a mart, oldest first: path, and the days that only it holds (None: all)."""
        path = f"{self.slot}/{version}/{name}_parts"
        if not files.exists(self.spark, path):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def versions(self) -> list[str]:
        """Versions with a finished daily mart, in the order in which they were built."""
        marks = files.children(self.spark, f"{self.slot}/{MARK}")
        return [m.split("-", 1)[1] for m in marks]

    def _read(self, parts: list[dict], day: str) -> DataFrame:
        """Each part without the days that a later one brings; with one part, its scan alone."""
        out, later = None, set()
        for part in reversed(parts):
            df = self.spark.read.parquet(part["path"])
            if later:
                df = df.where(~F.col(day).isin([date.fromisoformat(d) for d in sorted(later)]))
            out = df if out is None else out.unionByName(df)
            later |= set(part["days"] or ())
        return out

    def by_day(self, name: str, day: str, digests: Callable[[], DataFrame], build: Callable[[list[date] | None], DataFrame]) -> DataFrame:
        """A mart renewed by day. ``digests``: (part, day, n, digest) of its inputs; ``build(days)``: its rows of
        those days (None: all). The list of days has one entry per calendar day at most."""
        parts = self._manifest(self.version, name)
        if parts is None:
            own = self.get(f"{name}_digests", digests)
            parts = self._renewed(name, day, own, build)
            text = self.spark.createDataFrame([(json.dumps(parts),)], "value string").coalesce(1)
            if self._publish(text, f"{self.root}/{name}_parts", "text"):
                self._mark()
                self._tidy(name)
            parts = self._manifest(self.version, name)
        return self._read(parts, day)

    def _renewed(self, name, day, own, build) -> list[dict]:
        """The parts of this version: those of the newest earlier one and a patch, or one part written anew."""
        whole = f"{self.root}/{name}"
        for version in reversed(self.versions()):
            parts = self._manifest(version, name)
            before = f"{self.slot}/{version}/{name}_digests"
            if version == self.version or parts is None or not files.exists(self.spark, before):
                continue
            changed = self._changed(own, self.spark.read.parquet(before))
            n = own.select("day").distinct().count()
            if len(changed) > MAX_CHANGED * n or len(parts) > MAX_PATCHES:
                break
            if changed:
                self._publish(build(changed), f"{self.root}/{name}_patch")
                parts = [*parts, {"path": f"{self.root}/{name}_patch", "days": [d.isoformat() for d in changed]}]
            return parts
        self.get(name, lambda: build(None))
        return [{"path": whole, "days": None}]

    def _changed(self, own: DataFrame, before: DataFrame) -> list[date]:
        """Days whose inputs differ, and all days between an old and a new first or last day of an input."""
        a, b = own.alias("a"), before.alias("b")
        same = (F.col("a.part") == F.col("b.part")) & (F.col("a.day") == F.col("b.day"))
        differ = a.join(b, same, "full_outer").where(
            ~F.col("a.n").eqNullSafe(F.col("b.n")) | ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
        )
        days = differ.select(F.coalesce("a.day", "b.day").alias("day"))
        ends = own.groupBy("part").agg(F.min("day").alias("x"), F.max("day").alias("y")).alias("e").join(
            before.groupBy("part").agg(F.min("day").alias("u"), F.max("day").alias("v")).alias("f"), "part"
        )
        moved = [
            ends.where(F.col(p) != F.col(q)).select(F.explode(F.sequence(F.least(p, q), F.greatest(p, q))).alias("day"))
            for p, q in (("x", "u"), ("y", "v"))
        ]
        return sorted(r["day"] for r in days.union(moved[0]).union(moved[1]).distinct().collect())

    # --- old versions -----------------------------------------------------------------------

    def _mark(self) -> None:
        last = [m.split("-", 1)[0] for m in files.children(self.spark, f"{self.slot}/{MARK}")]
        number = int(last[-1]) + 1 if last else 0
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.slot}/{MARK}/{number:09d}-{self.version}")

    def _tidy(self, name: str) -> None:
        """Remove versions that are neither among the newest nor read by this one."""
        kept = set(self.versions()[-KEEP:]) | {self.version}
        for version in list(kept):
            for part in self._manifest(version, name) or ():
                kept.add(part["path"].split("/")[-2])
        for mark in files.children(self.spark, f"{self.slot}/{MARK}"):
            version = mark.split("-", 1)[1]
            if version not in kept:
                files.delete(self.spark, f"{self.slot}/{version}")
                files.delete(self.spark, f"{self.slot}/{MARK}/{mark}")
