"""Files and folders of a store that Spark reads (Hadoop file systems), handled from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _fs(spark, path)
    return fs.exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a whole folder; a missing one is no error."""
    hadoop, fs = _fs(spark, path)
    fs.delete(hadoop, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder; False if ``new`` is already there (somebody else published first)."""
    source, fs = _fs(spark, old)
    target, _ = _fs(spark, new)
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and fs.rename(source, target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder (none if it is missing)."""
    hadoop, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of every data file at or below ``path``."""
    hadoop, fs = _fs(spark, path)
    found, out = fs.listFiles(hadoop, True), []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            out.append((name, status.getLen(), status.getModificationTime()))
    return sorted(out)
