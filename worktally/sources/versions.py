"""Snapshots in versions: a writer never touches what a reader may still hold."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

MARKERS = "_published"


def _files(spark: SparkSession, path: str):
    """The file system that holds a path, and its paths by name."""
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), as_path


def _listed(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a folder and when they were written, in seconds; nothing where there is no folder."""
    files, as_path = _files(spark, path)
    if not files.exists(as_path(path)):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in files.listStatus(as_path(path))}


def published(spark: SparkSession, path: str) -> list[str]:
    """Markers of the complete versions, oldest first: a running number and the name of the data."""
    return sorted(m for m in _listed(spark, f"{path}/{MARKERS}") if not m.startswith("."))


def publish(df: DataFrame, path: str, keep: int = 2, grace_hours: float = 24.0) -> DataFrame:
    """Save a table as the newest version of a snapshot and go on from the saved copy.

    The data go to a folder of their own; an empty marker, written last, publishes them, so a
    job that dies leaves no half version behind that anybody reads. Two writers at once both
    publish; of equal numbers the larger name is the newer one. A reader that resolved an
    earlier version goes on with it: :func:`sweep` spares the ``keep`` newest and whatever is
    younger than ``grace_hours``.
    """
    spark, name = df.sparkSession, f"data-{uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    number = max((int(m.split("-")[0]) for m in published(spark, path)), default=0) + 1
    files, as_path = _files(spark, path)
    files.create(as_path(f"{path}/{MARKERS}/{number:012d}-{name}"), False).close()
    sweep(spark, path, keep, grace_hours)
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; without one, an error."""
    versions = published(spark, path)
    if not versions:
        raise FileNotFoundError(f"no published version in {path}")
    return spark.read.parquet(f"{path}/{versions[-1].split('-', 1)[1]}")


def sweep(spark: SparkSession, path: str, keep: int = 2, grace_hours: float = 24.0) -> list[str]:
    """Delete old versions and data that were never published; returns the names of the data.

    A version goes when ``keep`` newer ones are published and it is older than ``grace_hours``,
    its marker first, so that nobody starts to read it. Unpublished data of that age go too.
    """
    files, as_path = _files(spark, path)
    before = time.time() - grace_hours * 3600
    written, versions = _listed(spark, f"{path}/{MARKERS}"), published(spark, path)
    old = [m for m in versions[: max(len(versions) - max(keep, 1), 0)] if written.get(m, time.time()) <= before]
    for marker in old:
        files.delete(as_path(f"{path}/{MARKERS}/{marker}"), False)
    named = {m.split("-", 1)[1] for m in versions if m not in old}
    gone = [d for d, at in _listed(spark, path).items() if d.startswith("data-") and d not in named and at <= before]
    for data in gone:
        files.delete(as_path(f"{path}/{data}"), True)
    return sorted(gone)
