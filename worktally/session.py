"""Session helpers shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "worktally") -> SparkSession:
    """Single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@cache
def _scratch_dir() -> str:
    return tempfile.mkdtemp(prefix="worktally-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without the setting gets a scratch folder of
    its own; on a cluster a missing setting is an error, because a folder on
    one machine would not survive the loss of that machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can read")
    return _scratch_dir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read, and go on from the copy.

    Spark would compute a shared input once per step, as every step prunes it to
    other columns. The copy is Parquet in the shared folder: steps read only
    their columns, its size is known when joins are planned, and a lost executor
    costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
