"""Tables, shared storage and byte views that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="worktally-llm-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where a one-machine session names none."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return _own_folder()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and go on from the copy: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_count(rows: int, each: int) -> int:
    """Pieces of about ``each`` rows."""
    return max(1, -(-rows // each))


def column(df: DataFrame, name: str):
    """A column by its exact name, dots and all; the last one is never ambiguous as Parquet names are unique."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, nothing for a missing text."""
    return pc.fill_null(array, "").cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()


def pieces(texts: list[bytes], most: int):
    """Ranges of a batch with about ``most`` bytes each; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: The powers of both, the largest table asked for so far: shorter ones are its beginning.
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (BASE, INVERSE):
            power = np.full(size, base, np.uint64)
            power[0] = 1
            tables.append(np.cumprod(power, out=power))
        _POWERS[:] = tables
    up, down = _POWERS
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], times ``down[i]``, the hash of ``data[i:j]``; equal bytes have equal hashes wherever they stand."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x1F3)) * up, out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)
