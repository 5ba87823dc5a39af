"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Sorted by size, each enters the bin with the tightest capacity
left that still holds it; a balanced tree finds that bin. The shards' sizes come out near equal (law
``bytes``), with the smallest capacity for which the packing needs no more shards than asked for.

Two levels keep every task and the driver bounded. Tasks of about ``GROUPS_PER_TASK`` groups pack
small groups into grains, bins of a fixed 1 / (shards * GRAINS) of all bytes; the driver packs the
grains (at most about twice shards * GRAINS, and one for each task) into the shards. A group beyond a
grain in bytes, or that share of all rows, is placed by itself; there are at most 2 * shards * GRAINS
of them, so their places are broadcast. Only a group that is larger than a shard is cut into pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table

GRAINS = 256
GROUPS_PER_TASK = 20_000
ROWS_PER_SLOT_BUCKET = 10_000


class CapacityTree:
    """Bins by capacity left: a balanced tree of two levels whose leaves split when they are full."""

    FULL = 128

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.largest: list[tuple[int, int]] = []

    def add(self, left: int, number: int) -> None:
        item = (left, number)
        if not self.leaves:
            self.leaves, self.largest = [[item]], [item]
            return
        k = min(bisect_left(self.largest, item), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, item)
        if len(leaf) > self.FULL:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.largest[k : k + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.largest[k] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove the bin with the least capacity left of at least ``size``."""
        k = bisect_left(self.largest, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        item = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.largest[k] = leaf[-1]
        else:
            del self.leaves[k], self.largest[k]
        return item


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size (given from large to small), and the number of bins."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        tree.add(found[0] - size, found[1])
        out.append(found[1])
    return out, bins


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Pack sizes (from large to small) into ``shards`` bins of the smallest capacity that does."""
    total = sum(sizes)
    low = max([-(-total // shards), 1, *sizes[:1]])
    high = low + (sizes[0] if sizes else 0)  # then a bin that cannot take an item is over the mean
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return best_fit_decreasing(sizes, high)[0]


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (none).

    A document's size is its UTF-8 bytes plus 1. Missing texts are equal to each other, have size 1 and
    the checksum of nothing, 0. Repeated rows and missing ids are rows like any other; slots number the
    rows of a shard from 0 without gaps, in no promised order. An empty table gives no rows.
    """
    spark, content = docs.sparkSession, column(docs, text)
    rows = stored(
        docs.select(
            column(docs, doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(content), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.coalesce(F.md5(content), F.lit("00"))).alias("text_key"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins = shards * GRAINS
    grain, capacity = max(1, total // bins), max(1, total // shards)

    groups = stored(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    is_heavy = (F.col("bytes") > grain) | (F.col("rows") > max(1, n // bins))
    cuts = F.when(F.col("bytes") > capacity, F.ceil(F.col("bytes") * 4 / capacity)).otherwise(1).cast("int")
    heavy = groups.filter(is_heavy).select("text_key", cuts.alias("cuts"))
    light = groups.filter(~is_heavy)
    tagged = rows.join(F.broadcast(heavy), "text_key", "left")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    heavy_rows = tagged.filter("cuts is not null").withColumn("piece", piece).drop("cuts")

    tasks = split_count(light.count(), GROUPS_PER_TASK)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "text_key"], ascending=[False, True], kind="stable")
        part["bin"] = best_fit_decreasing(part["bytes"].tolist(), grain)[0]
        return part[["text_key", "bytes", "task", "bin"]]

    light = light.select("text_key", "bytes", F.pmod(F.xxhash64("text_key"), F.lit(tasks)).alias("task"))
    light = stored(light.groupBy("task").applyInPandas(pack, "text_key binary, bytes long, task long, bin int"), "shard-grains")

    grains = light.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    large = heavy_rows.groupBy("text_key", "piece").agg(F.sum("size").alias("bytes")).collect()
    items = sorted([*grains, *large], key=lambda r: (-r["bytes"], len(r), tuple(r)))
    place = list(zip(items, into_shards([r["bytes"] for r in items], shards)))
    of_grain = spark.createDataFrame([(r["task"], r["bin"], s) for r, s in place if "bin" in r], "task long, bin int, shard int")
    of_large = spark.createDataFrame([(r["text_key"], r["piece"], s) for r, s in place if "piece" in r], "text_key binary, piece int, shard int")

    columns = ["doc_id", "size", "text_crc32", "shard"]
    light_rows = tagged.filter("cuts is null").drop("cuts").join(light.join(F.broadcast(of_grain), ["task", "bin"]), "text_key")
    placed = stored(light_rows.select(*columns).unionByName(heavy_rows.join(F.broadcast(of_large), ["text_key", "piece"]).select(*columns)), "shard-placed")

    buckets = split_count(n, shards * ROWS_PER_SLOT_BUCKET)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(inside)).join(firsts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents"))
