"""SimHash near-duplicates found by a byte-position index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most 3 bits share at least 5 of
their 8 positional bytes. Split the positions into two halves of four: 5 shared ones put 3 into one
half, so such a pair meets under at least one of the 8 triples of positions within a half. These
triples are the index; under each, the shared positional bytes of a pair are tallied, pairs that
reach 5 stay, and their bits are compared.

Texts with equal fingerprints are one entry. Entries of one key are compared in blocks: a key with
many entries is cut into blocks, each pair of blocks being a group of its own, so no group exceeds
about two blocks. A group hands on links that connect what it connected, one for each entry, not its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table, utf8
from worktally.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCK = 512
#: Positions that share a posting list, for up to 3 differing bytes.
TRIPLES = [[p + half for p in three] for half in (0, 4) for three in ([0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3])]


def _hashes(raw: bytes, length: int) -> list[int]:
    found = raw.lower().split()  # on bytes: A-Z alone, and the space and characters 9 to 13 alone
    if not found:
        return []
    if len(found) <= length:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - length or None].tolist(), (ends[length - 1 :] - 1).tolist())]


def simhash64(raw: bytes, length: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes; no word: 0."""
    hashes = np.array(_hashes(raw, length), "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        some = hashes[start : start + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, length: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a long; missing and empty texts have 0."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        marks = np.array([simhash64(t, length) for t in utf8(texts)], "<u8")
        return pa.array(marks.view("<i8"), pa.int64())

    return docs.withColumn(name, fingerprint(column(docs, text)))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component under the links a-b among 0..n-1."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        np.minimum.at(low, before, low)
        low = low[low]
        if np.array_equal(low, before):
            break
    return low


def linked(prints: np.ndarray, key: np.ndarray, distance: int, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints (sorted by key) that share a key, as stars around the first entry of what they connect."""
    found_a, found_b, lag, n = [], [], 1, len(prints)
    at = np.arange(n)
    while True:
        at = at[at + lag < n]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        apart = prints[at] ^ prints[at + lag]
        shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = at[(shared >= fewest) & (np.bitwise_count(apart) <= distance)]
        found_a.append(near)
        found_b.append(near + lag)
        lag += 1
    if not found_a:
        return at, at
    low = roots(np.concatenate(found_a), np.concatenate(found_b), n)
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct longs in column ``print``) within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the index of position triples covers distances from 0 to 3")
    bytes_at = [F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(k << 24) + bytes_at[x] + bytes_at[y] * 256 + bytes_at[z] * 65536 for k, (x, y, z) in enumerate(TRIPLES)]
    index = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    crowded = index.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    index = index.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    index = index.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = [F.col("key"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    index = index.select("print", F.xxhash64(*meeting).alias("meet"), "key", "own", "other")
    # 64 bits stand for (key, two blocks): groups that share them by accident are compared too, to no harm.
    index = index.select("meet", "print").repartition("meet").sortWithinPartitions("meet", "print")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(part: pa.Table) -> pa.RecordBatch:
            marks = part.column("print").to_numpy().view(np.uint64)
            a, b = linked(marks, part.column("meet").to_numpy(), distance, 8 - distance)
            return pa.RecordBatch.from_arrays([pa.array(marks[a].view(np.int64)), pa.array(marks[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            meet = rows.column("meet").to_numpy()
            whole = int(np.searchsorted(meet, meet[-1]))  # the last group may go on in the next batch
            if whole:
                yield done(rows.slice(0, whole).combine_chunks())
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    return index.mapInArrow(links, "a long, b long")


def rooted(prints: DataFrame, distance: int) -> DataFrame:
    """(print, root, component_id) of the fingerprints in stored rows (doc_id, print): the root names a component, also where no document of it has an id."""
    entries = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-entries")
    reached = components(near_links(entries.select("print"), distance))
    own = entries.join(reached.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(own.join(least, "root").select("print", "root", "component_id"), "simhash-components")


def simhash_groups(docs: DataFrame, length: int = SHINGLE, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the least doc_id that links reach, the document's own included.

    Missing, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
    keep their rows. A missing id is passed over when the least id is sought; a component without any id
    has none. An empty table gives no rows.
    """
    prints = with_fingerprint(docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text")), "text", "print", length)
    prints = stored(prints.select("doc_id", "print"), "simhash-prints")
    entries = rooted(prints, distance)
    return prints.join(entries, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, length: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Keep one document, with its columns, of each component: the one with the least id.

    Ids need not be there or be unique: a component is told by its fingerprints, a row by a hash of 128 bits of all its columns, so
    rows that share an id but not the text are documents each. Of several rows with the least id the one with the least hash
    stays, and once if it is repeated. Rows without an id come after all others.
    """
    digest = F.md5(F.to_json(F.struct(*[column(docs, c) for c in docs.columns])).cast("binary"))
    half = lambda at: F.coalesce(F.conv(F.substring(digest, at, 16), 16, -10).cast("long"), F.lit(0).cast("long"))
    marked = docs.withColumns({"__h1": half(1), "__h2": half(17)})
    prints = with_fingerprint(marked.select("doc_id", "text", "__h1", "__h2"), "text", "print", length)
    prints = stored(prints.select("doc_id", "print", "__h1", "__h2"), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    rows = prints.join(rooted(prints, distance).select("print", "root"), "print").groupBy("root", "doc_id", "__h1", "__h2").agg(F.count("*").alias("times"))
    first = rows.groupBy("root").agg(F.min(F.struct(order.alias("at"), "times")).alias("first"))
    first = stored(first.select(F.col("first.at.h1").alias("__k1"), F.col("first.at.h2").alias("__k2"), F.col("first.times").alias("__times")), "simhash-kept")
    kept = marked.join(first, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")))
    if first.filter("__times > 1").limit(1).count():
        once = kept.filter("__times > 1").dropDuplicates(["__h1", "__h2"])
        kept = kept.filter("__times = 1").unionByName(once)
    return kept.select(*[column(kept, c) for c in docs.columns])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, 3-word shingles, 3 bits."""
    return simhash_groups(table(spark, sf_dir, "documents"))
