"""Exact top-k by inner product on a bit-sliced index.

Components are quantised to whole numbers. Rows are cut into blocks; in a block, each dimension is a
stack of bitmaps, one for each bit of the component above the block's least. A query adds those
bitmaps with carry-save adders, shifted by the set bits of its own components (a negative component
adds complements), which gives the bit slices of all scores of the block at once. The best rows are
then selected from the most significant slice down; rows still equal at the boundary after the last slice
have equal scores and are told apart by the smaller id.

Queries are a stated set. Blocks of queries meet blocks of rows in tiles: a tile is one task, which holds a few blocks
of rows and lets blocks of queries pass; it hands on k rows for each query, and a ranking by query joins them. No side
is broadcast, so that the driver sees two counts only, and a task sees a tile whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table
from worktally.llm.vectors import dumped, loaded, matrix, usable, whole_numbers

SCALE = 256
ROWS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 256
#: A tile has at most so many blocks of rows and of queries; up to LEAST_STRIPS blocks of rows, each has a tile of its own.
BLOCKS_PER_TILE = 4
QUERY_BLOCKS_PER_TILE = 48
LEAST_STRIPS = 32


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [dimension, bit, word] of whole numbers [row, dimension], and the least value of each dimension."""
    rows, dims = values.shape
    least = values.min(0)
    above = (values - least).T
    bits = max(1, int(above.max()).bit_length())
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((above >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64), least


def add_slices(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight: columns[w] has bitmaps [n, word] worth 2**w each; result slice w is worth 2**w."""
    out, w = [], 0
    while w < len(columns):
        stack = np.concatenate([np.zeros((0, words), np.uint64), *columns[w]])
        if len(stack) > 1 and w + 1 == len(columns):
            columns.append([])
        while len(stack) > 2:
            m = len(stack) // 3
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = a ^ b
            columns[w + 1].append((a & b) | (half & c))
            stack = np.concatenate((half ^ c, stack[3 * m :]))
        if len(stack) == 2:
            columns[w + 1].append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        w += 1
    return out


def score_slices(both: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |q_d| * z_d, z being the bits of a dimension or, where q_d < 0, their complement; both: [complement?, dimension, bit, word]."""
    _, dims, bits, words = both.shape
    z = both[(query < 0).astype(int), np.arange(dims)]
    size = np.abs(query)
    columns: list[list[np.ndarray]] = [[] for _ in range(bits + int(size.max()).bit_length())]
    for t in range(int(size.max()).bit_length()):
        chosen = z[((size >> t) & 1).astype(bool)]
        for s in range(bits):
            columns[s + t].append(chosen[:, s])
    return add_slices(columns or [[]], words)


def best_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest of the rows in bitmap ``among``; of equal ones the first."""
    sure, open_ = np.zeros_like(among), among
    for bits in reversed(slices):
        high = open_ & bits
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure, open_ = sure | high, open_ & ~bits
            if n == k:
                open_ = np.zeros_like(among)
                break
    ones = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    chosen = ones(sure)
    return np.concatenate((chosen, ones(open_)[: max(0, k - len(chosen))]))


def search_block(ids: np.ndarray, slices: np.ndarray, least: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query: the numbers of the best rows of the block and their scores. ids ascend."""
    dims, bits, words = slices.shape
    rows = len(ids)
    here = np.packbits(np.arange(words * 64) < rows, bitorder="little").view(np.uint64)
    both = np.stack((slices, ~slices & here))
    top = (1 << bits) - 1
    for own, query in zip(query_ids, queries):
        among = here.copy()
        a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        for i in range(a, b):
            among[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        sums = score_slices(both, query)
        found = best_rows(sums, among, k)
        base = int((query * least).sum()) - top * int(-query[query < 0].sum())
        word, bit = found // 64, (found % 64).astype(np.uint64)
        # Beyond 62 slices, numbers of any size.
        score = np.full(len(found), base, np.int64 if len(sums) < 63 and abs(base) < 1 << 62 else object)
        for w, s in enumerate(sums):
            score += ((s[word] >> bit) & np.uint64(1)).astype(np.int64).astype(score.dtype) << w
        yield found, score


def _pack(with_slices: bool, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = list(batches)  # a block's rows
        if not sum(map(len, held)):
            return
        rows = pa.Table.from_batches(held)
        dims = rows.column("dims").to_numpy()
        for d in np.unique(dims):
            own = rows.filter(pa.array(dims == d)).sort_by("vec_id").combine_chunks()
            values = whole_numbers(matrix(own.column("value").chunk(0)), scale)
            if with_slices:
                slices, least = slices_of(values)
                body = [slices.tobytes(), dumped(least)]
            else:
                body = [dumped(values), b""]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([int(d)], pa.int64()), pa.array([own.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([body[0]], pa.binary()), pa.array([body[1]], pa.binary())],
                ["block", "dims", "ids", "body", "least"],
            )

    return pack


PACKED = "block long, dims long, ids binary, body binary, least binary"


def _best_of(found: list, number: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, vec_id and score of the k best for each of so many queries; found: for each block its ids and what search_block gave."""
    nth = np.concatenate([np.repeat(np.arange(number), [len(f) for f, _ in hits]) for _, hits in found])
    at = np.concatenate([ids[f] for ids, hits in found for f, _ in hits])
    score = pa.array([x for _, hits in found for _, s in hits for x in s.tolist()], pa.int64()).to_numpy(zero_copy_only=False)
    order = np.lexsort((at, ~score, nth))
    nth = nth[order]
    kept = np.arange(len(nth)) - np.searchsorted(nth, nth) < k
    return nth[kept], at[order][kept], score[order][kept]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dims = [], None  # the blocks of rows of a tile, which come before its queries
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["dims"] != dims:
                    held, dims = [], r["dims"]
                ids = np.frombuffer(r["ids"], np.int64)
                if not r["asks"]:
                    held.append((ids, np.frombuffer(r["body"], np.uint64).reshape(dims, -1, -(-len(ids) // 64)), loaded(r["least"], 1)[0]))
                elif held:
                    queries = loaded(r["body"], len(ids))
                    nth, at, score = _best_of([(own, list(search_block(own, slices, least, ids, queries, k))) for own, slices, least in held], len(ids), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), r["block"])), pa.array(np.full(len(at), dims)), pa.array(nth), pa.array(ids[nth]), pa.array(at), pa.array(score)],
                        ["query_block", "query_dims", "nth", "query_id", "vec_id", "score"],
                    )

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product of each query among all other rows.

    Components become floor(scale * x), whatever their size; a score beyond 64 bits ends the query with an error. Vectors that are
    missing, empty or hold a missing or non-finite component take no part, and neither do rows without an id.
    Only vectors of one length are compared. A query's own row is every row with its id; rows that repeat an
    id are candidates each, and queries each. No query or no candidate: no rows.
    """
    rows = vectors.select(column(vectors, vec_id).alias("vec_id"), column(vectors, vector).alias("v"), is_query.alias("is_query"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("value"), F.size("v").alias("dims"), "is_query")
    rows = stored(rows, "topk-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks = split_count(n, ROWS_PER_BLOCK)

    index = rows.select("vec_id", "value", "dims").repartition(blocks).mapInArrow(_pack(True, scale), PACKED)
    index = stored(index, "topk-index")
    query_blocks = split_count(asked, QUERIES_PER_BLOCK)
    queries = rows.filter("is_query").select("vec_id", "value", "dims").repartition(query_blocks).mapInArrow(_pack(False, scale), PACKED)
    queries = stored(queries, "topk-queries")

    strips = max(split_count(blocks, BLOCKS_PER_TILE), min(blocks, LEAST_STRIPS))
    chunks = split_count(query_blocks, QUERY_BLOCKS_PER_TILE)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = index.select(F.lit(False).alias("asks"), "*", (F.col("block") % strips).alias("strip"), each(chunks).alias("chunk"))
    queries = queries.select(F.lit(True).alias("asks"), "*", (F.col("block") % chunks).alias("chunk"), each(strips).alias("strip"))
    tiles = index.unionByName(queries).repartitionById(strips * chunks, (F.col("strip") * chunks + F.col("chunk")).cast("int"))
    tiles = tiles.sortWithinPartitions("dims", "asks", "block").select("asks", "block", "dims", "ids", "body", "least")
    best = tiles.mapInArrow(_search(k), "query_block long, query_dims long, nth long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_block", "query_dims", "nth").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
