"""Hard negatives by Fagin's threshold algorithm over sorted lists of every dimension.

Components are quantised to whole numbers, so a score, the inner product of an anchor and a row, is a whole number.
Rows lie in blocks; in a block each dimension has a list of the rows in the order of their component. An anchor
reads the lists of all dimensions in parallel, from the top where its own component is positive and from the bottom
where it is negative (sorted access), and computes the whole score of each row that comes up (random access). What it has
not seen yet cannot score more than the threshold, the product of the anchor with the components at which its reading stands.

* Positives: reading ends once the threshold is strictly below the k-th score among the anchor's own label. Strictly, as an unseen
  row of equal score may have the smaller id.
* Negatives: each positive opens a window of scores, and one reading serves all windows of an anchor. It ends
  once the threshold is strictly below the k-th score of every window or, where a window holds fewer, below its lower end.

Anchors are a stated set. Batches of anchors meet blocks of rows by an equality join on the block, blocks without a
row of a wanted label are left out before, and a block hands on k rows for each anchor or window, which a ranking joins.
Rows are dealt to blocks by ranges of (label, row), so a label that holds a third of the table fills many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table
from worktally.llm.vectors import dumped, loaded, usable, whole_numbers

SCALE = 256
ROWS_PER_BLOCK = 8_192
ANCHORS_PER_BATCH = 256
#: Entries of each list that the first round of sorted access reads; every round doubles the depth.
FIRST_DEPTH = 32
#: Whole numbers up to this size are exact as doubles, whose products are fast.
EXACT = 1 << 53


def largest(values: np.ndarray) -> int:
    return max((abs(int(x)) for x in (values.max(initial=0), values.min(initial=0))), default=0)


@dataclass
class Block:
    """Rows of one length with the sorted lists of their dimensions, ascending."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    orders: np.ndarray

    def fitted(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchors in a type in which no score loses a digit."""
        most = largest(self.values) * largest(anchors) * max(1, self.values.shape[1])
        kind = np.float64 if most < EXACT else np.int64 if most < 1 << 63 else object
        return self.values.astype(kind), anchors.astype(kind)


def read_until(values: np.ndarray, orders: np.ndarray, anchor: np.ndarray, wanted: np.ndarray, bound: Callable[[np.ndarray], object], depth: int = FIRST_DEPTH):
    """Rows seen and their scores by the time the threshold is strictly below ``bound(scores)``; ``wanted`` rows alone are scored."""
    rows = len(values)
    up = np.flatnonzero(anchor > 0)
    down = np.flatnonzero(anchor < 0)
    open_ = wanted.copy()
    seen, scores = np.zeros(0, np.int64), np.zeros(0, values.dtype)
    start = 0
    while True:
        # The components at which the lists stand; before the first access their ends.
        top, low = (rows - 1, 0) if start == 0 else (rows - start, start - 1)
        threshold = (anchor[up] * values[orders[up, top], up]).sum() + (anchor[down] * values[orders[down, low], down]).sum()
        if start >= rows or threshold < bound(scores):
            return seen, scores
        stop = min(rows, max(depth, 2 * start))
        if len(up) + len(down):
            read = np.concatenate((orders[up, rows - stop : rows - start].ravel(), orders[down, start:stop].ravel()))
        else:  # an anchor of zeros: every row scores nothing
            read, stop = np.arange(rows), rows
        fresh = np.zeros(rows, bool)
        fresh[read] = True
        new = np.flatnonzero(fresh & open_)
        open_[new] = False
        seen, scores = np.concatenate((seen, new)), np.concatenate((scores, values[new] @ anchor))
        start = stop


def kth(scores: np.ndarray, k: int):
    """The k-th largest score, or nothing."""
    if len(scores) < k:
        return None
    return np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]


NOTHING = float("-inf")


def best(ids: np.ndarray, seen: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    last = kth(scores, k)
    near = np.arange(len(scores)) if last is None else np.flatnonzero(scores >= last)
    order = sorted(near.tolist(), key=lambda i: (-scores[i], ids[seen[i]]))
    return np.array(order[:k], np.int64)


def positives_in(block: Block, values: np.ndarray, own: int, label: int, anchor: np.ndarray, k: int):
    """Numbers and scores of the best k rows of the anchor's label in a block."""
    wanted = (block.labels == label) & (block.ids != own)
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, values.dtype)

    def bound(scores):
        last = kth(scores, k)
        return NOTHING if last is None else last

    seen, scores = read_until(values, block.orders, anchor, wanted, bound)
    at = best(block.ids, seen, scores, k)
    return seen[at], scores[at]


def negatives_in(block: Block, values: np.ndarray, label: int, anchor: np.ndarray, windows: list[int], least: int, most: int, k: int):
    """For each window, given by its positive score: numbers and scores of the best k rows of other labels in it.

    A negative score s lies in the window of a positive score p if least * p <= 100 * s <= most * p.
    """
    ranges = [(-(-least * p // 100), most * p // 100) for p in windows]
    wanted = block.labels != label
    alive = [r for r in ranges if r[0] <= r[1]]
    none = np.zeros(0, np.int64)
    if not alive or not wanted.any():
        return [(none, none) for _ in ranges]

    def within(scores, a, b):
        return (scores >= a) & (scores <= b)

    def bound(scores):
        lowest = None
        for a, b in alive:
            last = kth(scores[within(scores, a, b)], k)
            edge = a if last is None else last
            lowest = edge if lowest is None or edge < lowest else lowest
        return lowest

    seen, scores = read_until(values, block.orders, anchor, wanted, bound)
    out = []
    for a, b in ranges:
        inside = np.flatnonzero(within(scores, a, b))
        at = inside[best(block.ids, seen[inside], scores[inside], k)]
        out.append((seen[at], scores[at]))
    return out


PACKED = "block long, dims long, ids binary, labels binary, low long, high long, body binary, orders binary"
PACKED_TYPE = pa.schema([("block", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("body", pa.binary()), ("orders", pa.binary())])


def _pack(scale: int, lists: bool):
    """The rows (vec_id, label, v, dims) of a partition as one packed row for each length of vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a block's rows
        if not sum(map(len, held)):
            return
        part = TaskContext.get().partitionId()
        rows = pa.Table.from_batches(held)
        dims = rows.column("dims").to_numpy()
        for d in np.unique(dims):
            own = rows.filter(pa.array(dims == d))
            values = whole_numbers(own.column("v").to_pylist(), scale)
            labels = own.column("label").to_numpy()
            row = {"block": part, "dims": int(d), "ids": own.column("vec_id").to_numpy().tobytes(), "labels": labels.tobytes(), "low": int(labels.min()), "high": int(labels.max())}
            orders = np.argsort(values, axis=0, kind="stable").T.astype(np.int32) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_pylist([row | {"body": dumped(values), "orders": np.ascontiguousarray(orders).tobytes()}], PACKED_TYPE)

    return pack


def _packed(rows: DataFrame, parts: int, scale: int, lists: bool, label: str) -> DataFrame:
    ranged = rows.repartitionByRange(parts, "dims", "label", F.monotonically_increasing_id())
    return stored(ranged.mapInArrow(_pack(scale, lists), PACKED), label)


def _meeting(blocks: DataFrame, count: int, batches: DataFrame, keep: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """Every batch of anchors beside every block of rows that may hold what it looks for."""
    asked = batches.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "dims", "ids", "labels", "low", "high", "body")], *more)
    asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).repartition(count, "at")
    met = blocks.repartition(count, "block").join(asked, (F.col("block") == F.col("at")) & (F.col("dims") == F.col("q_dims")) & keep)
    return met.select("ids", "labels", "body", "orders", "q_block", "q_dims", "q_ids", "q_labels", "q_body", *more)


def _block(r: dict) -> Block:
    ids = np.frombuffer(r["ids"], np.int64)
    return Block(ids, np.frombuffer(r["labels"], np.int64), loaded(r["body"], len(ids)), np.frombuffer(r["orders"], np.int32).reshape(-1, len(ids)))


FOUND = [("batch", pa.int64()), ("batch_dims", pa.int64()), ("nth", pa.int64()), ("anchor_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
FOUND_DDL = "batch long, batch_dims long, nth long, anchor_id long, asked long, vec_id long, score long"


def _search(k: int, window: tuple[int, int] | None):
    """Rows (batch, batch_dims, nth, anchor_id, asked, vec_id, score): positives or, with a window, negatives of each asked positive score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                block = _block(r)
                own = np.frombuffer(r["q_ids"], np.int64)
                labels = np.frombuffer(r["q_labels"], np.int64)
                values, anchors = block.fitted(loaded(r["q_body"], len(own)))
                out = {name: [] for name, _ in FOUND}

                def tell(nth: int, asked: int | None, at: np.ndarray, scores: np.ndarray) -> None:
                    for j, s in zip(at.tolist(), scores.tolist()):
                        for name, x in zip(out, (r["q_block"], r["q_dims"], nth, own[nth], asked, block.ids[j], int(s))):
                            out[name].append(x)

                if window is None:
                    for nth, anchor in enumerate(anchors):
                        tell(nth, None, *positives_in(block, values, own[nth], labels[nth], anchor, k))
                else:
                    for ask in r["asks"]:
                        nth = ask["nth"]
                        for p, found in zip(ask["scores"], negatives_in(block, values, labels[nth], anchors[nth], ask["scores"], *window, k)):
                            tell(nth, p, *found)
                yield pa.RecordBatch.from_pydict(out, pa.schema(FOUND))

    return search


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are the first rows of the anchor's label, negatives the first rows of other labels whose score is from
    ``least`` to ``most`` per cent of the positive's; higher scores come first, ties by smaller id. A negative positive score
    leaves no room for negatives. Components become floor(scale * x), whatever their size; a score beyond 64 bits ends the
    query with an error. Rows without id or label and vectors that are missing, empty or hold a
    missing or non-finite component take no part. Only vectors of one length meet. An anchor's own row is every row with
    its id; rows that repeat an id are candidates each, and anchors each. Other columns are not read. No anchor: no rows.
    """
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), column(vectors, vector).cast("array<double>").alias("v"), is_anchor.alias("is_anchor"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = stored(rows.withColumn("dims", F.size("v").cast("long")), "negatives-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    count = split_count(n, rows_per_block)
    plain = rows.select("vec_id", "label", "v", "dims", "is_anchor")
    blocks = _packed(plain, count, scale, True, "negatives-blocks")
    anchors = _packed(plain.filter("is_anchor"), split_count(asked, ANCHORS_PER_BATCH), scale, False, "negatives-anchors")

    same = (F.col("low") <= F.col("q_high")) & (F.col("high") >= F.col("q_low"))
    found = _meeting(blocks, count, anchors, same).mapInArrow(_search(positives, None), FOUND_DDL)
    anchor = ["batch", "batch_dims", "nth"]
    close = _first(found, anchor, positives).select(*anchor, "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    close = stored(close, "negatives-positives")

    # At most `positives` scores an anchor and ANCHORS_PER_BATCH anchors a batch, or somewhat more where ranges are uneven.
    asks = close.groupBy(*anchor).agg(F.collect_set("positive_score").alias("scores")).groupBy("batch", "batch_dims").agg(F.collect_list(F.struct("nth", "scores")).alias("asks"))
    asking = anchors.join(asks, (F.col("block") == F.col("batch")) & (F.col("dims") == F.col("batch_dims")))
    other = (F.col("low") != F.col("high")) | (F.col("q_low") != F.col("q_high")) | (F.col("low") != F.col("q_low"))
    found = _meeting(blocks, count, asking, other, ("asks",)).mapInArrow(_search(negatives, (least, most)), FOUND_DDL)
    far = _first(found, [*anchor, "asked"], negatives).select(*[F.col(c).alias(f"n_{c}") for c in anchor], "asked", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    on = (F.col("positive_score") == F.col("asked")) & (F.col("batch") == F.col("n_batch")) & (F.col("batch_dims") == F.col("n_batch_dims")) & (F.col("nth") == F.col("n_nth"))
    return close.join(far, on).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
