"""Near-duplicate vectors by cosine, found with an inverted multi-index.

The halves of the unit vectors have codebooks of their own; a pair of code words is a cell of the
product grid. A row visits the cells nearest to it in the order of the summed half distances (the
multi-sequence walk over two sorted lists), as many as a sample of queries needs to reach the target
recall against brute force, and meets the rows that live there. Where too few of the sample have partners
to measure that, as many as partners planted at the cosine itself need. Every meeting is verified by the
cosine in double precision.

Equal vectors are one entry with a count. In a cell, residents and visitors are cut into blocks, and each
pair of blocks is a task-sized group, so a crowded cell is spread. A group hands on counts and links
that connect what it connected, one for each entry, never its pairs. A pair that both sides find is
counted once on each side: a visitor always counts its find, a resident only if it does not visit the
visitor's cell itself.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table
from worktally.llm.components import components
from worktally.llm.simhash import roots
from worktally.llm.vectors import matrix, usable

COSINE = 0.9
#: The codebooks are fitted on about this many entries, the number of visits on this many queries or more; all entries are indexed.
FIT_ROWS = 20_000
FIT_QUERIES = 1_000
#: Queries with a partner that the number of visits rests on at least; more are drawn while they are fewer.
FIT_PARTNERED = 200
TARGET_RECALL = 0.995
LEAST_VISITS = 4
ROWS_PER_CELL = 256
MOST_CODES = 512
BLOCK = 1_024


def fit_codes(rows: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """A codebook by Lloyd's algorithm, from a fixed start; unused code words stay where they are."""
    book = rows[np.random.default_rng(0).choice(len(rows), codes, replace=False)]
    for _ in range(rounds):
        own = distances(rows, book).argmin(1)
        count = np.bincount(own, minlength=codes)
        for d in range(rows.shape[1]):
            total = np.bincount(own, weights=rows[:, d], minlength=codes)
            book[:, d] = np.where(count > 0, total / np.maximum(count, 1), book[:, d])
    return book


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ book.T + (book**2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, visits: int) -> list[int]:
    """Cells (i * len(second) + j) by first[i] + second[j]: a heap grows along both sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(second) + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


class Grid:
    """Two codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        codes = min(codes, len(sample))
        self.books = [fit_codes(part, codes) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, : self.half], sample[:, self.half :])]

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return [distances(rows[:, : self.half], self.books[0]), distances(rows[:, self.half :], self.books[1])]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = self.parts(rows)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)


def unit(vectors: pa.Array) -> np.ndarray:
    rows = matrix(vectors)
    rows = rows / np.maximum(np.abs(rows).max(1), 1e-300)[:, None]
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def cell_ranks(grid: Grid, rows: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """For each row, the number of cells that its walk meets before the cell of the same place in ``homes``."""
    width = len(grid.books[1])
    first, second = grid.parts(rows)
    reach = first[np.arange(len(rows)), homes // width] + second[np.arange(len(rows)), homes % width]
    rank = np.zeros(len(rows), np.int64)
    step = max(1, (1 << 22) // (len(grid.books[0]) * width))
    for a in range(0, len(rows), step):
        b = slice(a, a + step)
        rank[b] = (first[b][:, :, None] + second[b][:, None, :] < reach[b][:, None, None] - 1e-12).sum((1, 2))
    return rank


def planted_visits(grid: Grid, queries: np.ndarray, cosine: float) -> int:
    """Visits after which the target share of pairs at exactly ``cosine`` meets, from either side.

    A partner is planted beside each query, once towards a random direction and once towards another query, as data
    that fill few dimensions have their neighbours there; the larger number counts.
    """
    rng = np.random.default_rng(0)
    visits = LEAST_VISITS
    for turn in (rng.standard_normal(queries.shape), queries[rng.permutation(len(queries))]):
        turn = turn - (turn * queries).sum(1)[:, None] * queries
        size = np.sqrt((turn**2).sum(1))
        own, turn = queries[size > 1e-9], (turn / np.maximum(size, 1e-300)[:, None])[size > 1e-9]
        if len(own):
            partners = cosine * own + np.sqrt(max(0.0, 1 - cosine**2)) * turn
            ranks = np.sort(np.minimum(cell_ranks(grid, own, grid.cells(partners)), cell_ranks(grid, partners, grid.cells(own))))
            visits = max(visits, int(ranks[int(np.ceil(TARGET_RECALL * len(ranks))) - 1]) + 1)
    return visits


def _needed_visits(entries: DataFrame, grid: Grid, nodes: np.ndarray, sample: np.ndarray, count: int, cosine: float) -> int:
    """Visits after which sampled queries have met the target share of their true partners, by query and by pair.

    More queries are drawn from the sample until ``FIT_PARTNERED`` of them have a partner besides themselves. If the sample
    ends before and is not the whole table, planted partners have a say too.
    """
    cells = len(grid.books[0]) * len(grid.books[1])
    drawn = np.random.default_rng(1).permutation(len(sample))
    tables, used, more, partnered = [], 0, FIT_QUERIES, 0.0
    while used < len(drawn) and partnered < FIT_PARTNERED:
        part = drawn[used : used + more]
        by_rank = _ranks_of_partners(entries, grid, nodes[part], sample[part], cells, cosine)
        tables.append(by_rank)
        used, more, partnered = used + len(part), min(2 * more, 4 * FIT_QUERIES), partnered + by_rank["shares"].sum()
    table_ = pd.concat(tables).groupby("rank", as_index=False).sum().sort_values("rank")
    visits = LEAST_VISITS
    if len(table_):
        enough = np.minimum(table_["pairs"].cumsum() / table_["pairs"].sum(), table_["shares"].cumsum() / table_["shares"].sum()) >= TARGET_RECALL - 1e-9
        visits = max(visits, int(table_["rank"][enough].min()) + 1)
    if partnered < FIT_PARTNERED and len(sample) < count:
        visits = max(visits, planted_visits(grid, sample[drawn[:FIT_QUERIES]], cosine))
    return visits


def _ranks_of_partners(entries: DataFrame, grid: Grid, nodes: np.ndarray, queries: np.ndarray, cells: int, cosine: float) -> pd.DataFrame:
    """(rank, pairs, shares): true partners by the rank of their cell in the query's walk, and these as shares of the query's partners."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            own, homes = batch.column("node").to_numpy(), grid.cells(rows)
            for a in range(0, len(queries), FIT_QUERIES):
                q, r = np.nonzero(queries[a : a + FIT_QUERIES] @ rows.T >= cosine)
                q = q + a
                apart = nodes[q] != own[r]  # no vector is a partner of itself
                q, r = q[apart], r[apart]
                both, n = np.unique(q * cells + cell_ranks(grid, queries[q], homes[r]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"query": both // cells, "rank": both % cells, "n": n.astype(np.int64)})

    found = entries.select("node", "unit").mapInArrow(ranks, "query long, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    found = stored(found, "copies-ranks")
    total = found.groupBy("query").agg(F.sum("n").alias("all"))
    by_rank = found.join(total, "query").groupBy("rank").agg(F.sum("n").alias("pairs"), F.sum(F.col("n") / F.col("all")).alias("shares"))
    # At most one row for each of the grid's cells.
    return by_rank.toPandas()


def _meet(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts (node, weight) and connecting links (node, other) of one block of residents and one of visitors."""
    live, come = group[group["resident"]], group[~group["resident"]]
    out = {"node": [], "other": [], "count": []}
    if len(live) and len(come):
        rows = lambda g: np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1)
        a, b = rows(come), rows(live)
        id_a, id_b = come["node"].to_numpy(), live["node"].to_numpy()
        if a.shape[1] == b.shape[1]:
            x, y = np.nonzero(a @ b.T >= cosine)
            apart = id_a[x] != id_b[y]
            x, y = x[apart], y[apart]
            copies_a, copies_b = come["copies"].to_numpy(), live["copies"].to_numpy()
            home = come["home"].to_numpy()
            own = [np.frombuffer(v, np.int32) for v in live["visits"]]
            visits = np.array(own) if own else np.zeros((0, 0))
            mutual = (visits[y] == home[x][:, None]).any(1) if len(y) else np.zeros(0, bool)
            counts_a = np.bincount(x, weights=copies_b[y], minlength=len(a))
            counts_b = np.bincount(y[~mutual], weights=copies_a[x[~mutual]], minlength=len(b))
            nodes, at = np.unique(np.concatenate((id_a, id_b)), return_inverse=True)
            low = roots(at[: len(a)][x], at[len(a) :][y], len(nodes))
            moved = np.flatnonzero(low != np.arange(len(nodes)))
            total = np.bincount(at, weights=np.concatenate((counts_a, counts_b)), minlength=len(nodes)).astype(np.int64)
            keep = np.flatnonzero(total)
            out = {"node": np.concatenate((nodes[keep], nodes[moved])), "other": np.concatenate((nodes[keep], nodes[low[moved]])), "count": np.concatenate((total[keep], np.zeros(len(moved), np.int64)))}
    return pd.DataFrame(out).astype("int64")


def vector_groups(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): direct links, the least id that links reach, and whether the row is that one.

    Vectors that are missing, empty, zero or hold a missing or non-finite component link with nothing;
    neither do rows without an id (their component is missing and they are not kept). Only vectors of one
    length are compared. Rows that repeat a vector count as copies of it, also under the same id; rows that
    share an id but not the vector share what their vectors reach. An empty table gives no rows.
    """
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("vec_id"), column(vectors, vector).alias("v"))
    fit = F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v"))), "copies-rows")

    @F.arrow_udf("binary")
    def as_unit(values: pa.Array) -> pa.Array:
        out = [b""] * len(values)
        lengths = np.diff(values.offsets.to_numpy())
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for i, r in zip(at, unit(values.take(pa.array(at)))):
                out[i] = r.tobytes()
        return pa.array(out, pa.binary())

    entries = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    entries = stored(entries.select("v", "node", "copies", F.size("v").alias("dims"), as_unit("v").alias("unit")), "copies-entries")
    figures = []
    for r in entries.groupBy("dims").count().collect():
        figures.append(_links_of(entries.filter(F.col("dims") == r["dims"]).select("node", "copies", "unit"), r["count"], cosine))
    found = figures[0] if figures else vectors.sparkSession.createDataFrame([], "node long, other long, count long")
    for more in figures[1:]:
        found = found.unionByName(more)
    found = stored(found, "copies-found")

    counts = found.filter("count > 0").groupBy("node").agg(F.sum("count").alias("count"))
    reached = components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    result = (
        entries.select("v", "node", "copies").join(counts, "node", "left").join(reached, "node", "left")
        .select(F.col("v").alias("entry"), (F.coalesce("count", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    result = stored(result, "copies-result")
    out = rows.join(result, rows["v"] == result["entry"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links_of(entries: DataFrame, count: int, cosine: float) -> DataFrame:
    """(node, other, count) of entries of one length: counts where node = other, links where not."""
    spark = entries.sparkSession

    def read(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        taken = df.select("node", "unit").collect()
        return np.array([r[0] for r in taken], np.int64), np.array([np.frombuffer(r[1], np.float64) for r in taken])

    dice = F.pmod(F.xxhash64("node", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    nodes, sample = read(entries.filter(dice <= FIT_ROWS / count).orderBy("node").limit(2 * FIT_ROWS))
    if not len(sample):
        nodes, sample = read(entries.orderBy("node").limit(1))
    grid = Grid(sample, min(MOST_CODES, max(1, int(np.sqrt(count / ROWS_PER_CELL)))))
    visits = _needed_visits(entries, grid, nodes, sample, count, cosine)
    sent = spark.sparkContext.broadcast(pickle.dumps(grid))
    kept: dict = {}

    @F.arrow_udf("struct<home:int,visits:binary>")
    def place(units: pa.Array) -> pa.Array:
        if "grid" not in kept:
            kept["grid"] = pickle.loads(sent.value)
        own: Grid = kept["grid"]
        rows = np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)
        walks = [walk(a, b, visits) for a, b in zip(*own.parts(rows))]
        # The nearest cell is the home, also where distances are equal.
        return pa.StructArray.from_arrays([pa.array([w[0] for w in walks], pa.int32()), pa.array([np.array(w, np.int32).tobytes() for w in walks], pa.binary())], ["home", "visits"])

    @F.arrow_udf("array<int>")
    def numbers(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(p, np.int32).tolist() for p in packed.to_pylist()], pa.list_(pa.int32()))

    placed = stored(entries.withColumn("at", place("unit")).select("node", "copies", "unit", "at.home", "at.visits"), "copies-placed")
    calls = placed.withColumn("cell", F.explode(numbers("visits")))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = calls.groupBy("cell").count().withColumnRenamed("count", "come").join(placed.groupBy(F.col("home").alias("cell")).count().withColumnRenamed("count", "live"), "cell")
    # One row for each cell of the grid, MOST_CODES squared at most.
    sizes = F.broadcast(stored(sizes.select("cell", blocks("come").alias("come_blocks"), blocks("live").alias("live_blocks")), "copies-cells"))
    shown = ["cell", "live_block", "come_block", "resident", "node", "copies", "unit", "home", "visits"]
    own = F.xxhash64("node", F.lit("block"))
    live = (
        placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("resident", F.lit(True))
        .withColumn("live_block", F.pmod(own, F.col("live_blocks")).cast("int"))
        .withColumn("come_block", F.explode(F.sequence(F.lit(0), F.col("come_blocks") - 1)))
    )
    come = (
        calls.join(sizes, "cell").withColumn("resident", F.lit(False))
        .withColumn("come_block", F.pmod(own, F.col("come_blocks")).cast("int"))
        .withColumn("live_block", F.explode(F.sequence(F.lit(0), F.col("live_blocks") - 1)))
    )
    meeting = live.select(*shown).unionByName(come.select(*shown))
    return meeting.groupBy("cell", "live_block", "come_block").applyInPandas(lambda group: _meet(group, cosine), "node long, other long, count long")


def op9_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return vector_groups(table(spark, sf_dir, "embeddings"))
