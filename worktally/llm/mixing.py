"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target of words. A source whose target is ``r`` times its size takes each of its
documents ``floor(r)`` times for certain; the words still missing, its budget, come from one more copy of some documents.
Inclusion probabilities of that copy grow with the size of a document, ``min(1, c * size)``, with ``c`` such that the expected words
are the budget; documents longer than the budget cannot be included. Documents of probability 1 are taken first, the others are ranked by their random
odds, from a hash of the id, divided by their inclusion odds.

The sample is fixed in words. The ranking is taken from its beginning; a document that exceeds the words still
missing is passed over, and the ranking goes on. In the end every document that is left exceeds what is missing, and the one that
comes closest closes the sample if it brings its source nearer to the target: the miss is at most half of the shortest document left.

All sources go through the ranking together, in rounds from one passed-over document to the next. A round adds up the words of
sorted ranges, finds the range where the budget ends, and orders that range alone; a hot source fills many
ranges and no source passes through one task. What the driver reads are sums over sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Sources whose totals may travel to every task; more are joined by key.
BROADCAST_SOURCES = 20_000
DOCS_PER_RANGE = 5_000
SOURCES_PER_TASK = 50_000
#: A task of a round orders one range for each of so many sources.
SOURCES_PER_ROUND = 64

#: White space is the space and the control characters 9 to 13, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that only the id and the seed decide."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_key(doc_id))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sources(totals: DataFrame, n: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the ``n`` sources, by code point and missing last, the weights in turn; ranks come from sorted ranges and the rows before them."""
    parts = split_count(n, SOURCES_PER_TASK)
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(totals.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("first") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    return stored(ranged.join(firsts, "part").select("source", "source_size", "docs", weight.cast("double").alias("weight")), "mix-weights")


def with_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Share all words by weight; a target stops at ``most`` times its source, the excess is shared again until none is above."""
    total, level, capped = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    ceiling = F.col("source_size") * most
    while True:
        above = ceiling < F.lit(level) * F.col("weight")
        held, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(above, ceiling)), F.lit(0)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if n == capped or not weight:
            break
        capped, level = n, float(total - held) / weight
    target = F.when(ceiling < F.lit(level) * F.col("weight"), ceiling.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def inclusion_factors(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(source, factor): the ``c`` of inclusion probabilities min(1, c * size) whose expected words are the budget; no row where all are 1.

    Works on the distinct sizes of a source, at most the words of its longest text.
    """
    fits = of_source(sized, sources, n).filter((F.col("size") > 0) & (F.col("size") <= F.col("budget")))
    sizes = fits.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("budget").alias("budget"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("size").cast("decimal(18,0)") * F.col("n")
    certain = F.coalesce(F.sum(whole).over(larger), F.lit(0)).cast("double")
    factor = (F.col("budget") - certain) / F.sum((F.col("size").cast("decimal(18,0)") * F.col("size") * F.col("n")).cast("decimal(38,0)")).over(others).cast("double")
    sizes = sizes.withColumn("factor", factor).filter(F.col("factor") * F.col("size") < 1)
    return sizes.groupBy("source").agg(F.max_by("factor", "size").alias("factor"))


def ranking(doc_id: Column, size: Column, seed: str) -> Column:
    """Random odds divided by inclusion odds; certain documents before all others."""
    chance = F.col("factor") * size
    u = uniform(doc_id, seed)
    return F.when(chance >= 1, u - 1).otherwise((u / (1 - u)) / (chance / (1 - chance)))


def place(doc_id: Column, size: Column, seed: str) -> Column:
    """Where a document stands in the ranking of its source."""
    return F.struct(ranking(doc_id, size, seed).alias("rank"), id_key(doc_id).alias("id"), size.alias("size"))


def _rounds(units: DataFrame, sources: DataFrame, n: int, parts: int) -> DataFrame:
    """(source, from, to, gap): documents between two places that are not longer than the gap are taken; no ``to``: up to the end.

    ``units`` lie in so many ranges of (source, place), so there are at most as many sums as ranges and sources together.
    """
    few_sums, few_sources = split_count(parts + n, SOURCES_PER_TASK), split_count(n, SOURCES_PER_ROUND)
    start = F.struct(F.lit(-2.0).alias("rank"), F.lit("").alias("id"), F.lit(0).cast("long").alias("size"))
    state = stored(sources.filter("budget > 0").select("source", start.alias("from"), F.col("budget").alias("gap")), "mix-state")
    rounds = []
    while True:
        open_ = of_source(units, state, n).filter((F.col("place") > F.col("from")) & (F.col("place.size") <= F.col("gap")))
        sums = open_.groupBy("source", "part").agg(F.sum("own").alias("held"), F.first("gap").alias("gap"))
        up_to = Window.partitionBy("source").orderBy("part")
        sums = sums.repartition(few_sums, "source").withColumn("upto", F.sum("held").over(up_to)).filter(F.col("upto") > F.col("gap"))
        ends = sums.groupBy("source").agg(F.min("part").alias("end_part"), F.min_by(F.col("upto") - F.col("held"), "part").alias("before"))
        inside = of_source(open_, ends, n).filter(F.col("part") == F.col("end_part")).repartition(few_sources, "source")
        inside = inside.withColumn("upto", F.col("before") + F.sum("own").over(Window.partitionBy("source").orderBy("place")))
        over = inside.filter(F.col("upto") > F.col("gap")).groupBy("source").agg(F.min(F.struct("place", (F.col("gap") - F.col("upto") + F.col("own")).alias("gap"))).alias("next"))
        onward = stored(over.select("source", F.col("next.place").alias("from"), F.col("next.gap").alias("gap")), "mix-state")
        following = onward.select("source", F.col("from").alias("to"))
        named = following.withColumnRenamed("source", "__source")
        rounds.append(state.join(few(named, n), state["source"].eqNullSafe(named["__source"]), "left").select("source", "from", "to", "gap"))
        if onward.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        state = onward


def mixing_plan(sized: DataFrame, seed: str) -> DataFrame:
    """Per source: size, target, ``whole`` copies of each document, and what decides on one more: ``factor``, ``steps`` and ``closing``.

    ``sized`` has doc_id, source and size.
    """
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "mix-totals")
    n, docs = totals.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    sources = with_targets(weighted_sources(totals, n))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(ratio))
    sources = stored(sources.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    factors = inclusion_factors(sized, sources, n).withColumnRenamed("source", "__source")
    sources = sources.join(few(factors, n), sources["source"].eqNullSafe(factors["__source"]), "left").drop("__source")
    sources = stored(sources.withColumn("factor", F.coalesce("factor", F.lit(float("inf")))), "mix-sources")

    ranked = of_source(sized, sources, n).filter("size > 0 and budget > 0")
    ranked = ranked.select("source", "budget", place(F.col("doc_id"), F.col("size"), seed).alias("place"))
    units = ranked.groupBy("source", "budget", "place").agg(F.count("*").alias("n")).select("source", "budget", "place", (F.col("n") * F.col("place.size")).alias("own"))
    parts = split_count(docs, DOCS_PER_RANGE)
    ranged = units.repartitionByRange(parts, "source", "place")
    units = stored(ranged.withColumn("part", F.spark_partition_id()), "mix-units")
    steps = _rounds(units.filter(F.col("place.size") <= F.col("budget")).drop("budget"), sources, n, parts)
    steps = stored(steps.groupBy("source").agg(F.collect_list(F.struct("from", "to", "gap")).alias("steps")), "mix-steps")

    # The words still missing, and the document left that comes closest to them.
    decided = of_source(units, steps, n).withColumn("taken", stepped(F.col("place")))
    gaps = decided.groupBy("source").agg((F.first("budget") - F.sum(F.when(F.col("taken"), F.col("own")).otherwise(0))).alias("gap"))
    miss = F.abs(F.col("own") - F.col("gap"))
    left = of_source(decided, gaps, n).filter(~F.col("taken") & (miss < F.col("gap")))
    closing = left.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "place.id", "place.size")).alias("closing"))
    plan = sources
    for more in (steps, closing):
        named = more.withColumnRenamed("source", "__source")
        plan = plan.join(few(named, n), plan["source"].eqNullSafe(named["__source"]), "left").drop("__source")
    return stored(plan.select("source", "source_size", "target", "whole", "factor", "steps", F.struct("closing.id", "closing.size").alias("closing")), "mix-plan")


def stepped(at: Column) -> Column:
    """A place lies in one of the ``steps`` and is not longer than its gap."""
    inside = lambda s: (at > s["from"]) & (s["to"].isNull() | (at < s["to"])) & (at["size"] <= s["gap"])
    return F.coalesce(F.exists("steps", inside), F.lit(False))


def few(sources: DataFrame, n: int) -> DataFrame:
    """Broadcast a table with a row for some or all of ``n`` sources if they are few."""
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def of_source(df: DataFrame, sources: DataFrame, n: int | None = None) -> DataFrame:
    """Put the figures of its source beside each row; a missing source is a source. ``n`` bounds the sources, which else are counted."""
    n = sources.count() if n is None else n
    sources = sources.withColumnRenamed("source", "__source")
    return df.join(few(sources, n), df["source"].eqNullSafe(sources["__source"])).drop("__source")


def copies(doc_id: Column, size: Column, seed: str) -> Column:
    """Times that the plan takes a document; one without words is in the whole copies only."""
    at = place(doc_id, size, seed)
    closes = F.struct(id_key(doc_id).alias("id"), size.alias("size")) == F.col("closing")
    more = F.when(size > 0, stepped(at) | F.coalesce(closes, F.lit(False))).otherwise(F.lit(False))
    return (F.col("whole") + more.cast("int")).cast("int")


def mix(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (doc_id, source, size) and the plan by source that decides on their copies.

    Missing and empty texts have size 0; where their source repeats documents, so are they, adding no
    words. A missing source is a source, the last one. Rows of a source that share id and size share their fate. A missing id
    is an id. Empty tables give empty results.
    """
    sized = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, source).alias("source"), words(column(docs, text)).alias("size"))
    sized = stored(sized, "mix-sizes")
    return sized, mixing_plan(sized, seed)


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    _, plan = mix(docs, seed)
    names = {c: f"__mix_{c}" for c in plan.columns}
    plan = plan.withColumnsRenamed(names)
    joined = docs.join(few(plan, plan.count()), docs["source"].eqNullSafe(plan["__mix_source"]))
    figures = {c: F.col(f"__mix_{c}") for c in ("whole", "factor", "steps", "closing")}
    taken = joined.select(*[joined[f"`{c}`"].alias(f"__doc_{i}") for i, c in enumerate(docs.columns)], joined["doc_id"].alias("__id"), words(joined["text"]).alias("__size"), *[v.alias(k) for k, v in figures.items()])
    taken = taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("__id"), F.col("__size"), seed))))
    return taken.select(*[F.col(f"__doc_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when 20 sources share 100 % of all words by weights 1, 2, 3."""
    sized, plan = mix(table(spark, sf_dir, "documents"))
    rows = of_source(sized, plan)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("size"), "mix")).cast("long").alias("taken"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') AS id,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ssize, count(*) AS docs, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * ssize / w, source NULLS LAST) AS k FROM s),
lv AS (  -- level when the k - 1 smallest ratios are held at their ceilings
  SELECT k, ssize, w,
         ((SELECT sum(ssize) FROM s) - coalesce(sum(3 * ssize) OVER before, 0))::DOUBLE
           / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0)) AS level
  FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, k) AS level FROM lv WHERE 3 * ssize >= level * w),
t AS (SELECT source, ssize, docs, CASE WHEN 3 * ssize < level * w THEN (3 * ssize)::DOUBLE ELSE level * w END AS target FROM s, l),
r AS (SELECT *, CASE WHEN ssize > 0 THEN target / ssize ELSE 0.0::DOUBLE END AS ratio FROM t),
c AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * ssize AS budget FROM r),
h AS (SELECT d.source, d.size, count(*)::HUGEINT AS n, any_value(c.budget) AS budget FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
      WHERE d.size > 0 AND d.size <= c.budget GROUP BY d.source, d.size),
w AS (SELECT source, size,
             (budget - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
               / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS factor
      FROM h),
f AS (SELECT source, arg_max(factor, size) AS factor FROM w WHERE factor * size < 1 GROUP BY source),
x AS (SELECT c.*, coalesce(f.factor, 'inf'::DOUBLE) AS factor FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source),
u AS (SELECT d.source, d.id, d.size, x.budget, x.factor * d.size AS chance, (('0x' || substr(md5('mix:' || d.id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source WHERE d.size > 0 AND x.budget > 0),
q AS (SELECT source, budget, id, size, count(*) * size AS own, CASE WHEN chance >= 1 THEN u - 1 ELSE (u / (1 - u)) / (chance / (1 - chance)) END AS rank
      FROM u GROUP BY source, budget, id, size, chance, u),
g AS (
  SELECT source, 0 AS k, budget AS gap, -2.0::DOUBLE AS rank, '' AS id, 0::BIGINT AS size FROM c WHERE budget > 0
  UNION ALL
  SELECT source, k + 1, gap - coalesce(max(upto) FILTER (upto <= gap), 0), min(stop).r, min(stop).i, min(stop).s
  FROM (SELECT source, k, gap, upto, CASE WHEN upto > gap THEN {'r': rank, 'i': id, 's': size} END AS stop
        FROM (SELECT g.source, g.k, g.gap, q.rank, q.id, q.size, sum(q.own) OVER (PARTITION BY g.source ORDER BY q.rank, q.id, q.size) AS upto
              FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source AND q.size <= g.gap
                AND (q.rank > g.rank OR (q.rank = g.rank AND (q.id > g.id OR (q.id = g.id AND q.size > g.size))))))
  GROUP BY source, k, gap HAVING max(upto) > gap),
steps AS (SELECT *, lead(rank) OVER o AS to_rank, lead(id) OVER o AS to_id, lead(size) OVER o AS to_size FROM g WINDOW o AS (PARTITION BY source ORDER BY k)),
tk AS (SELECT DISTINCT q.source, q.id, q.size FROM q JOIN steps s ON q.source IS NOT DISTINCT FROM s.source AND q.size <= s.gap
         AND (q.rank > s.rank OR (q.rank = s.rank AND (q.id > s.id OR (q.id = s.id AND q.size > s.size))))
         AND (s.to_rank IS NULL OR q.rank < s.to_rank OR (q.rank = s.to_rank AND (q.id < s.to_id OR (q.id = s.to_id AND q.size < s.to_size))))),
e AS (SELECT q.*, tk.id IS NOT NULL AS taken, q.budget - coalesce(sum(CASE WHEN tk.id IS NOT NULL THEN q.own END) OVER (PARTITION BY q.source), 0) AS gap
      FROM q LEFT JOIN tk ON q.source IS NOT DISTINCT FROM tk.source AND q.id = tk.id AND q.size = tk.size),
z AS (SELECT source, min({'miss': abs(own - gap), 'id': id, 'size': size}) AS closing FROM e WHERE NOT taken AND abs(own - gap) < gap GROUP BY source)
SELECT d.doc_id, d.size, x.ssize AS source_size, x.target,
       (d.size * (x.whole + CASE WHEN coalesce(e.taken, FALSE) OR coalesce(z.closing.id = d.id AND z.closing.size = d.size, FALSE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.id = e.id AND d.size = e.size
LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""
