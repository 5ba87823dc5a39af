"""Secrets by fixed patterns and by character Markov models, in DataFrame functions only.

The patterns find assignments, access keys and hexadecimal runs. Other secrets are runs of key characters that read like chance.
Two first-order Markov models say how probable each character is after the one before it: one learns from samples of random strings,
one from samples of ordinary identifiers. The sum over a run of the log-likelihood ratio of its steps is compared with a threshold, the
evidence, in bits, that a run must show against the much larger number of ordinary runs.

Labelled samples come from the corpus: what the patterns caught is random, every other run of key characters is ordinary, as nearly all are. Distinct samples
count once, so copies weigh nothing, and a run is judged by counts that it is taken out of. Steps are counted over all documents; the two tables have one row for each pair of
key characters, whatever the size of the corpus, and reach the scoring as one constant array.
The random model is half the samples' and half uniform, since samples know but a few kinds of keys. Ratios are rounded to 1/1000 bit: sums are whole
numbers and do not depend on their order.

Positions come from the lengths of matches and of the pieces between them. Texts without a match skip all of this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, stored, table

# The patterns of assignments, access keys and hexadecimal runs, and the least lengths of what they catch.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run of letters or digits is matched as far as it goes, so asking for its least length at once finds the same matches as dropping shorter ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

KINDS = ["assign", "access", "hex", "markov"]
#: Characters of keys; a run of them is a candidate if it is long enough and has a letter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 16
LEAST_SAMPLE = 12
# Looking behind spares the search from trying a word again at each of its letters; it finds the same runs.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_SAMPLE
BITS = 20
UNIT = 1000
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; written out twice, an expression inside array functions is computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column, start: Column) -> Column:
    return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running(sizes: Column) -> Column:
    """Sums of an array, which is not empty, up to and with each entry; in blocks of 256, so that time stays close to proportional to its length."""

    def in_blocks(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / 256).cast("int")), lambda b: F.slice(all_, b * 256 + 1, 256))
        return let(blocks, over)

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        before = F.slice(_sums(totals, F.lit(0)), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda b, start: F.slice(_sums(b, start), 2, F.size(b))))

    return let(sizes, in_blocks)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches, by code point, with their value: of an assignment what is assigned, else the match."""

    def located(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
        ends = running(F.zip_with(gaps, whole, lambda gap, match: F.length(gap) + F.length(match)))
        spans = F.zip_with(ends, whole, lambda end, match: F.struct((end - F.length(match)).alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), match.alias("value")))
        if kind != "assign":
            return spans.cast(SPAN)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.zip_with(spans, values, lambda s, value: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), value.alias("value"))).cast(SPAN)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__base``, the spans of the patterns, and ``__runs``, the runs of key characters that touch none of them."""
    text = F.coalesce(column(docs, text), F.lit(""))

    def spans(t: Column) -> Column:
        assigned = F.filter(matches(t, ASSIGN, "assign"), lambda m: F.length(m["value"]) >= LEAST_VALUE)
        base = F.array_sort(F.concat(assigned, matches(t, ACCESS, "access"), matches(t, HEX, "hex")))
        return F.struct(base.alias("base"), matches(t, RUN, "markov").alias("runs"))

    def apart(s: Column) -> Column:
        touches = lambda r: F.exists(s["base"], lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        free = F.when(F.size(s["base"]) > 0, F.filter(s["runs"], lambda r: ~touches(r))).otherwise(s["runs"])
        return F.struct(s["base"].alias("base"), free.alias("runs"))

    # A generator ends the projection: what reads the spans later does not compute them again.
    docs = docs.withColumn("__spans", F.explode(F.array(let(let(text, spans), apart))))
    return docs.withColumns({"__base": F.col("__spans.base"), "__runs": F.col("__spans.runs")}).drop("__spans")


def samples(scanned: DataFrame) -> DataFrame:
    """(value, random): distinct labelled samples from the spans of ``with_base``; runs without a letter are numbers, not identifiers."""
    named = F.filter("__runs", lambda r: r["value"].rlike("[A-Za-z]"))
    both = F.concat(F.transform("__base", lambda b: F.struct(b["value"].alias("value"), F.lit(True).alias("random"))), F.transform(named, lambda r: F.struct(r["value"].alias("value"), F.lit(False).alias("random"))))
    return scanned.select(F.explode(both).alias("s")).select("s.*").distinct()


def _codes(value: Column) -> Column:
    """Places in the alphabet, from 1; 0 for other characters."""
    return F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(labelled: DataFrame, own: int = 0) -> DataFrame:
    """One row, one column ``ratios``: the log-likelihood ratio of each step, in 1/1000 bit, at place (from - 1) * size + (to - 1).

    ``own`` is taken off every count of the ordinary model: 1 if the runs to be judged are ordinary samples themselves, so
    that no run speaks for itself.

    ``labelled`` has a text column ``value`` and a boolean column ``random``; missing values or labels and characters
    outside the alphabet are passed over. Without samples of a class its model is uniform.
    """
    size = len(ALPHABET)
    codes = labelled.filter("value is not null and random is not null").select("random", _codes(F.col("value")).alias("c"))
    steps = let(F.col("c"), lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    steps = codes.select("random", F.explode(steps).alias("s")).select("random", "s.*").filter("a > 0 and b > 0")
    counts = steps.groupBy("a", "b").agg(F.count_if("random").alias("chance"), F.count_if(~F.col("random")).alias("plain"))
    every = F.sequence(F.lit(1), F.lit(size))
    grid = labelled.sparkSession.range(1).select(F.explode(every).alias("a")).select("a", F.explode(every).alias("b"))
    cells = grid.join(counts, ["a", "b"], "left").na.fill(0)
    totals = cells.groupBy("a").agg(F.sum("chance").alias("all_chance"), F.sum("plain").alias("all_plain"))
    cells = cells.join(totals, "a")

    def smoothed(n, total, less):
        return (F.greatest(F.col(n) - less, F.lit(0)) + 0.5) / (F.greatest(F.col(total) - less, F.lit(0)) + 0.5 * size)

    ratio = F.log2((smoothed("chance", "all_chance", 0) + 1.0 / size) / 2) - F.log2(smoothed("plain", "all_plain", own))
    cells = cells.select(((F.col("a") - 1) * size + F.col("b") - 1).alias("at"), F.round(ratio * UNIT).cast("int").alias("ratio"))
    # size * size entries, a number that no corpus changes.
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ratio"))), lambda c: c["ratio"]).alias("ratios"))


def evidence(value: Column, ratios: Column) -> Column:
    """Summed log-likelihood ratio of a run, in 1/1000 bit."""
    size = len(ALPHABET)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] > 0, acc["sum"] + F.get(ratios, (acc["last"] - 1) * size + c - 1)).otherwise(acc["sum"]).alias("sum"))
    return F.aggregate(_codes(value), start, step)["sum"]


def judged(scanned: DataFrame, model: DataFrame | None = None, name: str = "secrets", bits: float = BITS) -> DataFrame:
    """Replace the spans of ``with_base`` by ``name``, the base spans and the runs that the model takes for chance, by start and kind."""
    if model is None:
        model = train(samples(scanned), own=1)
    # A constant of size * size numbers; subqueries cannot stand inside array functions.
    ratios = F.split(F.lit(",".join(map(str, model.first()["ratios"]))), ",").cast("array<int>")
    chance = F.filter("__runs", lambda r: (F.length(r["value"]) >= LEAST_RUN) & r["value"].rlike("[A-Za-z]") & (evidence(r["value"], ratios) >= int(bits * UNIT)))
    found = F.when(F.size("__runs") > 0, F.array_sort(F.concat("__base", chance))).otherwise(F.col("__base"))
    found = scanned.withColumn("__found", F.explode(F.array(found)))
    kept = [column(found, c) for c in scanned.columns if c not in (name, "__base", "__runs")]
    return found.select(*kept, F.col("__found").alias(name))


def with_secrets(docs: DataFrame, model: DataFrame | None = None, text: str = "text", name: str = "secrets", bits: float = BITS) -> DataFrame:
    """Add ``name``: array<struct<start, end, kind, value>>, the secrets of each whole text by start and kind, positions in code points, end exclusive.

    Kinds are numbers of ``KINDS``: the base kinds in their order, then runs of at least 16 key characters with a letter that touch no base span and whose
    evidence reaches ``bits``. ``model`` is a result of ``train``; by default samples come from the documents, which are then stored beside
    their spans, so that texts are searched once. Missing and empty
    texts have no secrets. Repeated rows have the same ones each. A column called ``name`` is replaced, other columns
    stay; names that begin with two underscores and spans, base, runs or found are used inside. An empty table gives no rows.
    """
    scanned = with_base(docs, text)
    return judged(scanned if model is not None else stored(scanned, "secrets-spans"), model, name, bits)


def listed(spans: Column) -> Column:
    """Spans as text, kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(stored(with_base(docs).drop("text"), "secrets-spans"))

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.sha2(listed(F.filter("secrets", lambda s: s["kind"] < 3)), 256)
    return found.select("doc_id", *map(number, KINDS[:3]), base.alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


OP13_SQL = r"""
WITH k AS (
  SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS assign,
         'AKIA[A-Z0-9]+' AS access, '[0-9a-f]+' AS hex, '[A-Za-z0-9+/_=-]+' AS run,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-' AS alphabet),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, 0 AS kind, string_split_regex(text, assign) AS gaps, regexp_extract_all(text, assign, 0) AS whole, regexp_extract_all(text, assign, 2) AS vals FROM t, k WHERE regexp_matches(text, assign)
  UNION ALL SELECT r, 1, string_split_regex(text, access), regexp_extract_all(text, access, 0), regexp_extract_all(text, access, 0) FROM t, k WHERE regexp_matches(text, access)
  UNION ALL SELECT r, 2, string_split_regex(text, hex), regexp_extract_all(text, hex, 0), regexp_extract_all(text, hex, 0) FROM t, k WHERE regexp_matches(text, '[0-9a-f]{24}')
  UNION ALL SELECT r, 3, string_split_regex(text, run), regexp_extract_all(text, run, 0), regexp_extract_all(text, run, 0) FROM t, k WHERE regexp_matches(text, run)),
u AS (SELECT r, kind, i, gaps[i] AS gap, whole[i] AS whole, vals[i] AS value FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m)),
p AS (SELECT r, kind, whole, value, sum(length(gap) + length(whole)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM u),
s AS (SELECT r, kind, stop - length(whole) AS start, stop, value FROM p),
base AS (SELECT * FROM s WHERE length(value) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 END),
runs AS (
  SELECT * FROM s WHERE kind = 3 AND length(value) >= 12 AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
samples AS (SELECT value, TRUE AS random FROM base UNION SELECT value, FALSE FROM runs),
steps AS (
  SELECT random, strpos(alphabet, value[i]) AS a, strpos(alphabet, value[i + 1]) AS b
  FROM (SELECT random, value, unnest(range(1, length(value))) AS i FROM samples), k),
n AS (SELECT a, b, count(*) FILTER (random) AS chance, count(*) FILTER (NOT random) AS plain FROM steps WHERE a > 0 AND b > 0 GROUP BY a, b),
grid AS (SELECT a, b FROM (SELECT unnest(range(1, 68)) AS a), (SELECT unnest(range(1, 68)) AS b)),
cells AS (
  SELECT a, b, coalesce(chance, 0) AS chance, coalesce(plain, 0) AS plain,
         sum(coalesce(chance, 0)) OVER (PARTITION BY a) AS all_chance, sum(coalesce(plain, 0)) OVER (PARTITION BY a) AS all_plain
  FROM grid LEFT JOIN n USING (a, b)),
ratios AS (
  SELECT a, b, round((log2(((chance + 0.5::DOUBLE) / (all_chance + 33.5::DOUBLE) + 1.0::DOUBLE / 67) / 2) - log2((greatest(plain - 1, 0) + 0.5::DOUBLE) / (greatest(all_plain - 1, 0) + 33.5::DOUBLE))) * 1000)::BIGINT AS ratio
  FROM cells),
long AS (SELECT DISTINCT value FROM runs WHERE length(value) >= 16),
sums AS (
  SELECT value, sum(ratio) AS evidence
  FROM (SELECT value, strpos(alphabet, value[i]) AS a, strpos(alphabet, value[i + 1]) AS b FROM (SELECT value, unnest(range(1, length(value))) AS i FROM long), k) JOIN ratios USING (a, b)
  GROUP BY value),
found AS (
  SELECT r, kind, start, stop FROM base
  UNION ALL SELECT r, kind, start, stop FROM runs JOIN sums USING (value) WHERE evidence >= 20000),
named AS (SELECT *, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM found),
g AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""
