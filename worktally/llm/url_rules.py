"""URL filter: a trie over reversed host labels and path segments, the longest rule wins.

A rule names a host and a path. It fits that host and every subdomain of it, where the path of the
URL starts with the path of the rule. Among fitting rules the most specific host wins, then the
longest path; of an allow and a block rule that are the same, block. URLs that no rule fits get
``otherwise``.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, table

#: Rules that may travel to every task; more are joined instead.
BROADCAST_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Keys of a node that no label or segment equals.
PATHS, ENDS = 0, 1


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Host labels from the last to the first; below a host, under ``PATHS``, the path segments.

    A rule ends at a whole segment (its path ends with ``/``) or within one; what it asks of that last
    segment is kept as a text the segment has to start with.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(ENDS, {})
        if ends.get(last, ("", ""))[0] != "block":
            ends[last] = (verdict, host + path)
    return root


def longest_path(node: dict, path: str):
    """The rule with the longest path that the URL's path starts with, or None."""
    best = None
    segments = path.split("/")
    for segment in segments:
        ends = node.get(ENDS, {})
        fit = max((p for p in ends if segment.startswith(p)), key=len, default=None)
        best = best if fit is None else ends[fit]
        if segment not in node:
            return best
        node = node[segment]
    return best


def longest_match(root: dict, host: str, path: str):
    """Walk the labels of the host from the last one, keep the deepest host that has a fitting path."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = (longest_path(node[PATHS], path) if PATHS in node else None) or best
    return best


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(pickle.dumps(build_trie(rules)))
    kept: dict = {}

    @F.arrow_udf("struct<verdict:string,rule:string>")
    def match(host: pa.Array, path: pa.Array) -> pa.Array:
        if "trie" not in kept:
            kept["trie"] = pickle.loads(trie.value)
        found = [longest_match(kept["trie"], h, p) or (None, None) for h, p in zip(host.to_pylist(), path.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["verdict", "rule"]
        )

    return urls.withColumn("__hit", match("__host", "__path"))


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule tables too large to send around: each URL asks for its host suffixes and path prefixes by equality."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("length", F.length("path"))
    lengths = rules.select("length").distinct().agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    labels = F.split("__host", r"\.")
    asked = (
        urls.select("__host", "__path").distinct().crossJoin(F.broadcast(lengths))
        .withColumn("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))))
        .withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("__path"))))
        .withColumn("path", F.expr("left(__path, length)"))
    )
    hit = F.struct(F.size(F.split("host", r"\.")).alias("depth"), "length", "verdict", F.concat("host", "path").alias("rule"))
    best = asked.join(rules, ["host", "path", "length"]).groupBy("__host", "__path").agg(F.max(hit).alias("__hit"))
    return urls.join(best, ["__host", "__path"], "left")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", otherwise: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to pages, replacing columns of these names.

    ``rules`` are (verdict, host, path), as a list or a DataFrame of these columns. Missing URLs and
    URLs without ``://`` have an empty host and path, fit no rule and get ``otherwise``; so does every
    URL when there are no rules. An empty path fits no rule, as rules' paths start with ``/``.
    """
    spark = pages.sparkSession
    urls = pages.withColumns({"__host": host_of(column(pages, url)), "__path": path_of(column(pages, url))})
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(broadcast_rules + 1).collect()
        rules = [tuple(r) for r in few] if len(few) <= broadcast_rules else rules
    elif len(rules) > broadcast_rules:
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    judged = _by_join(urls, rules) if isinstance(rules, DataFrame) else _by_trie(urls, rules)
    out = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__hit.rule"), "verdict": F.coalesce("__hit.verdict", F.lit(otherwise))}
    return judged.withColumns(out).drop("__host", "__path", "__hit")


#: The rules of the registered query (fixed values).
QUERY_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, QUERY_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, c.host, c.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
"""
