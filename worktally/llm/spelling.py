"""Spelling variants by a dictionary of trie-node pairs.

The words of the corpus form a trie, read forwards, and a second one, read backwards; the nodes of both
are numbered. A word is then, at each position, a pair (node of what stands before, node of what stands
after). Two ways to read a word at position i give two kinds of pairs:

* skipped: (node of ``w[:i]``, node of ``w[i+1:]``); words of one length that share it differ in that code point alone;
* whole: (node of ``w[:i]``, node of ``w[i:]``); it equals a skipped pair of every word that has one code point more.

So all words that are one inserted, deleted or replaced code point apart meet at an equal pair of integers, and no
other words do. Two words of one length meet at one position only. Words a letter apart meet at every place
of a run of that letter; the first place of the run counts. A pair holds at most one whole word and one word for each
letter, 90 in all with the letters of ``RUN``: that bounds a group, and its pairs of words are never spelled out,
as a member needs their number and the two most frequent of them.

Numbering is distributed. Words are sorted into ranges; a scan of a range numbers a node when it meets the
first word below it. The nodes that go on from one range into the next are those of the common prefix of the
words on both sides of the boundary; they are numbered by the first boundary that they cross. Boundaries, two words for
each of at most ``MOST_RANGES`` ranges, are all the driver sees. Nodes with a single word below them are left out:
no other word can meet there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, split_count, stored, table, utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGED_OF = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
#: Texts of more code points are read run by run, without a list of their runs.
LONG = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
WORDS_PER_RANGE = 100_000
#: More words than this many ranges hold make ranges longer; they are scanned as a stream.
MOST_RANGES = 1_024


def damaged(run: str, doc_id: int) -> str:
    """The run, less one code point if the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGED_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            # On bytes, lower() changes A-Z alone.
            text = raw.lower().decode()
            found = RUN.findall(text) if len(text) < LONG else (m[0] for m in RUN.finditer(text))
            for run, n in Counter(found).items():
                if len(run) < LEAST_LENGTH:
                    continue
                word = run if doc_id is None else damaged(run, doc_id)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least 5 code points that occur at least 3 times."""
    rows = docs.select(column(docs, doc_id).cast("string").alias("doc_id"), column(docs, text).alias("text"))
    counts = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def common(a: str, b: str) -> int:
    """Code points that two words begin with together."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 32:  # halve, so that long words cost no loop over their letters
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    while a[low] == b[low]:
        low += 1
    return low


class Boundaries:
    """Which nodes cross from one range of sorted words into the next, and their numbers.

    ``ranges`` are (number, first word, last word), in order, without empty ranges.
    """

    def __init__(self, ranges: list[tuple[int, str, str]]):
        self.left: dict[int, tuple[str, list[int]]] = {}
        self.right: dict[int, tuple[str, list[int]]] = {}
        crossing: list[int] = []
        for b in range(1, len(ranges)):
            before, here = ranges[b - 1], ranges[b]
            depth = common(before[2], here[1])
            through = min(common(before[1], before[2]), len(crossing) - 1)
            crossing = [crossing[i] if i <= through else -((b << 32) | i) - 1 for i in range(depth + 1)]
            self.right[before[0]] = self.left[here[0]] = (here[1][:depth], crossing)


def way(word: str, shared: list[int], counter: int, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[list[int], int]:
    """Numbers of all prefixes of a word and the last number given out, from the numbers it shares with the word sorted before it."""
    path = list(shared)
    if len(path) <= len(word):
        from_left = common(word, left[0]) if left[1] else -1
        from_right = common(word, right[0]) if right[1] else -1
        for depth in range(len(path), len(word) + 1):
            if depth <= from_right:
                path.append(right[1][depth])
            elif depth <= from_left:
                path.append(left[1][depth])
            else:
                counter += 1
                path.append(counter)
    return path, counter


def _scan(bounds: Boundaries):
    """Rows (word, nodes) of words that come sorted by (part, key): numbers of the prefixes of the key that another key shares, shortest first."""
    none = ("", [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, path, key, counter = None, None, [], "", 0
        words: list[str] = []
        nodes: list[list[int]] = []

        def hand(word: str, text: str, own: list[int], deepest: int) -> None:
            for prefix, numbers in (bounds.left.get(part, none), bounds.right.get(part, none)):
                if numbers:
                    deepest = max(deepest, common(text, prefix))
            words.append(word)
            nodes.append(own[: deepest + 1])

        for batch in batches:
            for at, text, word in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != part:
                    if waiting:
                        hand(*waiting)
                    part, waiting, path, key, counter = at, None, [], "", at << 40
                shared = common(key, text) if path else -1
                path, counter = way(text, path[: shared + 1], counter, bounds.left.get(at, none), bounds.right.get(at, none))
                if waiting:
                    hand(waiting[0], waiting[1], waiting[2], max(waiting[3], shared))
                waiting, key = (word, text, path, max(shared, 0)), text
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(nodes, pa.list_(pa.int64()))], ["word", "nodes"])
            words, nodes = [], []
        if waiting:
            hand(*waiting)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(nodes, pa.list_(pa.int64()))], ["word", "nodes"])

    return scan


def trie_nodes(words: DataFrame, backwards: bool, rows: int, each: int = WORDS_PER_RANGE) -> DataFrame:
    """(word, nodes): numbers of the trie nodes on the way of each word that other words pass too, from the root on."""
    key = F.reverse("word") if backwards else F.col("word")
    parts = min(MOST_RANGES, split_count(rows, each))
    ranged = words.select(key.alias("key"), "word").repartitionByRange(parts, "key")
    ranged = stored(ranged.select(F.spark_partition_id().cast("long").alias("part"), "key", "word"), "spelling-ranges")
    bounds = Boundaries(sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("key"), F.max("key")).collect()))
    return ranged.repartition(parts, "part").sortWithinPartitions("part", "key").mapInArrow(_scan(bounds), "word string, nodes array<long>")


def node_pairs(words: DataFrame, rows: int, each: int = WORDS_PER_RANGE) -> DataFrame:
    """(before, after, whole, first, n, word): the pairs of every word; ``first`` is false inside a run of one letter."""
    ahead = trie_nodes(words, False, rows, each)
    back = trie_nodes(words, True, rows, each).select(F.col("word").alias("same"), F.col("nodes").alias("back"))
    both = words.join(ahead, "word").join(back, F.col("word") == F.col("same")).drop("same")
    length, a, b = F.length("word"), F.size("nodes"), F.size("back")

    def places(least, most, pair):
        return F.when(least <= most, F.transform(F.sequence(least, most), pair)).otherwise(F.array().cast("array<struct<before:long,after:long,whole:boolean,first:boolean>>"))

    def skipped(i):
        opens = (i == 0) | (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i, F.lit(1)))
        return F.struct(F.get("nodes", i).alias("before"), F.get("back", length - 1 - i).alias("after"), F.lit(False).alias("whole"), opens.alias("first"))

    def whole(i):
        return F.struct(F.get("nodes", i).alias("before"), F.get("back", length - i).alias("after"), F.lit(True).alias("whole"), F.lit(False).alias("first"))

    skips = places(F.greatest(F.lit(0), length - b), F.least(length, a) - 1, skipped)
    wholes = places(F.greatest(F.lit(0), length - b + 1), F.least(length, a - 1), whole)
    both = both.select("word", "n", F.explode(F.concat(skips, wholes)).alias("pair"))
    return both.select("pair.*", "n", "word")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(word, n_near, best): number of near words and the most frequent of them, as struct<less, word> with less = -n."""
    member = F.struct((-F.col("n")).alias("less"), "word", "whole", "first")
    groups = pairs.groupBy("before", "after").agg(F.array_sort(F.collect_list(member)).alias("all")).filter(F.size("all") > 1)
    groups = groups.select(F.filter("all", lambda m: ~m["whole"]).alias("skips"), F.filter("all", lambda m: m["whole"]).alias("wholes"))
    groups = groups.withColumn("firsts", F.filter("skips", lambda m: m["first"])).filter((F.size("skips") > 1) | (F.size("wholes") > 0))

    def name(m):
        return F.when(m.isNotNull(), F.struct(m["less"].alias("less"), m["word"].alias("word")))

    one, two, shorter = F.get("skips", F.lit(0)), F.get("skips", F.lit(1)), F.get("wholes", F.lit(0))

    def of_skip(m):
        other = name(F.when(one["word"] != m["word"], one).otherwise(two))
        joined = m["first"] & shorter.isNotNull()
        best = F.when(joined, F.least(other, name(shorter))).otherwise(other)
        return F.struct(m["word"].alias("word"), (F.size("skips") - 1 + joined.cast("int")).alias("near"), best.alias("best"))

    def of_whole(m):
        return F.struct(m["word"].alias("word"), F.size("firsts").alias("near"), name(F.get("firsts", F.lit(0))).alias("best"))

    members = groups.select(F.explode(F.concat(F.transform("skips", of_skip), F.transform("wholes", of_whole))).alias("m")).select("m.*").filter("near > 0")
    return members.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``, the end of the chain of forms that starts at a word. Counts double along a chain, so it is short and has no circle."""
    ways = stored(forms.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("root")), "spelling-ways")
    while True:
        onward = ways.select(F.col("at").alias("mid"), F.col("root").alias("far"))
        further = ways.join(onward, F.col("root") == F.col("mid"), "left")
        further = stored(further.select("at", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-ways")
        if not further.filter("moved").limit(1).count():
            break
        ways = further.select("at", "root")
    return forms.join(ways, F.col("word") == F.col("at"), "left").withColumn("root", F.coalesce("root", "word")).drop("at")


def spelling_forms(docs: DataFrame, times: int = TIMES, each: int = WORDS_PER_RANGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least 5 code points that occur at least 3 times.

    A near word is one inserted, deleted or replaced code point away. The form of a word is its most frequent near word,
    of equal ones the first in code-point order, if it occurs at least ``times`` as often; the root is the end of
    the chain of forms.

    Missing and empty texts have no words. A missing id damages no run. Repeated rows count as often as they
    stand there. Words may be of any length. An empty table gives no rows. Other columns are not read.
    """
    if times < 2:
        raise ValueError("counts must grow along a chain of forms: times is 2 at least")
    words = stored(word_counts(docs, doc_id, text), "spelling-words")
    near = neighbours(node_pairs(words, words.count(), each))
    forms = words.join(near.withColumnRenamed("word", "same"), F.col("word") == F.col("same"), "left")
    form_n = -F.col("best.less")
    taken = form_n >= times * F.col("n")
    forms = forms.select("word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, form_n).alias("form_n"))
    return with_roots(stored(forms, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling_forms(table(spark, sf_dir, "documents"))
