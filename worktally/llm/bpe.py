"""Byte-level BPE encoding and decoding.

Merges run in Spark higher-order functions: a word is an array of byte strings, and ``aggregate`` folds
over it, each step joining the first adjacent pair of the lowest rank, which a literal map of ranks gives (an
array of small maps, as Spark searches a map from its start). Byte strings travel as Latin-1 text, one
character for each byte, so that they can be joined and looked up as text.

The distinct words of the corpus are counted, and the ``WORDS`` most frequent are folded once each; this
bounded dictionary is broadcast. Texts are split and looked up in Arrow batches. Words that it lacks, the
rare ones and those of more than ``FOLD_BYTES`` bytes, for which a fold would take quadratic time, are
merged with a heap in the batch, to the same pieces: a fold for every rare occurrence took about 40 %
more CPU time than the check tool allows (see the README).
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, stored, table

WORDS = 1 << 18
FOLD_BYTES = 128
#: Distinct words that a task holds before it hands their counts on.
BATCH_WORDS = 150_000
BUCKETS = 1 << 14
VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


# Letters, numbers and white space among the code points up to U+00FF.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t-\r\x85\xa0"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text.

    For texts within Latin-1 the public pattern is spelled out in the classes above, which the standard
    matcher runs through in less than half the time.
    """
    anything = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return anything
    western = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return anything(text)
        return western(text)

    return split


def latin(text: Column) -> Column:
    """The UTF-8 bytes of a text as Latin-1 characters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


class Ranks:
    """A vocabulary as literals of Spark expressions."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for rank, piece in enumerate(pieces):
            name = piece.decode("latin-1")
            buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
        self._buckets = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self._pieces = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")

    def rank(self, piece: Column) -> Column:
        """Rank of a byte string, missing if it is none of the vocabulary."""
        return F.element_at(F.element_at(self._buckets, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int")), piece)

    def _merge(self, parts: Column) -> Column:
        n = F.size(parts)
        ranks = F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n), lambda a, b: F.when(b.isNotNull(), self.rank(F.concat(a, b))))

        def joined(p: Column) -> Column:
            pair = F.concat(F.element_at(parts, p), F.element_at(parts, p + 1))
            return F.when(p.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), p - 1), F.array(pair), F.slice(parts, p + 2, n)))

        # One-element arrays bind the ranks and the place of the lowest, so that each is worked out once.
        lowest = F.transform(F.array(ranks), lambda r: F.array_position(r, F.array_min(r)).cast("int"))
        return F.element_at(F.transform(lowest, joined), 1)

    def fold(self, word: Column) -> Column:
        """Ids of one word given as Latin-1 text of its bytes; it has to have a byte."""
        parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
        merged = F.aggregate(F.array_repeat(F.lit(0), F.length(word) - 1), parts, lambda done, _: self._merge(done))
        return F.transform(merged, self.rank)

    def decoded(self, ids: Column) -> Column:
        """The bytes of some ids: their pieces, one after the other."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(self._pieces, i + 1)), ""), "ISO-8859-1")


def heap_merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges for a word that the dictionary lacks: pairs wait in a heap by rank and place; neighbours are linked."""
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j >= n or rank.get(part[i] + part[j]) != r:
            continue
        part[i], part[j] = part[i] + part[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := rank.get(part[before[i]] + part[i])) is not None:
            heapq.heappush(heap, (r, before[i]))
    return [rank[p] for p in part if p]


def count_words(texts: DataFrame, pattern: str) -> DataFrame:
    """(word, n) of all words that the fold takes, counted in batches first."""

    def counted(seen: Counter) -> pa.RecordBatch:
        short = [(w, n) for w, n in seen.items() if len(w) <= FOLD_BYTES and len(w.encode()) <= FOLD_BYTES]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(split(text or ""))
                if len(seen) > BATCH_WORDS:
                    yield counted(seen)
                    seen = Counter()
            yield counted(seen)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, ranks: Ranks, pattern: str, words: int = WORDS) -> pa.Table:
    """(word, ids) of at most ``words`` distinct words, the most frequent ones, folded in Spark."""
    counts = stored(count_words(texts, pattern), "bpe-words")
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > words:
            break
        least = r["step"]
    frequent = counts.filter(step >= least) if least is not None else counts.limit(0)
    return frequent.select("word", ranks.fold(latin(F.col("word"))).alias("ids")).toArrow()


def encode(docs: DataFrame, ranks: Ranks, pattern: str = public_tokenizers.PATTERN, text: str = "text", name: str = "ids", words: int = WORDS) -> DataFrame:
    """Add the ids of the whole text as ``name``: array<int>; missing and empty texts have none.

    A word of any length is encoded whole. Other columns stay as they are.
    """
    spark = docs.sparkSession
    content = F.coalesce(column(docs, text), F.lit(""))
    known_words = dictionary(docs.select(content.alias("text")), ranks, pattern, words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known_words.schema) as out:
        out.write_table(known_words)
    sent = spark.sparkContext.broadcast((sink.getvalue().to_pybytes(), ranks.pieces))
    kept: dict = {}

    @F.arrow_udf("array<int>")
    def look_up(texts: pa.Array) -> pa.Array:
        if not kept:
            packed, pieces = sent.value
            known = pa.ipc.open_stream(packed).read_all()
            ids = known.column("ids").combine_chunks()
            raw = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            ends = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
            kept["of"] = {w: raw[4 * a : 4 * b] for w, a, b in zip(known.column("word").to_pylist(), ends, ends[1:])}
            kept["rank"] = {p: r for r, p in enumerate(pieces)}
            kept["split"] = splitter(pattern)
        of, rank, split = kept["of"], kept["rank"], kept["split"]
        out = []
        for text in texts.to_pylist():
            found = split(text or "")
            codes = list(map(of.get, found))
            if None in codes:
                codes = [np.array(heap_merge(w.encode(), rank), np.int32).tobytes() if c is None else c for w, c in zip(found, codes)]
            out.append(b"".join(codes))
        ends = np.concatenate(([0], np.cumsum([len(o) // 4 for o in out]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), np.int32)))

    return docs.withColumn(name, look_up(content))


def digests(docs: DataFrame, ranks: Ranks, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Number and SHA-256 of the ids, and the SHA-256 of the bytes that they decode to."""
    return docs.select(
        column(docs, doc_id), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(ranks.decoded(F.col(ids)), 256).alias("decoded_sha256"),
    )


def encoded_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode the texts of documents by a rank file and decode the ids again: one row of digests for each."""
    ranks = Ranks(load_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    return digests(encode(docs.select("doc_id", "text"), ranks), ranks)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text."""
    return encoded_digests(table(spark, sf_dir, "documents"))
