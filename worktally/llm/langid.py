"""Language identification with a bit-sliced Bloom filter of byte n-grams.

Each language has a Bloom filter of the 4-byte grams common in its training texts. The filters lie
side by side: a cell of the table is a bit mask over languages, so the AND of the cells that a gram
hashes to names all languages that contain it. A text is decided by per-language popcounts of its
grams, each corrected for the share of grams that its filter would accept by chance.

Training reads a bounded sample of documents of each language (``TRAIN_DOCS``, chosen by a hash of
the id); prediction reads every whole text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, pieces, table, utf8

#: Documents of each language to learn from, about; no limit on texts to be judged.
TRAIN_DOCS = 3_000
#: A gram belongs to a language if this share of its training documents has it, and at least two of them.
MIN_SHARE = 0.002
CELLS_LOG2 = 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
CHUNK = 2_000_000

_FOLD = bytes(c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in range(256))
_GAP = b" \0\0\0 "


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams of some texts and the text that each belongs to.

    Letters A-Z and those of Latin-1 are lower-cased, all other ASCII characters are blanks, runs of
    blanks are one; every text has a blank at both ends.
    """
    data = np.frombuffer(b" " + _GAP.join(t.translate(_FOLD) for t in texts) + _GAP, np.uint8).copy()
    lengths = np.array([len(t) + len(_GAP) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate((owner[:1], owner))[: len(data)]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data, owner = data[keep].astype(np.uint32), owner[keep]
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    inside = (data[:-3] != 0) & (data[1:-2] != 0)
    return code[inside], owner[:-3][inside]


def cells_of(code: np.ndarray) -> list[np.ndarray]:
    return [(code * np.uint32(m)) >> np.uint32(32 - CELLS_LOG2) for m in MULTIPLIERS]


class Filters:
    """Languages, the table of masks (one plane for each 64 languages) and the chance of a false hit."""

    def __init__(self, members: dict[str, np.ndarray], most_common: str | None):
        self.langs = sorted(members)
        self.default = most_common
        planes = max(1, -(-len(self.langs) // 64))
        self.table = np.zeros((planes, 1 << CELLS_LOG2), np.uint8 if len(self.langs) <= 8 else np.uint64)
        self.chance = np.zeros(len(self.langs))
        for k, lang in enumerate(self.langs):
            plane, bit = self.table[k // 64], self.table.dtype.type(1 << (k % 64))
            for cells in cells_of(members[lang]):
                plane[cells] |= bit
            self.chance[k] = np.mean((plane & bit) != 0) ** len(MULTIPLIERS)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its corrected share of each text's grams; no gram: -1 and 0."""
        n, width = len(texts), len(self.langs)
        hits, total = np.zeros((n, width)), np.zeros(n)
        for a, b in pieces(texts, CHUNK):
            code, owner = grams(texts[a:b])
            total[a:b] = np.bincount(owner, minlength=b - a)
            cells = cells_of(code)
            for p, plane in enumerate(self.table):
                mask = plane[cells[0]] & plane[cells[1]] & plane[cells[2]]
                for k in range(64 * p, min(width, 64 * p + 64)):
                    has = (mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1)
                    hits[a:b, k] = np.bincount(owner, weights=has, minlength=b - a)
        if not width:
            return np.full(n, -1), np.zeros(n)
        share = (hits / np.maximum(total, 1)[:, None] - self.chance) / np.maximum(1 - self.chance, 1e-9)
        share = np.clip(share, 0, 1)
        best = share.argmax(1)
        score = share[np.arange(n), best]
        return np.where(score > 0, best, -1), score


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Filters:
    """Learn filters from the rows where ``learn`` holds and a language is given; there may be none."""
    rows = docs.filter(learn).select(column(docs, doc_id).alias("id"), column(docs, text).alias("text"), column(docs, lang).alias("lang"))
    rows = rows.filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Filters({}, None)
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, train_docs / v))])
    dice = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(dice < F.element_at(share, F.col("lang"))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = utf8(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for name in set(langs):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                for a, b in pieces(own, CHUNK):
                    code, owner = grams(own[a:b])
                    once = np.unique(code.astype(np.uint64) | (owner.astype(np.uint64) << np.uint64(32)))
                    gram, docs_with = np.unique(once.astype(np.uint32), return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([name] * len(gram), pa.string()), "gram": gram.astype(np.int64), "docs": docs_with.astype(np.int64)}
                    )
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name], pa.string()), "gram": pa.array([-1], pa.int64()), "docs": pa.array([len(own)], pa.int64())})

    grams_of = sample.mapInArrow(count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    seen = {r["lang"]: r["docs"] for r in grams_of.filter("gram = -1").collect()}
    least = {k: max(min(2, v), math.ceil(MIN_SHARE * v)) for k, v in seen.items()}
    if not least:
        return Filters({}, max(sorted(counts), key=counts.get))
    bar = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v)])
    common: pd.DataFrame = grams_of.filter((F.col("gram") >= 0) & (F.col("docs") >= F.element_at(bar, F.col("lang")))).select("lang", "gram").toPandas()
    members = {k: g["gram"].to_numpy().astype(np.uint32) for k, g in common.groupby("lang")}
    return Filters(members, max(sorted(counts), key=counts.get))


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``.

    Missing texts and texts without a letter are ``und`` with score 0, and so is all when nothing was
    learned. A text whose grams no language contains gets the language with the most training documents,
    score 0. Equal shares go to the language that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(filters))
    kept: dict = {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        if "model" not in kept:
            kept["model"] = pickle.loads(sent.value)
        model: Filters = kept["model"]
        best, score = model.judge(utf8(texts))
        names = [*model.langs, model.default]
        return pa.StructArray.from_arrays([pa.array([names[k] for k in best], pa.string()), pa.array(score)], ["lang", "score"])

    told = F.coalesce(column(docs, text).rlike(r"\p{L}"), F.lit(False))
    judged = docs.withColumns({"__told": told, "__lang": judge(column(docs, text))})
    return judged.withColumns(
        {"lang_pred": F.when(F.col("__told"), F.coalesce("__lang.lang", F.lit("und"))).otherwise("und"), "score": F.when(F.col("__told"), F.col("__lang.score")).otherwise(0.0)}
    ).drop("__told", "__lang")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those whose crc32 of the id is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    filters = train(docs, rest != 1)
    out = predict(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
