"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

A document's grade counts what it has to its credit: 0 (poor and toxic), 1 (one of both), 2 (neither).
P(grade >= k) = logistic(s - t_k): one score ``s`` of shared weights over hashed text features, and
ordered thresholds t_1 < t_2. The model gives the expected grade and the tail probability that selects.

Features are present or absent: the hashed words of the whole text, its hashed runs of signs, and its
shares of capitals, signs, digits and repeated words in logarithmic steps. Features whose mean grade does not
differ from the overall one by ``Z_LEAST`` standard errors are left out, so long texts of unknown words
carry no noise. The model is fitted on a bounded sample of rated documents (``TRAIN_ROWS``, by a hash
of the id) with at most ``MOST_FEATURES`` features; every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, mixed, pieces, powers, prefix_sums, table, utf8

TRAIN_ROWS = 20_000
MOST_FEATURES = 4_096
Z_LEAST = 4.0
LEAST_DOCS = 5
RIDGE = 1e-3
BITS = 20
GRADES = 3
#: Select documents whose probability of the top grade is at least this.
TAIL = 0.5
#: Bytes of text that are taken apart at once; arrays of about 70 bytes for each are alive meanwhile.
CHUNK = 1 << 18

#: 0: white space and control characters, 1: letters and all of Unicode beyond ASCII, 2: digits, 3: signs.
_KIND = np.array([1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 0 if c <= 32 or c == 127 else 3 for c in range(256)], np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats, sorted by text."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    change = change[kind[change] != 0]
    after = np.flatnonzero(np.diff(kind, append=0) != 0)
    after = after[kind[after] != 0] + 1
    sums = prefix_sums(_LOWER[data])
    _, down = powers(len(data))
    hashes = mixed((sums[after] - sums[change]) * down[change])
    doc = owner[change]
    is_word = kind[change] == 1
    found = [(doc << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64)]

    n = len(texts)
    words = hashes[is_word]
    word_doc = doc[is_word]
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    count = lambda where, of: np.bincount(of[where], minlength=n)
    capital = (data >= 65) & (data <= 90)
    size = np.maximum(lengths - 1, 1)
    shares = [count(capital, owner) / size, count(kind == 3, owner) / size, count(kind == 2, owner) / size, count(again, word_doc) / np.maximum(np.bincount(word_doc, minlength=n), 1)]
    for k, share in enumerate(shares):
        step = np.clip(np.ceil(2 * np.log2(np.maximum(share, 1e-9))) + 16, 0, 16).astype(np.uint64)
        mark = mixed(step + np.uint64(1000 * (k + 1))) >> np.uint64(64 - BITS)
        found.append((np.arange(n) << BITS) | mark.astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class OrdinalModel:
    """Weights of the kept features, ordered thresholds."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.kept, self.weights, self.thresholds = kept, weights, thresholds
        self._of = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self._of is None:
            self._of = np.zeros(1 << BITS)
            self._of[self.kept] = self.weights
        out = np.zeros(len(texts))
        for a, b in pieces(texts, CHUNK):
            doc, feature = features(texts[a:b])
            out[a:b] = np.bincount(doc, weights=self._of[feature], minlength=b - a)
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, width: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative link by accelerated gradient steps (Adam) on the mean log loss with a ridge.

    The second threshold is the first plus the exponential of a free number, which keeps them in order.
    """
    n = max(len(grade), 1)
    w, free = np.zeros(width), np.array([-1.0, 0.0])
    m, v = np.zeros(width + 2), np.zeros(width + 2)
    for step in range(1, rounds + 1):
        s = np.bincount(doc, weights=w[feature], minlength=len(grade))
        cuts = np.array([free[0], free[0] + np.exp(free[1])])
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        upper = np.concatenate((np.ones((len(grade), 1)), p), 1)  # P(>= grade)
        lower = np.concatenate((p, np.zeros((len(grade), 1))), 1)  # P(> grade)
        row = np.arange(len(grade))
        hi, lo = upper[row, grade], lower[row, grade]
        chance = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        ds = (d_hi - d_lo) / n
        dcut = np.zeros(2)
        for k in (0, 1):
            dcut[k] = (-(d_hi * (grade == k + 1)) + d_lo * (grade == k)).sum() / n
        gradient = np.concatenate((np.bincount(feature, weights=ds[doc], minlength=width) - RIDGE * w, [dcut[0] + dcut[1], dcut[1] * np.exp(free[1])]))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, free = w + move[:-2], free + move[-2:]
    return w, np.array([free[0], free[0] + np.exp(free[1])])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on a sample of rated documents; ratings with a missing part are passed over.

    Without rated documents the model knows only that every text is of the top grade.
    """
    rated = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    share = min(1.0, train_rows / max(rated.count(), 1))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    grade = F.greatest(F.least(F.col("quality"), F.lit(1)), F.lit(0)) + F.when(F.col("toxic") == 0, 1).otherwise(0)
    sample = rated.filter(dice < share).select("doc_id", grade.cast("int").alias("grade"))
    # About train_rows rows of 12 bytes: a fixed bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "grade")

    def pairs_of(batch: pa.RecordBatch):
        texts, grades = utf8(batch.column(0)), batch.column(1).to_numpy()
        for a, b in pieces(texts, CHUNK):
            doc, feature = features(texts[a:b])
            yield doc, feature, grades[a:b]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, rated_here, grade_sum, squares = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), 0, 0, 0
        for batch in batches:
            for doc, feature, grades in pairs_of(batch):
                np.add.at(n, feature, 1)
                np.add.at(total, feature, grades[doc])
                rated_here, grade_sum, squares = rated_here + len(grades), grade_sum + int(grades.sum()), squares + int((grades.astype(np.int64) ** 2).sum())
        at = np.flatnonzero(n)
        if rated_here:
            yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1), "n": np.append(n[at], rated_here).astype(np.int64), "total": np.append(total[at], grade_sum).astype(np.int64), "squares": np.append(0 * at, squares)})

    tallied = rows.mapInArrow(tally, "feature long, n long, total long, squares long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    whole = tallied.filter("feature = -1").collect()
    if not whole:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([-20.0, -10.0]))
    n, mean = whole[0]["n"], whole[0]["total"] / whole[0]["n"]
    spread = max(whole[0]["squares"] / n - mean**2, 1e-6) ** 0.5
    z = F.abs(F.col("total") / F.col("n") - F.lit(mean)) * F.sqrt("n") / F.lit(spread)
    screened = tallied.filter((F.col("feature") >= 0) & (F.col("n") >= LEAST_DOCS) & (z >= Z_LEAST)).orderBy(z.desc(), "feature").limit(MOST_FEATURES)
    kept = np.array(sorted(r["feature"] for r in screened.select("feature").collect()), np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, feature, grades in pairs_of(batch):
                at = np.searchsorted(kept, feature)
                hit = (at < len(kept)) & (kept[np.minimum(at, max(len(kept) - 1, 0))] == feature) if len(kept) else np.zeros(len(feature), bool)
                rows = np.split(at[hit].astype(np.int32), np.searchsorted(doc[hit], np.arange(1, len(grades))))
                yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], ["grade", "at"])

    # As arrays, not as Python's numbers: the same rows in a tenth of the driver's memory.
    data = rows.mapInArrow(project, "grade int, at array<int>").toArrow()
    grades = data.column("grade").to_numpy().astype(np.int64)
    at = data.column("at").combine_chunks()
    doc = np.repeat(np.arange(len(data)), pc.list_value_length(at).to_numpy())
    feature = at.flatten().to_numpy().astype(np.int64)
    weights, thresholds = fit_ordinal(doc, feature, grades, len(kept))
    return OrdinalModel(kept, weights, thresholds)


def rate(docs: DataFrame, model: OrdinalModel, text: str = "text", name: str = "rating") -> DataFrame:
    """Add a struct of ``expected_grade``, ``p_grade_1`` and ``p_grade_2`` (or more).

    Missing and empty texts are rated by the features that any empty text has, without a crash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kept: dict = {}

    @F.arrow_udf("struct<expected_grade:double,p_grade_1:double,p_grade_2:double>")
    def rating(texts: pa.Array) -> pa.Array:
        if "model" not in kept:
            kept["model"] = pickle.loads(sent.value)
        tails = kept["model"].tails(kept["model"].scores(utf8(texts)))
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], ["expected_grade", "p_grade_1", "p_grade_2"])

    return docs.withColumn(name, rating(column(docs, text)))


def select_documents(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """Keep the documents, with their columns, whose probability of the top grade is at least ``tail``."""
    model = train(docs, labels)
    return rate(docs, model, name="__rating").filter(F.col("__rating.p_grade_2") >= tail).drop("__rating")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rated = rate(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", "rating.expected_grade", "rating.p_grade_1", "rating.p_grade_2", (F.col("rating.p_grade_2") >= TAIL).alias("kept"))
