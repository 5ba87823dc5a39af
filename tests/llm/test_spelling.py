"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worktally.llm import spelling

SF = "/root/testdata/sf0.001"


def brute_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_forms(counts):
    out = {}
    for w, n in counts.items():
        by = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = (by[0][1], -by[0][0]) if by and -by[0][0] >= 2 * n else (None, None)
        out[w] = [form[0], None, n, len(by), form[1]]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def check(spark, rows, each=spelling.WORDS_PER_RANGE):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "a.b": F.lit(0)})
    got = spelling.spelling_forms(docs, each=each).collect()
    want = brute_forms(brute_counts(rows))
    assert len(got) == len(want)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    return want


def vocabulary(rng):
    letters = "abcéÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 7))) for _ in range(500)}
    words |= {w[:i] + rng.choice(letters) + w[i + rng.choice((0, 1)) :] for w in list(words)[:200] for i in (0, 2, len(w) - 1)}
    return sorted(words)


@pytest.mark.parametrize("each", [20, spelling.WORDS_PER_RANGE])
def test_forms_against_brute_force(spark, each):
    rng = random.Random(1)
    words = vocabulary(rng)
    rows = [(i, " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(words, [1 / (k + 3) for k in range(len(words))], k=60))) for i in range(150)]
    rows += [(None, None), (1, ""), (None, " ".join(words[:50])), (2, "aaaaa aaaaaa " * 9 + "aaaaaaa " * 30), (2, "aaaaa aaaaaa"), (3, "naïve1naïve2naïve÷naïve")]
    want = check(spark, rows, each)
    assert max(v[3] for v in want.values()) > 3 and any(v[1] != v[0] and v[0] for v in want.values())


def test_long_words(spark):
    long_ = "xy" * 6000
    rows = [(i, f"{long_} {long_}z {long_[:4000]}q{long_[4001:]}") for i in range(1, 5)] + [(9, f"{long_} " * 8)]
    want = check(spark, rows)
    assert want[long_][3] == 2


def test_words_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["word"]: r["n"] for r in spelling.op11_spelling(spark, SF).collect()}
    assert got == brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_forms(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_forms(docs).count() == 0
    assert spelling.spelling_forms(spark.createDataFrame([(1, "lonely")] * 3, docs.schema)).collect()[0]["n_near"] == 0


def test_numbers_of_nodes_that_cross_ranges():
    words = sorted({a + b + c for a in ("ab", "abc", "b") for b in ("", "x", "xy") for c in ("", "p", "q")})
    for size in (1, 2, 5, 100):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        bounds = spelling.Boundaries([(k, p[0], p[-1]) for k, p in enumerate(parts)])
        number = {}
        for k, part in enumerate(parts):
            path, counter, key = [], k << 40, ""
            for w in part:
                shared = spelling.common(key, w) if path else -1
                path, counter = spelling.way(w, path[: shared + 1], counter, bounds.left.get(k, ("", [])), bounds.right.get(k, ("", [])))
                key = w
                for depth, node in enumerate(path):
                    assert number.setdefault(w[:depth], node) == node
        assert len(set(number.values())) == len(number)
