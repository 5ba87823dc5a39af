"""Secret scans against patterns and models written out in Python."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worktally.llm import secrets

KEYS = string.ascii_letters + string.digits
NAMES = "get set user name list index value total count order date path file table cache token_count node tree".split()


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), m[1]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute(texts):
    base = [base_spans(t) for t in texts]
    runs = [[(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", t) if len(m[0]) >= 12 and re.search("[A-Za-z]", m[0]) and all(b[0] >= m.end() or b[2] <= m.start() for b in own)] for t, own in zip(texts, base)]
    counts = {kind: Counter(p for v in {s[3] for own in spans for s in own} for p in zip(v, v[1:]) if set(p) <= set(secrets.ALPHABET)) for kind, spans in ((True, base), (False, runs))}
    size = len(secrets.ALPHABET)
    totals = {kind: Counter() for kind in counts}
    for kind, c in counts.items():
        for (a, _), n in c.items():
            totals[kind][a] += n

    def ratio(a, b):
        p = {kind: (max(c[a, b] - (not kind), 0) + 0.5) / (max(totals[kind][a] - (not kind), 0) + 0.5 * size) for kind, c in counts.items()}
        return round(1000 * (math.log2((p[True] + 1 / size) / 2) - math.log2(p[False])))

    return [sorted(b + [s for s in own if len(s[3]) >= 16 and sum(ratio(*p) for p in zip(s[3], s[3][1:])) >= 20_000]) for b, own in zip(base, runs)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    rand = lambda n, of=KEYS: "".join(rng.choice(of) for _ in range(n))
    out = ["".join(rng.choice(NAMES) + rng.choice([" ", "_", "_", ""]) for _ in range(80)) for _ in range(300)]
    out += [f"é🙂 {' '.join(rng.choices(NAMES, k=4))} PassWord = '{rand(12)}' x {rand(32)} and AKIA{rand(16, string.ascii_uppercase + string.digits)} {rand(40, '0123456789abcdef')}" for _ in range(40)]
    out += ["", " ", "token: abc token=token: abcdef api_key:\"x.y+z=\"", "AKIA" + "A" * 15, "a" * 23, "a" * 24 + "AKIA" + "0" * 16, "4337166598464399", "ſecret=abcdefgh toKen=abcdefgh"]
    out += ["password=" + rand(30) + " " + "\n".join(rng.choice(NAMES) + "_" + rng.choice(NAMES) + "_x" * rng.randint(3, 9) for _ in range(700)), rand(400) + "/" + rand(300), "x" * 9000]
    return out + out[300:303]


def test_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, None, None, None)], "doc_id long, text string, secrets string, `a.b` int")
    got = secrets.with_secrets(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert got[0]["secrets"] == [] and set(got[0].asDict()) == set(docs.columns)
    want = brute(texts)
    for r, spans in zip(got[1:], want):
        assert [(s["start"], s["kind"], s["end"], s["value"]) for s in r["secrets"]] == spans
    caught = sum(s[1] == 3 for own in want[300:340] for s in own)
    assert caught >= 38 and not any(s[1] == 3 for own in want[:300] for s in own)


def test_digests(spark, texts, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r, spans, base in zip(secrets.op13_secrets(spark, str(tmp_path)).orderBy("doc_id").collect(), brute(texts), map(base_spans, texts)):
        names = [",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in own) for own in (spans, base)]
        assert r["spans"] == names[0] and r["base_sha256"] == hashlib.sha256(names[1].encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]


def test_model_from_given_samples(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice(KEYS) for _ in range(20)), True) for _ in range(300)] + [(rng.choice("_ - /".split()).join(rng.choice([str.lower, str.upper, str.title])(n) for n in rng.choices(NAMES, k=3)) + f"_v{rng.randint(1, 2026)}", False) for _ in range(600)]
    model = secrets.train(spark.createDataFrame([*rows, (None, True), ("x", None), ("é", False), ("", True)], "value string, random boolean"))
    docs = spark.createDataFrame([(1, "user_name_list_total " + "aB3xK9qLmZ7pW2vR5tYc"), (2, "user_name_list_total_order USER_NAME_LIST_TOTAL getUserNameList_v2024")], "doc_id long, text string")
    assert [[s["value"] for s in r["secrets"]] for r in secrets.with_secrets(docs, model).orderBy("doc_id").collect()] == [["aB3xK9qLmZ7pW2vR5tYc"], []]


def test_empty_table_and_no_python_worker(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = secrets.with_secrets(docs)
    assert found.count() == 0 and found.columns == ["doc_id", "text", "secrets"]
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
