"""Operators of the training-data pipeline against brute force, round trips and planted cases."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from worktally.llm import bpe, langid, mixing, quality, repeats, shards, simhash, topk, url_rules, vector_copies
from worktally.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with missing values, empty and long texts, ties, repeated rows, and columns that clash."""
    rng = random.Random(5)
    long_ = prose(rng, 4000)
    rows = [(None, None, None, None, "x"), (1, "", "en", "a", None), (2, " \t\n", None, None, "q"), (3, long_, "en", "b", "z"), (3, long_, "en", "b", "z"), (4, "x" * 5000, "de", "b", "y"), (5, long_[:900] + " étoile 🙂 " + long_[2000:2900], "en", "", "w"), (None, "one two three four", "fr", "a", "v"), (6, "one two three four", "fr", "a", "v")]
    rows += [(10 + i, prose(rng, 80), ("en", "fr")[i % 2], "abc"[i % 3], "u") for i in range(12)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, size string, count int, `a.b` int, spans int")


def empty(df):
    return df.limit(0)


# ---- 1 top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (300, 7)).round(2).astype(np.float32)
    x[50:90] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, []), (1100, [float("nan")] * 7), (1150, [None] * 7), (1200, [float("inf")] * 7), (1250, [1.0, 2.0]), (None, [0.5] * 7), (7, [0.25] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v)]
    for i, a in q:
        if i % 50 == 0:
            want = sorted(((-int(a @ b), j) for j, b in q if j != i and len(b) == len(a)))[:5]
            assert got[i] == [(j, -s) for s, j in want], i
    assert set(got) <= {i for i, _ in q if i % 50 == 0}
    assert topk.top_k(empty(df), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_any_size_take_part(spark):
    rng = np.random.default_rng(13)
    rows = [(i, (rng.normal(0, 1, 3) * 10.0 ** (i % 7)).tolist()) for i in range(120)] + [(150, [4e4, 0.0, 0.0]), (200, [1e30, 0.0, 0.0]), (201, [0.0, 1e-3, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"dims": F.lit("clash"), "value": F.lit(0)})
    near = df.filter("vec_id <> 200")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for r in topk.top_k(near, F.col("vec_id") % 50 == 0).groupBy("query_id").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("all")).collect():
        want = sorted((-sum(a * b for a, b in zip(q[r["query_id"]], w)), j) for j, w in q.items() if j not in (200, r["query_id"]))[:5]
        assert [(x["vec_id"], x["score"]) for x in sorted(r["all"])] == [(j, -s) for s, j in want]
    small = df.filter("vec_id in (200, 201)")  # far beyond 64 bits, but the score is not
    assert [tuple(r) for r in topk.top_k(small, F.col("vec_id") % 50 == 0).collect()] == [(200, 1, 201, 0)]


def test_queries_meet_rows_in_tiles_and_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (200, 5)) / 256.0  # many ties
    ids = [i % 180 for i in range(200)]  # 0 to 19 come twice
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(500 + i, [float(i % 7), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    want = collections.Counter()
    for i, a in whole:
        if i % 5 == 0:
            near = sorted((-sum(p * q for p, q in zip(a, b)), j) for j, b in whole if j != i and len(a) == len(b))[:3]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(near))
    for sizes in ((4, 48, 32), (3, 2, 1), (1, 1, 1)):  # blocks of rows and of queries in a tile, strips at least
        for name, value in zip(("BLOCKS_PER_TILE", "QUERY_BLOCKS_PER_TILE", "LEAST_STRIPS"), sizes):
            monkeypatch.setattr(topk, name, value, raising=False)
        best = topk.top_k(df, F.col("vec_id") % 5 == 0, k=3)
        assert collections.Counter(tuple(r) for r in best.select("query_id", "rank", "vec_id", "score").collect()) == want
        # A copy of the queries for each block of rows once came to the driver where the queries themselves looked small.
        assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()


def test_bit_slices_add_up():
    rng = np.random.default_rng(1)
    values, query = rng.integers(-300, 300, (130, 9)), rng.integers(-300, 300, 9)
    slices, least = topk.slices_of(values)
    (found, score), = topk.search_block(np.arange(130), slices, least, np.array([-1]), query[None], 200)
    assert sorted(found.tolist()) == list(range(130))
    assert (score == values[found] @ query).all()


# ---- 2 shards


def test_shards(spark, odd):
    rows = shards.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shards.shard_documents(empty(odd)).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shards.shard_documents(docs).toPandas().merge(docs.select("doc_id", "text").toPandas())
    assert (rows.groupby("text").shard.nunique() == 1).all()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() <= max(1.02 * sizes.mean(), rows["size"].max())


def test_hot_group_is_cut(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id") + 10000)).alias("text"))
    sizes = [r["b"] for r in shards.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * min(sizes)


def test_best_fit_is_tight():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 60) for _ in range(500)), reverse=True)
    bins, n = shards.best_fit_decreasing(sizes, 100)
    left = [100] * n
    for size, b in zip(sizes, bins):
        left[b] -= size
        assert left[b] >= 0
    plain, where = [], []
    for size in sizes:  # by search through all bins
        fit = min((r, i) for i, r in enumerate(plain) if r >= size) if any(r >= size for r in plain) else None
        if fit is None:
            plain.append(100 - size)
            where.append(len(plain) - 1)
        else:
            plain[fit[1]] -= size
            where.append(fit[1])
    assert where == bins


# ---- 3 URL rules


def test_url_rules_by_trie_and_by_join(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "http://example.org/es", "http://example.org/en/103", "http://x.example.org/en/2", "http://org", "http://badorg/x", "https://a.b.com/de/?x", "x://com/fr/://y", "http://e.com#/de/", "http://com/d", "http://é.com/de/ü", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    trie = url_rules.judge_urls(pages, url_rules.QUERY_RULES).orderBy("page_id").collect()
    joined = url_rules.judge_urls(pages, url_rules.QUERY_RULES, broadcast_rules=0).select(*trie[0].asDict()).orderBy("page_id").collect()
    assert trie == joined
    for r in trie:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[2].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), m[3]) if m else ("", "")
        fit = max(((h.count("."), len(p), h + p, v) for v, h, p in url_rules.QUERY_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, fit[2], fit[3])
    assert url_rules.judge_urls(empty(pages), []).count() == 0


# ---- 4 language


def test_langid_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op4_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_langid_odd_rows(spark, odd):
    filters = langid.train(odd, F.lit(True))
    rows = {r["text"]: r for r in langid.predict(odd, filters).collect()}
    assert rows[None]["lang_pred"] == rows[""]["lang_pred"] == "und" and rows[""]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    none = langid.train(empty(odd), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


# ---- 5 BPE


def test_bpe_equals_the_library(spark, odd):
    pieces = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    rng = random.Random(3)
    texts = ["", None, "don't we'll  \n\n end  ", "a\x85b \xa0\xa0c\x1c \u3000x", "日本語 テキスト", "🙂é" * 90, "z" * 129 + " " + "ab" * 900]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x1F000, 0x1FA00)])) for _ in range(300)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ranks = bpe.Ranks(pieces)
    for words in (bpe.WORDS, 3):
        for r in bpe.encode(docs, ranks, words=words).withColumn("back", ranks.decoded(F.col("ids"))).collect():
            assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
            assert bytes(r["back"]) == (r["text"] or "").encode()
    assert bpe.encoded_digests(odd).count() == odd.count()
    assert bpe.encoded_digests(empty(odd)).count() == 0


# ---- 6 mixing


def test_mixing_meets_targets(spark, odd):
    rows = mixing.op6_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), top=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.top / 2 + 1).all()
    assert (by.target <= 3 * by["size"] + 1e-6).all() and (rows.taken <= 3 * rows["size"]).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-3
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixing.mixed_documents(empty(odd)).count() == 0
    sized, plan = mixing.mix(odd)
    taken = mixing.of_source(sized, plan).select((F.col("size") * mixing.copies(F.col("doc_id"), F.col("size"), "mix")).alias("t")).agg(F.sum("t")).first()[0]
    assert taken == mixed.select(mixing.words(F.col("text")).alias("w")).agg(F.sum("w")).first()[0]


def greedy(docs, targets):
    """Words taken of (doc_id, size) in one source, by a plain walk through the ranking."""
    total = sum(s for _, s in docs)
    whole = int(targets // total) if total else 0
    gap = budget = targets - whole * total
    fit = [s for _, s in docs if 0 < s <= budget]
    factor = math.inf
    for s in sorted(set(fit), reverse=True):
        c = (budget - sum(x for x in fit if x > s)) / sum(x * x for x in fit if x <= s)
        if c * s < 1:
            factor = c
            break
    ranks = []
    for i, s in docs:
        u = (int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if s:
            ranks.append((u - 1 if factor * s >= 1 else u / (1 - u) / (factor * s / (1 - factor * s)), str(i), s, i))
    taken = set()
    for rank, _, s, i in sorted(ranks):
        if s <= gap:
            gap -= s
            taken.add((i, s))
    left = sorted((abs(s - gap), str(i), s, i) for _, _, s, i in ranks if (i, s) not in taken)
    if left and left[0][0] < gap:
        taken.add((left[0][3], left[0][2]))
    return {(i, s): s * (whole + ((i, s) in taken)) for i, s in docs}


@pytest.mark.parametrize("each", [7, mixing.DOCS_PER_RANGE])
def test_mixing_against_a_plain_walk(spark, monkeypatch, each):
    monkeypatch.setattr(mixing, "DOCS_PER_RANGE", each)
    rng = random.Random(21)
    sizes = {"a": [200] * 500 + [200_000], "b": [rng.randint(1, 900) for _ in range(300)] + [0, 0], "c": [rng.choice([3, 50, 70_000]) for _ in range(60)], None: [40_000, 90_000, 1, 2, 2]}
    docs = [(k, src, n) for k, (src, n) in enumerate((src, n) for src, all_ in sizes.items() for n in all_)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, size long")
    plan = mixing.mixing_plan(sized, "mix")
    rows = mixing.of_source(sized, plan).withColumn("times", mixing.copies(F.col("doc_id"), F.col("size"), "mix")).toPandas()
    for src, all_ in sizes.items():
        own = rows[rows.source.isna() if src is None else rows.source == src]
        target = own.target.iloc[0]
        want = greedy([(i, n) for i, s, n in docs if s == src], target)
        assert {(i, n): n * t for i, n, t in zip(own.doc_id, own["size"], own.times)} == want
        whole = own.times.min()
        left = own["size"][(own.times == whole) & (own["size"] > 0)]
        assert abs(sum(want.values()) - target) <= max(0.01 * target, left.min() / 2 if len(left) else 0)
        assert (own.times <= 3).all()


# ---- 7 SimHash


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd):
    rng = random.Random(4)
    base = prose(rng, 300)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, base.replace(rng.choice(WORDS), "swap", 1)) for i in range(40)], "doc_id long, text string"))
    rows = simhash.simhash_groups(docs).collect()
    texts = collections.Counter((r["doc_id"], f"{fingerprint(r['text']):016x}") for r in docs.collect())
    assert texts == collections.Counter((r["doc_id"], r["fingerprint"]) for r in rows)
    marks = sorted({int(r["fingerprint"], 16) for r in rows})
    least = {m: min((r["doc_id"] for r in rows if int(r["fingerprint"], 16) == m and r["doc_id"] is not None), default=None) for m in marks}
    seen = {m: m for m in marks}
    for _ in marks:
        for a in marks:
            seen[a] = min(seen[b] for b in marks if bin(a ^ b).count("1") <= 3)
    for r in rows:
        mine = seen[int(r["fingerprint"], 16)]
        assert r["component_id"] == min((least[m] for m in marks if seen[m] == mine and least[m] is not None), default=None)
    assert simhash.simhash_groups(empty(odd)).count() == 0


def test_blocks_of_a_crowded_key_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    marks = np.unique([base[i % 5] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))) for i in range(400)])
    df = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "print long")
    small = {(r["node"], r["root"]) for r in components(simhash.near_links(df, block=8)).collect()}
    large = {(r["node"], r["root"]) for r in components(simhash.near_links(df)).collect()}
    assert small == large and len(small) > 200


def test_one_document_of_each_group_stays(spark, odd):
    kept = simhash.without_near_copies(odd)
    assert kept.columns == odd.columns
    prints = [fingerprint(r["text"]) for r in kept.collect()]
    assert len(set(prints)) == len(prints) and {fingerprint(r["text"]) for r in odd.collect()} >= set(prints)


def test_no_text_is_lost_where_ids_repeat(spark):
    rng = random.Random(22)
    a, b, c = (prose(rng, 200) for _ in range(3))
    near_c = c.replace(c.split()[50], "edited", 1)
    rows = [(1, a), (1, b), (2, b), (None, c), (None, near_c), (None, c), (3, a.upper()), (None, None), (None, ""), (5, prose(rng, 90)), (5, prose(rng, 90)), (6, a), (6, a)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, print int")
    kept = [tuple(r) for r in simhash.without_near_copies(docs).collect()]
    marks = [int(f"{fingerprint(t):x}", 16) for _, t in rows]
    root = {m: min(x for x in marks if (m ^ x).bit_count() <= 3) for m in marks}
    assert sorted(root[fingerprint(r[1])] for r in kept) == sorted(set(root.values()))
    assert (1, a, 0) in kept and (1, b, 0) in kept and sum(r[0] == 5 for r in kept) == 2
    copies = simhash.without_near_copies(spark.createDataFrame([(7, a, 0)] * 3, docs.schema))
    assert [tuple(r) for r in copies.collect()] == [(7, a, 0)]


# ---- 8 repeats


def test_repeats_in_very_long_texts(spark):
    rng = np.random.default_rng(23)
    passage = bytes(rng.integers(97, 123, 1_000, np.uint8)).decode()
    long_ = bytes(rng.integers(97, 123, 20_000_000, np.uint8)).decode()
    places = [0, repeats.CHUNK - 500, 7_777_777, len(long_) - 1_000]
    for p in places:
        long_ = long_[:p] + passage + long_[p + 1_000 :]
    for k, p in enumerate(places):  # what stands beside the passages differs
        long_ = long_[: p - 1] + "ABCD"[k] + long_[p:] if p else long_
        long_ = long_[: p + 1_000] + "EFGH"[k] + long_[p + 1_001 :] if p + 1_000 < len(long_) else long_
    docs = spark.createDataFrame([(1, long_), (2, "short " + passage[100:400])], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.with_repeats(docs).drop("text").collect()}
    assert got == {1: [(p, p + 1_000) for p in places], 2: [(6, 306)]}


def test_pieces_of_a_text_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats, "TEXTS", 3)
    rng = random.Random(24)
    base = prose(rng, 900)
    texts = [base, base[300:2500] + prose(rng, 40) + base[:900], prose(rng, 300) + base[2000:2260], "ab" * 2500, "", None, base[1:3000], "é" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(repeats.with_repeats(docs).collect(), key=lambda r: r["doc_id"])
    for r, (raw, mark) in zip(rows, covered(texts, 200)):
        got = bytearray(len(raw))
        for s in r["spans"]:
            got[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert got == mark


def covered(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    for r in raws:
        mark = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        yield r, mark


@pytest.mark.parametrize("length,gram,group", [(200, 40, 16_384), (40, 12, 2), (40, 12, 16_384)])
def test_repeats_against_brute_force(spark, odd, length, gram, group):
    rng = random.Random(7)
    passage = prose(rng, 45)
    extra = [(200 + i, prose(rng, 30) + passage[i : 260 + 3 * i] + prose(rng, 30)) for i in range(30)] + [(300, "ab" * 400), (301, "é" * 300 + passage)]
    docs = odd.select("doc_id", "text", "count", "`a.b`", F.col("spans").alias("old")).unionByName(spark.createDataFrame([(i, t, 0, 0, 0) for i, t in extra], "doc_id long, text string, count int, `a.b` int, old int"))
    rows = repeats.with_repeats(docs, length, gram, group).collect()
    assert len(rows) == docs.count()
    for r, (raw, mark) in zip(rows, covered([r["text"] for r in rows], length)):
        got = bytearray(len(raw))
        for s in r["spans"]:
            got[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert got == mark
        assert len(r["spans"]) == len(re.findall(b"\1+", bytes(mark)))


@pytest.mark.parametrize("group", [2, 16_384])
def test_parts_of_a_text_with_many_copies_are_found(spark, group):
    rng = random.Random(17)
    hot, other = prose(rng, 300), prose(rng, 300)
    texts = [hot] * 20 + [other] * 20 + [hot[:at] + " edited here " + hot[at + 5 :] for at in (300, 700, 1100)]
    texts += [prose(rng, 20) + hot[at : at + size] + prose(rng, 20) for at, size in ((100, 200), (400, 215), (900, 260))]
    texts += [other[500:720] + hot[600:810], prose(rng, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(repeats.with_repeats(docs, group=group).collect())
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, (raw, mark) in zip(rows, covered(texts, 200)):
        got = bytearray(len(raw))
        for s in r["spans"]:
            got[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert got == mark


def test_cutting_keeps_rows_and_columns(spark, odd):
    cut = repeats.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert repeats.without_repeats(empty(odd)).count() == 0


def test_maximal_repeats_have_all_occurrences():
    contexts = [(b"xxABCDEFyy", 4), (b"zzABCDEFyy", 4), (b"qqABCDEFww", 4), (b"nothing at all", 3)]
    found = {(a, b, tuple(sorted(m.tolist()))) for a, b, m in repeats.maximal_repeats(contexts, 6)}
    assert found == {(2, 4, (0, 1, 2)), (2, 6, (0, 1))}


# ---- 9 vectors


def test_vector_groups_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[rng.integers(0, 60, 300)] + rng.normal(0, 0.08, (300, 16))
    x[400:500] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, 0.0]), (2004, [2.0, 0.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_copies.vector_groups(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    true = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(900)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (2000, 2001, 2002))
    assert got[2003]["component_id"] == got[2004]["component_id"] == 2003
    assert vector_copies.vector_groups(empty(df)).count() == 0


@pytest.mark.parametrize("fit_rows", [2_000, 20_000])
def test_rare_links_are_found(spark, monkeypatch, fit_rows):
    monkeypatch.setattr(vector_copies, "ROWS_PER_CELL", 16)
    monkeypatch.setattr(vector_copies, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(vector_copies, "FIT_QUERIES", 100)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rng.normal(size=(60, 32))
    turn -= (turn * x[:60]).sum(1)[:, None] * x[:60]
    x[60:120] = 0.91 * x[:60] + np.sqrt(1 - 0.91**2) * turn / np.linalg.norm(turn, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = vector_copies.vector_groups(df).agg(F.sum("n_links")).first()[0]
    true = ((x @ x.T >= 0.9).sum(1) - 1).sum()
    assert 0.9 * true <= got <= true


def test_queries_are_no_partners_of_their_own(spark):
    rng = np.random.default_rng(12)
    u = rng.normal(size=(300, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    entries = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(u)], "node long, unit binary")
    grid = vector_copies.Grid(u.copy(), 4)
    ranks = vector_copies._ranks_of_partners(entries, grid, np.arange(40), u[:40], 16, 0.9)
    assert ranks["pairs"].sum() == ((u[:40] @ u.T >= 0.9).sum(1) - 1).sum()


# ---- 10 quality


def test_quality_separates_planted_grades(spark, odd):
    rng = random.Random(9)
    texts = [prose(rng, 60) + (" vile" * 2 + " rotten" if i % 5 == 1 else "") if i % 5 != 2 else prose(rng, 60).upper().replace(" ", "!! ") for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 2), int(i % 5 == 1)) for i in range(0, 600, 2)] + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.select_documents(docs, labels).collect()}
    clean = {i for i in range(600) if i % 5 not in (1, 2)}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 0.02 * 600
    model = quality.train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    assert quality.rate(odd, model).count() == odd.count()
    assert quality.select_documents(empty(odd), labels.limit(0)).count() == 0
    assert quality.select_documents(odd, labels.limit(0)).count() == odd.count()


# ---- pipeline


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    before = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["n_tokens"] >= 0 for r in out)
    digest = hashlib.sha256(b"").hexdigest()
    assert all((r["n_tokens"] == 0) == (r["ids_sha256"] == digest) for r in out)
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
