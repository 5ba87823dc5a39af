"""Exact removal of repeated byte strings with enhanced suffix arrays over sampled suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is found. A window of
that length has one anchor, its gram of ``GRAM`` bytes with the least hash (the first of equal ones), which
its content alone decides. Equal windows have equal anchors, so windows need to be compared only where
anchors are equal, and suffixes need to be sorted only at anchors: about one position in 80.

1. A run is a stretch of windows with the same anchor; its context is all their bytes. Grams that occur
   once have nothing to share. Contexts that occur twice are repeats from end to end.
2. Other contexts of a repeated gram are compared within the gram. An enhanced suffix array is built over
   the suffixes at the anchors: sorted suffixes, common prefix lengths, and their interval tree by a stack scan.
   In each interval the bytes before the anchors are ordered and scanned the same way; intervals of those
   are left-extension classes. A class that is diverse to the right as well is a maximal repeat with all its
   occurrences.
3. A gram with more than ``GROUP`` different contexts would gather in one task. Its windows are told
   apart by a 128-bit hash each instead, counted with partial sums; this is as exact and has no groups.

Texts travel by the hash of their bytes. A text with very many copies (more than 1/4096 of all rows; at
most 4096 of them, so the list is broadcast) is a repeat from end to end and is settled without a join; all
other copies of a text are few. One copy of each such text still answers for its contexts, so that other texts
that share a part of it are found. The text is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.llm.common import column, mixed, pieces, powers, prefix_sums, stored, table, utf8

LENGTH = 200
GRAM = 40
GROUP = 16_384
#: Bytes that one pass over texts takes together, of a longer text a piece of it.
CHUNK = 200_000
#: Texts of a batch that are bytes in Python at a time.
TEXTS = 64
HOT_SHARE = 4_096
#: Contexts or windows that a task holds before it hands them on.
HELD = 10_000


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window, anchor (positions in ``data``), hash of the gram.

    ``ends`` are the ends of the texts that ``data`` strings together.
    """
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    n = len(data) - gram + 1
    if len(data) < length:
        return none, none, none, none, none
    sums = prefix_sums(data)
    hashes = mixed((sums[gram:] - sums[:n]) * powers(n)[1])
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ranked
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    anchor = (np.minimum(from_right[:windows], from_left[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(windows), "right")
    inside = np.arange(windows) + length <= ends[owner]
    start = inside.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:] | (owner[1:] != owner[:-1])
    last = np.flatnonzero(stop)
    at = anchor[first]
    return owner[first], first, last, at, hashes[at].view(np.int64)


def _scan(length: int, gram: int):
    """Rows (t1, t2, first, anchor, last, gram, context) of the texts in (t1, t2, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                some = batch.slice(low, TEXTS)
                keys = [some.column(i).to_numpy() for i in (0, 1)]
                # Pieces of a long text overlap so that each window lies in one; a run that is cut there is two runs.
                texts = utf8(some.column(2))
                at = [(i, s) for i, t in enumerate(texts) for s in range(0, max(1, len(t) - length + 1), CHUNK)]
                parts = [texts[i][s : s + CHUNK + length - 1] for i, s in at]
                number, offset = np.array(at, np.int64).reshape(-1, 2).T
                for a, b in pieces(parts, CHUNK):
                    whole = b"".join(parts[a:b])
                    ends = np.cumsum([len(t) for t in parts[a:b]])
                    owner, first, last, anchor, hashes = runs(np.frombuffer(whole, np.uint8), ends, length, gram)
                    view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
                    context = np.array([digest(view[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())], np.uint64)
                    base = np.concatenate(([0], ends))[owner] - offset[a:b][owner]
                    text = number[a:b][owner]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(k[text]) for k in keys), *(pa.array((x - base).astype(np.int32)) for x in (first, anchor, last)), pa.array(hashes), pa.array(context.view(np.int64))],
                        ["t1", "t2", "first", "anchor", "last", "gram", "context"],
                    )

    return scan


SCANNED = "t1 long, t2 long, first int, anchor int, last int, gram long, context long"


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Intervals (depth, low, high) of the common-prefix tree with a depth of at least ``least``, by a stack scan; common[i] is shared by i and i + 1."""
    out, stack = [], []
    for i, depth in enumerate([*common.tolist(), -1]):
        low = i
        while stack and stack[-1][0] > depth:
            d, low = stack.pop()
            out.append((d, low, i))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))
    return out


def sorted_common(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings and the lengths of what neighbours share: a suffix array with its common prefixes."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)[order]
    width = max(1, int(sizes.max()))
    rows = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


def maximal_repeats(contexts: list[tuple[bytes, int]], length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before the anchor, bytes from it, numbers of the contexts) of all maximal repeats of at least ``length`` bytes around anchors.

    A context is its bytes and the place of its anchor in them.
    """
    if len(contexts) < 2:
        return
    order, common = sorted_common([c[at:] for c, at in contexts])
    before = [c[:at][::-1] for c, at in contexts]
    most = max(len(b) for b in before)
    for depth, low, high in intervals(common, max(1, length - most)):
        need = length - depth
        ranks = [r for r in range(low, high + 1) if len(before[order[r]]) >= need]
        if len(ranks) < 2:
            continue
        by_left, left_common = sorted_common([before[order[r]] for r in ranks])
        left_classes = intervals(left_common, max(need, 1))
        if need <= 0 and not left_common.min():  # the bytes before the anchors are diverse
            left_classes.append((0, 0, len(ranks) - 1))
        for extent, a, b in left_classes:
            members = np.array(ranks)[by_left[a : b + 1]]
            # Diverse to the right: else a deeper interval has the same occurrences with more bytes.
            if common[members.min() : members.max()].min() == depth:
                yield extent, depth, order[members]


CUT = "t1 long, t2 long, gram long, first int, anchor int, body binary, w1 long, w2 long"
ROWS = [c.split()[0] for c in CUT.split(", ")]
ROWS_TYPE = pa.schema(list(zip(ROWS, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))))


def _cut(length: int, large: bool, text: str):
    """From documents with their ``asks``, the contexts asked for; of large grams every window's hash instead. Copies in a row answer once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in batches:
            t1, t2, asked, texts = (batch.column(c) for c in ("t1", "t2", "asks", text))
            rows = {k: [] for k in ROWS}
            for i in range(batch.num_rows):
                key = (t1[i].as_py(), t2[i].as_py())
                if not asked[i].is_valid or key == previous:
                    continue
                previous = key
                raw = texts[i].as_py().encode()
                for ask in asked[i].as_py():
                    if ask["large"] != large:
                        continue
                    if not large:
                        new = [(ask["first"], ask["anchor"], raw[ask["first"] : ask["last"] + length], 0, 0)]
                    else:
                        marks = [(s, xxhash.xxh3_128_intdigest(raw[s : s + length])) for s in range(ask["first"], ask["last"] + 1)]
                        new = [(s, 0, b"", (m >> 64) - (1 << 63), (m & ((1 << 64) - 1)) - (1 << 63)) for s, m in marks]
                    for first, anchor, body, w1, w2 in new:
                        for k, v in zip(rows, (*key, ask["gram"], first, anchor, body, w1, w2)):
                            rows[k].append(v)
                    if len(rows["gram"]) >= HELD:
                        yield pa.RecordBatch.from_pydict(rows, ROWS_TYPE)
                        rows = {k: [] for k in ROWS}
            yield pa.RecordBatch.from_pydict(rows, ROWS_TYPE)

    return cut




def _solve(length: int):
    """Spans (t1, t2, start, end) of the repeats among contexts that come sorted by gram."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def spans(rows: list[dict]) -> pa.RecordBatch:
            # All repeats of a context hold its anchor, so together they are one span: a row for a context at most.
            reach: dict[int, list[int]] = {}
            for extent, depth, members in maximal_repeats([(r["body"], r["anchor"] - r["first"]) for r in rows], length):
                for i in members.tolist():
                    far = reach.setdefault(i, [0, 0])
                    far[:] = max(far[0], extent), max(far[1], depth)
            out = [(rows[i]["t1"], rows[i]["t2"], rows[i]["anchor"] - x, rows[i]["anchor"] + y) for i, (x, y) in reach.items()]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["t1", "t2", "start", "end"])

        for batch in batches:
            held += batch.select(["t1", "t2", "gram", "first", "anchor", "body"]).to_pylist()
            if not held:
                continue
            whole = len(held)  # the last gram may go on in the next batch
            while whole and held[whole - 1]["gram"] == held[-1]["gram"]:
                whole -= 1
            for a in _group_starts(held, whole):
                yield spans(held[a[0] : a[1]])
            held = held[whole:]
        for a in _group_starts(held, len(held)):
            yield spans(held[a[0] : a[1]])

    return solve


def _group_starts(rows: list[dict], stop: int, about: int = 2_000) -> Iterator[tuple[int, int]]:
    """Ranges of about ``about`` rows that end between grams; several grams share a suffix array."""
    start = 0
    for i in range(1, stop + 1):
        if i == stop or (i - start >= about and rows[i]["gram"] != rows[i - 1]["gram"]):
            yield start, i
            start = i


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in own])] for own in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["m1", "m2", "spans"])


def _keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for raw, own in zip(utf8(texts), spans.to_pylist()):
        at, parts = 0, []
        for s in own or []:
            parts.append(raw[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*parts, raw[at:]]))
    return pa.array(out, pa.binary())


def kept_bytes(text: str, spans: str) -> Column:
    """The UTF-8 bytes of a text outside its spans."""
    return F.arrow_udf(_keep, "binary")(text, spans)


def with_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, text: str = "text", name: str = "spans") -> DataFrame:
    """Add the maximal runs of bytes to be removed, as ``name``: array<struct<start, end>>, byte positions in the UTF-8 text.

    Repeats are judged on the texts as they come. Missing, empty and short texts have no spans. Rows
    that repeat a text are copies of each other and lose it whole if it has ``length`` bytes. An empty table
    gives no rows.
    """
    content = F.coalesce(column(docs, text), F.lit(""))
    digest = F.md5(content.cast("binary"))
    # Never missing, and declared so: an inner join adds no filter, and all joins below read one shuffle of the texts.
    half = lambda at: F.coalesce(F.conv(F.substring(digest, at, 16), 16, -10).cast("long"), F.lit(0).cast("long"))
    docs = docs.withColumns({"__t1": half(1), "__t2": half(17)})
    rows = docs.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), content.alias("text"))
    long_ = rows.filter(F.octet_length("text") >= length)
    n = long_.count()
    hot = long_.groupBy("t1", "t2").count().filter(F.col("count") > max(16, n // HOT_SHARE)).select("t1", "t2")
    hot = F.broadcast(stored(hot, "repeats-hot").withColumnsRenamed({"t1": "__hot1", "t2": "__hot2"}))

    scanned = long_.mapInArrow(_scan(length, gram), SCANNED)
    # Stored, so that Spark can split a gram that a third of all texts share: it does not over an aggregate of the same shuffle.
    grams = stored(scanned.groupBy("gram").count().filter("count > 1").select(F.col("gram").alias("again")), "repeats-grams")
    shared = stored(scanned.join(grams, F.col("gram") == F.col("again")).drop("again"), "repeats-shared")
    place = F.xxhash64("t1", "t2", "anchor")
    contexts = shared.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(place).alias("one"))
    contexts = stored(contexts, "repeats-contexts")
    several = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").withColumnRenamed("gram", "of_gram")
    contexts = stored(contexts.join(several, F.col("gram") == F.col("of_gram"), "left").select(F.col("gram").alias("g"), F.col("context").alias("c"), "times", "one", "kinds"), "repeats-kinds")
    seen = shared.join(contexts, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")))
    ask = F.when(F.col("kinds").isNotNull() & (place == F.col("one")), F.struct("gram", "first", "anchor", "last", (F.col("kinds") > group).alias("large")))
    span = F.when(F.col("times") > 1, F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    seen = seen.select("t1", "t2", ask.alias("ask"), span.alias("span")).filter("ask is not null or span is not null")
    told = stored(seen.groupBy("t1", "t2").agg(F.collect_set("ask").alias("asks"), F.collect_set("span").alias("sure")), "repeats-told")
    asking = told.filter(F.size("asks") > 0).select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "asks")

    marked = docs.join(hot, (F.col("__t1") == F.col("__hot1")) & (F.col("__t2") == F.col("__hot2")), "left")
    settled = marked.filter("__hot1 is not null").drop("__hot1", "__hot2")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(column(docs, text)).alias("end")))
    settled = settled.withColumn(name, whole).drop("__t1", "__t2")

    # All uses of ``packed`` read one shuffle of the texts, so they must ask for the same columns.
    names = {f"__d{i}": c for i, c in enumerate(docs.columns) if c not in ("__t1", "__t2")}
    packed = marked.filter("__hot1 is null").select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), *[column(docs, c).alias(k) for k, c in names.items()])
    body = next(k for k, c in names.items() if c == text)
    open_ = packed.join(asking, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).drop("k1", "k2")
    near, windows = (open_.mapInArrow(_cut(length, large, body), CUT) for large in (False, True))
    if hot.limit(1).count():
        # Settled texts, once each: they answer for the contexts that other texts share with them, but are no output.
        answering = marked.filter("__hot1 is not null").select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), content.alias("text")).dropDuplicates(["t1", "t2"])
        answering = answering.join(asking, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).drop("k1", "k2")
        answering = stored(answering, "repeats-answering")
        near = near.unionByName(answering.mapInArrow(_cut(length, False, "text"), CUT))
        windows = windows.unionByName(answering.mapInArrow(_cut(length, True, "text"), CUT))
    near = near.repartition("gram").sortWithinPartitions("gram").mapInArrow(_solve(length), "t1 long, t2 long, start int, end int")
    windows = windows.select("t1", "t2", "first", "w1", "w2")
    again = windows.groupBy("w1", "w2").count().filter("count > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
    equal = windows.join(again, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).select("t1", "t2", F.col("first").alias("start"), (F.col("first") + length).alias("end"))
    sure = told.select("t1", "t2", F.explode("sure").alias("span")).select("t1", "t2", "span.*")
    found = sure.unionByName(near).unionByName(equal).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = found.mapInArrow(_merge, "m1 long, m2 long, spans array<struct<start:int,end:int>>").withColumnRenamed("spans", "__spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    result = packed.join(found, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left").withColumn("__spans", F.coalesce("__spans", none))
    result = result.select(*[F.col(k).alias(c) for k, c in names.items() if c != name], F.col("__spans").alias(name))
    return result.unionByName(settled.select(*[column(settled, c) for c in result.columns]))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents with their repeated bytes cut out of the text; bytes of characters that a cut splits go too.

    All rows and columns stay. A missing text stays missing.
    """

    @F.arrow_udf("string")
    def as_text(raw: pa.Array) -> pa.Array:
        return pa.array([None if r is None else r.decode(errors="ignore") for r in raw.to_pylist()], pa.string())

    cut = with_repeats(docs, length, name="__spans")
    text = F.when(F.size("__spans") > 0, as_text(kept_bytes("text", "__spans"))).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    return cut.select(*[column(cut, c) for c in docs.columns])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings of 200 bytes go."""
    spans = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return spans.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(kept_bytes("text", "spans"), 256).alias("kept_sha256"),
    )
