"""Reading feeds, finding headers, auditing."""

import datetime as dt

import pytest

from worktally.session import shared_dir, stored
from worktally.sources import audit, feeds, versions


@pytest.fixture
def small_splits(spark):
    """Cut even small files into many splits."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text("".join(f"{f},{i},{'x' * (i % 17)}\n" for i in range(1, 80 + f)))
    lines = feeds.read_lines(spark, str(tmp_path))
    splits = spark.read.text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct().count()
    assert splits > 3
    got = sorted((r["feed"][-6:], r["pos"], r["cells"][1]) for r in lines.collect())
    assert got == sorted((f"f{f}.csv", i, str(i)) for f in range(3) for i in range(1, 80 + f))


def test_cells_with_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,"b, ""c""", ,d\n"x",,\n')
    got = [r["cells"] for r in feeds.read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [["a", 'b, "c"', None, "d"], ["x", None, None]]


@pytest.fixture
def dirt(spark):
    data = [("f", 1, [None, None]), ("f", 2, ["ID", "Value"]), ("f", 3, ["1", "4"]), ("f", 4, ["2", "5"]), ("f", 5, ["3", "6"])]
    return spark.createDataFrame(data, "feed string, pos bigint, cells array<string>")


def test_find_header(spark, dirt, rows):
    assert rows(feeds.find_header(dirt), "feed", "header_row") == [("f", 2)]
    assert rows(feeds.find_header(dirt, value="5", column=2), "header_row") == [(4,)]
    assert feeds.find_header(dirt, value="5").count() == 0
    short = spark.createDataFrame([("g", 1, ["title"]), ("g", 2, ["a", "b"])], dirt.schema)
    assert rows(feeds.find_header(short), "header_row") == [(2,)]


def test_header_to_names(dirt, rows):
    out = feeds.header_to_names(dirt, 2, clean=False)
    assert out.columns == ["feed", "pos", "ID", "Value"]
    assert rows(out, "ID", "Value") == [("1", "4"), ("2", "5"), ("3", "6")]
    assert rows(feeds.header_to_names(dirt), "id", "value") == [("1", "4"), ("2", "5"), ("3", "6")]
    kept = feeds.header_to_names(dirt, 3, remove_row=False, remove_rows_above=False, clean=False)
    assert kept.count() == 5
    assert feeds.header_to_names(dirt, 3, remove_rows_above=False, clean=False).count() == 4


def test_headers_differ_between_feeds(spark, rows):
    data = [("f", 1, ["a", "b"]), ("f", 2, ["1", "2"]), ("g", 1, ["b", "c", "b"]), ("g", 2, ["3", "4", "5"]), ("g", 3, ["6", None])]
    lines = spark.createDataFrame(data, "feed string, pos bigint, cells array<string>")
    out = feeds.header_to_names(lines, 1)
    assert rows(out, "feed", "a", "b", "c", "b_2") == [("f", "1", "2", None, None), ("g", None, "3", "4", "5"), ("g", None, "6", None, None)]


def test_ragged_feeds_keep_their_lines(spark, dirt, rows):
    def header(*lines):
        df = spark.createDataFrame([("r", i + 1, list(cells)) for i, cells in enumerate(lines)], dirt.schema)
        return rows(feeds.find_header(df), "header_row"), feeds.header_to_names(df, clean=False)

    at, out = header(["a", "b"], ["1", "2"], ["3", None, "x"])
    assert at == [(1,)] and rows(out, "a", "b") == [("1", "2"), ("3", None)]
    assert header(["a", "b"], ["1", "2"], ["3", "4", "x"])[0] == [(1,)]
    assert header(["a", "b", "c"], ["1", "2"], ["3", "4"])[0] == [(1,)]
    assert header(["note"], ["note"], ["note"], ["a", "b", "c"], ["1", "2", "3"])[0] == [(4,)]
    assert header(["a", "b"], ["1", "2", None], ["3", "4", None])[0] == [(1,)]


def test_feeds_without_a_header_are_named(spark, dirt):
    short = spark.createDataFrame([("short", 1, ["a", "b"]), ("blank", 1, [None])], dirt.schema)
    with pytest.raises(ValueError, match="short"):
        feeds.header_to_names(dirt.unionByName(short), 2)
    with pytest.raises(ValueError, match="'holes'"):
        feeds.header_to_names(dirt.unionByName(spark.createDataFrame([("holes", 1, ["a", None])], dirt.schema)))
    assert feeds.header_to_names(dirt.unionByName(short.filter("feed = 'blank'"))).count() == 3


def test_read_feed(spark, tmp_path, rows):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("exported,,\nDate,Project,Hours worked\n2024-01-01,a,1.5\nsoon,b,many\n")
    df = feeds.read_feed(spark, str(tmp_path / "c"), skip=1, types={"date": "date", "hours_worked": "double"})
    assert rows(df) == [(dt.date(2024, 1, 1), "a", 1.5), (None, "b", None)]
    plain = feeds.read_feed(spark, str(tmp_path / "c"))
    assert plain.columns[0] == "exported" and plain.count() == 3
    df.write.parquet(str(tmp_path / "p"))
    assert rows(feeds.read_feed(spark, str(tmp_path / "p"), "parquet")) == rows(df)
    df.createOrReplaceTempView("feed_view")
    assert rows(feeds.read_feed(spark, "feed_view", "table")) == rows(df)


def test_snapshot_and_stored(spark, tmp_path, rows):
    df = spark.range(5).selectExpr("id", "id * 2 AS x")
    copy = feeds.snapshot(df, str(tmp_path / "s"))
    assert rows(copy) == rows(df) and copy.inputFiles()
    feeds.snapshot(df.limit(2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    kept = stored(df, "t")
    assert rows(kept) == rows(df)
    assert shared_dir(spark) in kept.inputFiles()[0]


def test_versions_do_not_disturb_each_other(spark, tmp_path, rows):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        versions.newest(spark, path)
    first = versions.publish(spark.range(5), path)
    lazy = versions.newest(spark, path).selectExpr("id * 2 AS x")
    versions.publish(spark.range(7), path)
    spark.range(99).write.parquet(f"{path}/data-half")
    assert versions.newest(spark, path).count() == 7 and first.count() == 5 and rows(lazy) == [(0,), (2,), (4,), (6,), (8,)]
    # Young versions and half-written data stay whatever is to be kept.
    assert versions.sweep(spark, path, keep=1) == []
    assert lazy.count() == 5 and len(versions.published(spark, path)) == 2
    third = versions.publish(spark.range(0), path, keep=2, grace_hours=0)
    assert len(versions.published(spark, path)) == 2 and third.columns == ["id"]
    assert sorted(p.name[:5] for p in (tmp_path / "v").iterdir()) == ["_publ", "data-", "data-"]
    assert versions.newest(spark, path).count() == 0


def test_writers_at_once_both_publish(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "w")
    with ThreadPoolExecutor(4) as pool:
        sizes = [df.count() for df in pool.map(lambda n: versions.publish(spark.range(n), path), range(1, 9))]
    assert sizes == list(range(1, 9)) and len(versions.published(spark, path)) == 8
    assert versions.newest(spark, path).count() in sizes


@pytest.fixture
def three(spark):
    df1 = spark.createDataFrame([(1, "big"), (2, "small")], "a int, b string")
    df2 = spark.createDataFrame([(10, 1, 0.0), (11, 2, 0.0)], "a int, b bigint, c double")
    df3 = spark.createDataFrame([(1, "7")], "a int, b string")
    return {"df1": df1, "df2": df2, "df3": df3}


def test_compare_and_match(three, rows):
    assert rows(audit.compare_columns(three)) == [("a", "int", "int", "int"), ("b", "string", "bigint", "string"), ("c", None, "double", None)]
    assert rows(audit.compare_columns(three, "mismatch")) == [("b", "string", "bigint", "string")]
    assert rows(audit.compare_columns(three, "mismatch", "strict"), "column_name") == [("b",), ("c",)]
    assert rows(audit.compare_columns(three, "match"), "column_name") == [("a",), ("c",)]
    one_three = {k: three[k] for k in ("df1", "df3")}
    assert audit.feeds_match(one_three) and audit.feeds_match(one_three, "strict")
    assert not audit.feeds_match({k: three[k] for k in ("df2", "df3")})


def test_audit_counts_values_that_do_not_fit(three, rows):
    got = {(r["feed"], r["column_name"]): (r["type"], r["common_type"], r["n_values"], r["n_misfits"]) for r in audit.audit_feeds(three).collect()}
    assert got[("df1", "b")] == ("string", "bigint", 2, 2)
    assert got[("df3", "b")] == ("string", "bigint", 1, 0)
    assert got[("df1", "c")] == (None, "double", 0, 0)
    assert audit.audit_feeds({k: three[k] for k in ("df1", "df3")}, "mismatch").count() == 0


class _Session:
    """Just the two settings the shared folder depends on."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: folder})()


def test_shared_folder():
    assert shared_dir(_Session("yarn", "hdfs://shared/ckpt/")) == "hdfs://shared/ckpt"
    scratch = shared_dir(_Session("local[4]", None))
    assert scratch == shared_dir(_Session("local[4]", "")) and "worktally-" in scratch
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077", None))
