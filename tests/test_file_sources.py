"""Files written one a row and read back through processors."""

import json
import os

import pytest

from corpusmill.sources import page_files, source_files

URLS = ["http://a.b/c/d?x=1#f", "http://a.b", "http://a.b/", "https://a.b/é ü/x.pdf", "no address", "", "http://a.b/" + "y" * 300, "http:///path", "ftp://h/p_q-r", "http://a.b/c/d"]


@pytest.fixture
def sink(spark, tmp_path):
    spark.dataSource.register(page_files.PageFiles)

    def write(rows, schema="url string, text string, external boolean", mode="append", crawl="one"):
        df = spark.createDataFrame(rows, schema).repartition(3)
        (page_files.named(df) if "url" in df.columns else df).write.format("page_files").option("crawl", crawl).mode(mode).save(str(tmp_path / "site"))
        return tmp_path / "site"

    return write


def test_a_file_a_row_and_an_index(sink):
    site = sink([(u, f"text of {u}", k % 2 == 0) for k, u in enumerate(URLS)] + [(None, "x", False), ("http://n/", None, None)])
    index = json.loads((site / "metadata.json").read_text())
    files = {p["url"]: (site / p["filePath"]).read_text() for p in index["pages"]}
    assert files == {u: f"text of {u}" for u in URLS} | {"http://n/": ""} and index["lastCrawl"] == "one"
    assert sorted(os.listdir(site)) == ["_staged", "external", "metadata.json", "pages"] and os.listdir(site / "_staged") == []
    again = sink([("http://n/", "new", False), ("http://o/", "more", False)], crawl="two")
    index = {p["url"]: p for p in json.loads((again / "metadata.json").read_text())["pages"]}
    assert len(index) == len(URLS) + 2 and index["http://n/"]["crawledAt"] == "two" and index["http://a.b"]["crawledAt"] == "one"
    assert (again / index["http://n/"]["filePath"]).read_text() == "new"
    whole = sink([("http://o/", "only", False)], mode="overwrite")
    assert len(os.listdir(whole / "pages")) == 1 and os.listdir(whole / "external") == [] and len(page_files.read_index(str(whole))["pages"]) == 1


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    from pyspark.sql import Row

    writer = page_files.Writer(str(tmp_path / "s"), "c", False)
    rows = [Row(url=f"http://a/{k}", text="t", name=f"{k}.txt") for k in range(3)]
    writer.write(iter(rows))  # an attempt whose executor was lost
    kept = writer.write(iter(rows))
    writer.commit([kept, None])
    assert len(os.listdir(tmp_path / "s/pages")) == 3 and os.listdir(tmp_path / "s/_staged") == []
    failed = page_files.Writer(str(tmp_path / "s"), "d", True)
    failed.abort([failed.write(iter(rows[:1]))])
    assert len(os.listdir(tmp_path / "s/pages")) == 3 and os.listdir(tmp_path / "s/_staged") == []


def test_missing_columns_are_refused(sink):
    with pytest.raises(Exception, match="pages need name, url"):
        sink([("x",)], "text string")


def test_processors_of_a_caller(spark, tmp_path):
    for name, data in (("pages/a.txt", b"one"), ("pages/b.csv", b"x,y"), ("pages/.hidden.txt", b"no"), ("excel/c.csv", b"\xff"), ("sub/pages/d.txt", "é".encode()), ("elsewhere/e.txt", b"no"), ("other/f.bin", b"0"), ("pages/g.txt", b"")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    registry = source_files.default_registry().register("csv", lambda f: f.name.endswith(".csv"), lambda data, f: data.decode().replace(",", " "))
    source_files.register(spark, registry)
    read = spark.read.format("source_files").option("partition_bytes", 2).load(str(tmp_path))
    rows = {r.name: r for r in read.collect()}
    assert {n: (r.processor, r.content) for n, r in rows.items()} == {"a.txt": ("file", "one"), "b.csv": ("csv", "x y"), "c.csv": ("csv", None), "d.txt": ("file", "é"), "g.txt": ("file", "")}
    assert "UnicodeDecodeError" in rows["c.csv"].error and rows["a.txt"].error is None and rows["d.txt"].size == 2
    assert {r.name for r in read.filter("category = 'pages' and name like '%.txt' and content <> 'one'").collect()} == {"d.txt", "g.txt"}
    assert {r.name for r in read.filter("processor in ('csv', 'x')").select("name").collect()} == {"b.csv", "c.csv"}


def test_filters_leave_files_out_and_sizes_are_even(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

    os.makedirs(tmp_path / "pages")
    os.makedirs(tmp_path / "external")
    for k in range(20):
        (tmp_path / f"{('pages', 'external')[k % 2]}/f{k}.txt").write_bytes(b"x" * (100 * k))
    reader = source_files.Reader(source_files.default_registry(), str(tmp_path), 3000, ["name"])
    parts = reader.partitions()
    sizes = [sum(f.size for f in p.files) for p in parts]
    assert len(parts) == 7 and sum(sizes) == 19000 and max(sizes) - min(sizes) < 1500
    left = list(reader.pushFilters([EqualTo(("category",), "pages"), In(("name",), ["f2.txt", "f3.txt", "f4.txt"]), StringEndsWith(("name",), "4.txt"), GreaterThan(("size",), 1)]))
    assert len(left) == 1 and [f.name for p in reader.partitions() for f in p.files] == ["f4.txt"]
    assert list(reader.read(reader.partitions()[0])) == [("f4.txt",)]


def test_visits_of_an_address(sink, spark):
    """Each visit has its file and its index; a second write goes on in them, and an overwrite leaves none."""
    seen = [("http://a/x", "one", False, 0), ("http://a/x", "two", False, 1), ("http://a/y", "three", True, None)]
    site = sink(seen, "url string, text string, external boolean, visit int")
    first, second = page_files.read_index(str(site)), page_files.read_index(str(site / "visits/1"))
    assert [(p["url"], (site / p["filePath"]).read_text()) for p in first["pages"]] == [("http://a/x", "one"), ("http://a/y", "three")]
    assert [(p["url"], (site / "visits/1" / p["filePath"]).read_text()) for p in second["pages"]] == [("http://a/x", "two")]
    sink([("http://a/x", "new", False, 1), ("http://a/z", "more", False, 1)], "url string, text string, external boolean, visit int")
    assert len(page_files.read_index(str(site / "visits/1"))["pages"]) == 2 and os.listdir(site / "_staged") == []
    spark_rows = page_files.visits(spark.createDataFrame([(1, "a"), (3, "a"), (2, "b"), (2, "a")], "page_id int, url string"), "page_id")
    assert sorted((r.url, r.page_id, r.visit) for r in spark_rows.collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 2, 0)]
    assert sorted(os.listdir(sink([("http://o/", "only", False)], mode="overwrite"))) == ["_staged", "external", "metadata.json", "pages"]
