"""Landed files: one per source path and call, written by the tasks; listed without a depth by the executors."""

import glob

from ledgerline.sampledata.tool_logs import land_lines
from ledgerline.sources import listing

LINES = "path string, ln long, line string"


def test_files_land_where_they_stay(spark, scratch):
    rows = [("/a/x.jsonl", 2, "two"), ("/a/x.jsonl", 1, "one é"), ("/b/y z=%.jsonl", 1, "y"), (None, 1, "nobody's")]
    assert land_lines(spark.createDataFrame(rows, LINES), f"{scratch}/in") == 3
    assert land_lines(spark.createDataFrame(rows[:1], LINES), f"{scratch}/in") == 1
    assert land_lines(spark.createDataFrame([], LINES), f"{scratch}/none") == 0
    texts = sorted(open(f, encoding="utf-8").read() for f in glob.glob(f"{scratch}/in/*/*.txt"))
    assert texts == ["nobody's\n", "one é\ntwo\n", "two\n", "y\n"]
    assert listing.list_files(spark, f"{scratch}/none", "*.txt").collect() == []
    found = {r.path: r.size for r in listing.list_files(spark, f"{scratch}/in", "*.txt").collect()}
    assert sorted(found.values()) == [2, 4, 9, 11]
    assert found == {r.path: r.size for r in listing.list_files(spark, f"{scratch}/in", "*.txt", depth=2).collect()}
    assert sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(f"{scratch}/in").collect()) == [
        "nobody's", "one é", "two", "two", "y"]


def test_a_listing_without_a_depth_is_sparks(spark, scratch):
    import os

    for name in ("a.txt", "p/b.txt", "p/q/c.txt", "p/q/d.csv", "_h/e.txt", "_h=1/f.txt", ".g/h.txt", "p/_i.txt", "p/j.txt._COPYING_"):
        os.makedirs(os.path.dirname(f"{scratch}/r/{name}"), exist_ok=True)
        with open(f"{scratch}/r/{name}", "w") as f:
            f.write(name)
    listed = listing.list_files(spark, f"{scratch}/r", "*.txt", source="s")
    whole = spark.read.format("binaryFile").options(pathGlobFilter="*.txt", recursiveFileLookup="true").load(f"{scratch}/r")
    assert sorted((r.path, r.size) for r in listed.collect()) == sorted((r.path, r.length) for r in whole.collect())
    assert "binaryFile" not in listed._jdf.queryExecution().toString()
    assert listing.list_files(spark, f"{scratch}/r/a.txt").first().size == 5


def test_a_larger_backlog_has_no_more_batches():
    from ledgerline.queries import _per_trigger

    assert [_per_trigger(n) for n in (0, 150, 1500)] == [64, 64, 64]
    assert all(-(-n // _per_trigger(n)) <= 24 for n in (1_536, 1_537, 9_000, 90_000))


def test_a_folder_that_cannot_be_listed_fails_the_listing(spark, scratch, monkeypatch):
    import pyarrow as pa
    import pyarrow.fs
    import pytest

    def children(path):
        return [b["path"].to_pylist() for b in listing._children(iter([pa.record_batch({"path": [path]})]), None, "*")]

    with open(f"{scratch}/no-folder", "w") as f:
        f.write("x")
    with pytest.raises(OSError):
        children(f"{scratch}/no-folder")
    assert children(f"{scratch}/gone") == [[]]

    class Refused:
        def get_file_info(self, selector):
            raise PermissionError(selector.base_dir)

    monkeypatch.setattr(listing, "store_of", lambda path: (Refused(), path))
    with pytest.raises(PermissionError):
        children(scratch)
    kind = pyarrow.fs.FileType.File
    with pytest.raises(PermissionError):
        list(listing._children(iter([pa.record_batch({"path": [scratch]})]), kind, "*"))
