"""Byte-range reading, the loader's single pass over it, and growing files as a stream."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from test_decoders import CLAUDE_LINES

from ledgerline.plans.ingest import latest_manifest, load_logs
from ledgerline.sources import byte_ranges, claude
from ledgerline.streaming.growing import GrowingReader, growing_lines, last_line_end, start_growing_ingest

NOW = datetime(2025, 11, 23)


def put(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as out:
        out.write(data)
    return len(data)


def read(path, offset, size, split, max_line=None, chunk=None):
    """Lines and ends of all splits of a file, as tasks would read them."""
    lines, ends = [], []
    for start in range(offset, max(size, offset + 1), split):
        part = byte_ranges.Split(path, offset, start, min(start + split, size), size, max_line)
        try:
            for line in part.lines():
                lines.append(line)
            ends.append((part.after, None))
        except byte_ranges.Ended as error:
            ends.append((None, str(error)))
    return lines, ends


@pytest.mark.parametrize("seed", range(6))
def test_splits_of_any_size_give_every_line_once(scratch, monkeypatch, seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 1, 3, 20, 70]) for _ in range(60)]
    data = b"\n".join(lines) + b"\n"
    put(f"{scratch}/a", data)
    monkeypatch.setattr(byte_ranges, "CHUNK", rng.choice([1, 7, 64]))
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for offset in (0, starts[17], starts[-1]):
        want = [(s, x) for s, x in zip(starts, lines, strict=False) if s >= offset]
        for split in (1, 5, 64, 10_000):
            got, ends = read(f"{scratch}/a", offset, len(data), split)
            assert got == want
            assert max(e for e, _ in ends if e is not None) == len(data)


def test_a_torn_last_line_waits_and_a_whole_object_does_not(scratch):
    for tail, consumed in ((b'{"a": 1', False), (b'{"a": NaN}', False), (b"[1]", False), (b'{"a": 1} x', False),
                           (b'{"a": 1}', True)):
        n = put(f"{scratch}/t", b"one\n" + tail)
        lines, ends = read(f"{scratch}/t", 0, n, 3)
        assert [x for _, x in lines] == [b"one"] + [tail] * consumed
        assert max(e for e, _ in ends if e is not None) == (n if consumed else 4)


def test_long_lines_lost_files_and_short_files_are_errors(scratch):
    n = put(f"{scratch}/l", b"a\n" + b"b" * 500 + b"\nc\n")
    lines, ends = read(f"{scratch}/l", 0, n, 1 << 20, max_line=100)
    assert lines == [(0, b"a")] and ends == [(None, byte_ranges.TOO_LONG)]
    assert read(f"{scratch}/l", 0, n, 1 << 20, max_line=500)[0] == [(0, b"a"), (2, b"b" * 500), (503, b"c")]
    assert "could not be read" in read(f"{scratch}/gone", 0, 10, 100)[1][0][1]
    assert read(f"{scratch}/l", 0, n + 50, 1 << 20)[1] == [(None, byte_ranges.NOT_TO_END)]


def test_a_line_over_many_splits_is_read_by_one_of_them(scratch, monkeypatch):
    monkeypatch.setattr(byte_ranges, "CHUNK", 16)
    n = put(f"{scratch}/l", b"a\n" + b"b" * 1000 + b"\nc\n")
    lines, ends = read(f"{scratch}/l", 0, n, 10)
    assert lines == [(0, b"a"), (2, b"b" * 1000), (1003, b"c")]
    assert [e for e, _ in ends if e is not None] == [1003, n]


def write(path, lines, mode="wb"):
    put(path, "".join(json.dumps(x) + "\n" for x in lines).encode(), mode)


def request(i):
    return dict(CLAUDE_LINES[5], uuid=f"n{i}", requestId=f"r{i}")


def rows_read(monkeypatch):
    """Records the plans that the loader gives to the byte-range reader."""
    plans, whole = [], byte_ranges.read_splits

    def watched(plan, *args, **kw):
        plans.append([(r.path.rsplit("/", 1)[1], r.offset, r.size) for r in plan.collect()])
        return whole(plan, *args, **kw)

    monkeypatch.setattr(byte_ranges, "read_splits", watched)
    return plans


def test_an_append_reads_only_what_was_appended(spark, scratch, monkeypatch):
    plans = rows_read(monkeypatch)
    root, table, manifest = f"{scratch}/logs", f"{scratch}/usage", f"{scratch}/manifest"
    write(f"{root}/p/a.jsonl", [request(i) for i in range(200)])
    write(f"{root}/p/b.jsonl", [request(i) for i in range(200, 400)])
    load_logs(spark, {"claude-code": root}, table, manifest, NOW)
    size = os.path.getsize(f"{root}/p/a.jsonl")
    write(f"{root}/p/a.jsonl", [request(500)], "ab")
    summary, _ = load_logs(spark, {"claude-code": root}, table, manifest, NOW)
    assert [(r.files, r.new_events) for r in summary.collect()] == [(1, 1)]
    assert plans[1] == [("a.jsonl", size, os.path.getsize(f"{root}/p/a.jsonl"))]
    load_logs(spark, {"claude-code": root}, table, manifest, NOW)
    assert len(plans) == 2 and spark.read.parquet(table).count() == 401


def test_a_failed_file_is_held_back_until_it_changes_or_the_time_is_over(spark, scratch, monkeypatch):
    plans = rows_read(monkeypatch)
    root, table, manifest = f"{scratch}/logs", f"{scratch}/usage", f"{scratch}/manifest"
    write(f"{root}/p/bad.jsonl", [request(1), dict(request(2), padding="y" * 5000)])
    write(f"{root}/p/good.jsonl", [request(3)])
    load = lambda now, **kw: load_logs(spark, {"claude-code": root}, table, manifest, now, max_line=1000, **kw)
    totals = lambda found: [(r.files, r.new_events, r.errors) for r in found[0].collect()]
    assert totals(load(NOW)) == [(2, 1, 1)]
    write(f"{root}/p/good.jsonl", [request(4)], "ab")
    summary, files = load(NOW + timedelta(minutes=10))
    assert [(r.files, r.new_events, r.errors) for r in summary.collect()] == [(1, 1, 1)]  # reported, not read
    assert {r.action: r.error for r in files.collect()} == {"held": byte_ranges.TOO_LONG, "resume": None}
    assert [p[0] for p in plans[1]] == ["good.jsonl"]
    assert totals(load(NOW + timedelta(hours=2))) == [(1, 0, 1)]  # tried again
    assert [p[0] for p in plans[2]] == ["bad.jsonl"]
    write(f"{root}/p/bad.jsonl", [request(1), request(2)])
    assert totals(load(NOW + timedelta(hours=2, minutes=1))) == [(1, 2, 0)]
    entry = [r for r in latest_manifest(spark, manifest)[0].collect() if r.path.endswith("bad.jsonl")][0]
    assert entry.state is None and entry.offset == os.path.getsize(f"{root}/p/bad.jsonl")


def test_splits_are_spread_over_tasks(spark, scratch):
    n = put(f"{scratch}/f/a.jsonl", b"".join(b"%06d\n" % i for i in range(5000)))
    plan = spark.createDataFrame([(f"{scratch}/f/a.jsonl", 0, n)], "path string, offset long, size long")
    rows = byte_ranges.read_splits(plan, split=1000)
    assert rows.rdd.getNumPartitions() == 35
    assert [r.line for r in byte_ranges.lines_of(rows).orderBy("ln").collect()] == ["%06d" % i for i in range(5000)]
    plan_text = rows._jdf.queryExecution().executedPlan().toString()
    assert "line" not in plan_text.split("MapInArrow")[1].split("Exchange", 1)[1]  # the shuffle has no lines


def test_small_files_share_tasks(spark, scratch):
    sizes = {f"{scratch}/f/{i}.jsonl": put(f"{scratch}/f/{i}.jsonl", b'{"i": %d}\n' % i) for i in range(300)}
    plan = spark.createDataFrame([(p, 0, n) for p, n in sizes.items()], "path string, offset long, size long")
    rows = byte_ranges.read_splits(plan)
    assert rows.rdd.getNumPartitions() <= 8
    assert sorted(r.line for r in byte_ranges.lines_of(rows).collect()) == sorted('{"i": %d}' % i for i in range(300))
    reader = GrowingReader({"path": f"{scratch}/f", "glob": "*.jsonl"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 128
    lines = [line for p in parts for b in reader.read(p) for line in b["line"].to_pylist()]
    assert sorted(lines) == sorted('{"i": %d}' % i for i in range(300))


def test_stream_offsets_follow_whole_lines(scratch):
    root = f"{scratch}/s"
    put(f"{root}/a.jsonl", b'{"a": 1}\n{"b"')
    put(f"{root}/b.txt", b"ignored\n")
    reader = GrowingReader({"path": root, "glob": "*.jsonl"})
    first = reader.latestOffset()
    assert first == {f"{root}/a.jsonl": 9}
    assert [(p.start, p.stop) for p in reader.partitions({}, first)] == [(0, 9)]
    put(f"{root}/a.jsonl", b": 2}", "ab")
    assert reader.latestOffset() == {f"{root}/a.jsonl": 17}  # an object without a line end counts
    put(f"{root}/a.jsonl", b'{"c": 3}\n')
    cut = reader.latestOffset()
    assert cut == {f"{root}/a.jsonl": 9}
    assert [(p.start, p.stop) for p in reader.partitions({f"{root}/a.jsonl": 17}, cut)] == [(0, 9)]
    os.remove(f"{root}/a.jsonl")
    assert reader.latestOffset() == {}
    assert last_line_end_of(scratch, b"a\n" + b"b" * 50, 40) == 0 and last_line_end_of(scratch, b"a\n" + b"b" * 50, 60) == 2


def last_line_end_of(scratch, data, max_line):
    put(f"{scratch}/z", data)
    return last_line_end(f"{scratch}/z", 0, len(data), max_line)


def test_growing_files_arrive_as_rows(spark, scratch):
    root, table, ckpt = f"{scratch}/logs", f"{scratch}/usage", f"{scratch}/ckpt"
    run = lambda: start_growing_ingest(spark, root, claude.decode, table, ckpt, glob="*.jsonl",
                                       available_now=True, split=300).awaitTermination()
    write(f"{root}/p/a.jsonl", [request(i) for i in range(5)])
    put(f"{root}/p/a.jsonl", json.dumps(request(5)).encode()[:30], "ab")
    run()
    assert spark.read.parquet(table).count() == 5
    write(f"{root}/p/a.jsonl", [request(i) for i in range(8)])
    write(f"{root}/p/b.jsonl", [request(20)])
    run()
    assert spark.read.parquet(table).count() == 9
    write(f"{root}/p/a.jsonl", [request(30)])  # cut, and new
    run()
    run()
    assert spark.read.parquet(table).count() == 10


def test_each_batch_has_only_new_lines(spark, scratch):
    root, seen = f"{scratch}/logs", []
    for state in ([0, 1, 2], [0, 1, 2, 3], [4]):
        write(f"{root}/a.jsonl", [request(i) for i in state])
        query = growing_lines(spark, root).writeStream.foreachBatch(
            lambda batch, _: seen.append(sorted(json.loads(r.line)["uuid"] for r in batch.collect()))).option(
            "checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [["n0", "n1", "n2"], ["n3"], ["n4"]]


def test_listing_by_depth_runs_on_the_executors(spark, scratch):
    from ledgerline.sources import listing

    for name in ("a.jsonl", "p/b.jsonl", "p/c.txt", "q r/d.jsonl", "q r/.hidden.jsonl", "_tmp/e.jsonl", "p/deep/f.jsonl"):
        put(f"{scratch}/root/{name}", b"x" * len(name))
    found = listing.list_files(spark, f"{scratch}/root", "*.jsonl", source="s", depth=2)
    assert sorted((r.path.rsplit("/root/", 1)[1], r.source, r.size) for r in found.collect()) == [
        ("p/b.jsonl", "s", 9), ("q r/d.jsonl", "s", 11)]
    whole = {r.path: (r.size, r.mtime) for r in listing.list_files(spark, f"{scratch}/root", "*.jsonl").collect()}
    assert all(whole[r.path] == (r.size, r.mtime) for r in found.collect())
    assert [r.path.rsplit("/", 1)[1] for r in listing.list_files(spark, f"{scratch}/root", "*", depth=1).collect()] == ["a.jsonl"]
    assert listing.list_files(spark, f"{scratch}/none", "*", depth=3).collect() == []


def lines_of_batch(reader, start, end):
    return sorted((p.rsplit("/s/", 1)[1], ln, line) for part in reader.partitions(start, end) for b in reader.read(part)
                  for p, ln, line in zip(*(c.to_pylist() for c in b.columns), strict=True))


def test_offsets_of_a_stream_do_not_grow_with_its_files(scratch):
    from ledgerline.streaming.growing import SnapshotReader

    root = f"{scratch}/s"
    names = [f"{f}{i}.jsonl" for f in ("", "a/", "a.b/", "a/deep/", "b/") for i in range(60)]
    for n in names:
        put(f"{root}/{n}", b'{"i": 1}\n')
    put(f"{root}/b/x.txt", b"ignored\n")
    options = {"path": root, "glob": "*.jsonl", "snapshots": f"{scratch}/snaps", "own": "true"}
    reader = SnapshotReader(options)
    begin, first = reader.initialOffset(), reader.latestOffset()
    assert len(json.dumps(first)) < 500  # a map of 300 paths before
    assert lines_of_batch(reader, begin, first) == sorted((n, 0, '{"i": 1}') for n in names)
    assert reader.latestOffset() == first  # nothing new: no batch
    put(f"{root}/a/0.jsonl", b'{"i": 2}\n{"torn', "ab")
    put(f"{root}/a/1.jsonl", b'{}\n')  # cut
    put(f"{root}/a-new/0.jsonl", b"new\n")
    os.remove(f"{root}/b/3.jsonl")
    second = reader.latestOffset()
    want = [("a-new/0.jsonl", 0, "new"), ("a/0.jsonl", 9, '{"i": 2}'), ("a/1.jsonl", 0, "{}")]
    assert lines_of_batch(reader, first, second) == want
    assert lines_of_batch(SnapshotReader(options), first, second) == want  # again, after a restart
    # The same as with the map of paths, also from a checkpoint that holds one.
    plain = GrowingReader(options)
    assert lines_of_batch(reader, {f"{root}/{n}": 9 for n in names}, second) == lines_of_batch(
        plain, {f"{root}/{n}": 9 for n in names}, plain.latestOffset()) == want
    assert lines_of_batch(reader, {f"{root}/{n}": 9 for n in names}, plain.latestOffset()) == want
    assert len(lines_of_batch(reader, {"logOffset": 0}, second)) == 301  # of Spark's file source: all files are new
    put(f"{root}/a/0.jsonl", b'": 3}\n', "ab")
    later = SnapshotReader(options)
    third = later.latestOffset()
    assert lines_of_batch(later, second, third) == [("a/0.jsonl", 18, '{"torn": 3}')]
    kept = [f for _, _, files in os.walk(f"{scratch}/snaps") for f in files]
    assert sorted(f.rsplit(".", 1)[1] for f in kept) == ["files", "files", "plan"]
    os.remove(f"{root}/a/0.jsonl")
    assert lines_of_batch(later, third, later.latestOffset()) == []


def test_a_folder_that_cannot_be_listed_stops_the_stream(scratch, monkeypatch):
    import pytest

    from ledgerline.streaming import growing

    put(f"{scratch}/s/a.jsonl", b"{}\n")
    reader = growing.SnapshotReader({"path": f"{scratch}/s", "snapshots": f"{scratch}/snaps"})

    class Refused:
        def get_file_info(self, selector):
            raise PermissionError(selector.base_dir)

    monkeypatch.setattr(growing, "store_of", lambda path, known=growing.store_of: (
        Refused(), path) if path == f"{scratch}/s" else known(path))
    with pytest.raises(PermissionError):
        reader.latestOffset()


def test_whole_files_are_not_opened_to_plan(scratch, monkeypatch):
    from ledgerline.streaming import growing

    for name, data in (("a.txt", b"one\ntwo"), ("d/b.txt", b"three\n"), ("_h/c.txt", b"x\n"), (".d.txt", b"x\n"), ("e.txt", b"")):
        put(f"{scratch}/s/{name}", data)
    monkeypatch.setattr(growing, "last_line_end", None)
    reader = growing.SnapshotReader({"path": f"{scratch}/s", "glob": "*.txt", "snapshots": f"{scratch}/snaps", "whole": "true"})
    assert lines_of_batch(reader, reader.initialOffset(), reader.latestOffset()) == [
        ("a.txt", 0, "one"), ("a.txt", 4, "two"), ("d/b.txt", 0, "three")]
