"""Growing log files as a stream: appended bytes arrive as rows.

``GrowingLines`` is a streaming data source whose offset maps paths to bytes.
Each trigger lists the folder; a file's new bytes up to its last whole
line (or its last line, if that is one JSON object) are the next batch's, cut
into splits that executors read in parallel from their first byte on; splits of
small files go many to a task. A file
that shrank below its offset is read from its start. Rows are (path, ln,
line) with the line's first byte as ``ln``, so a batch that is run again gives
the same rows.

The driver lists names and sizes, and reads the last bytes of files that grew, to
find where their last line ends. A line of more than ``MAX_LINE`` bytes ends
its file's part in the stream: it stays where it is until it is
shortened, and is reported to the log, while the other files go on.

``GrowingReader`` holds such a map. A stream of many files must not, so its
reader, ``SnapshotReader``, writes it to a file, a folder's entries at a time, and
the offset is that file's path. Snapshots have their entries in one order, so
two of them are read side by side for what a batch has; the ranges of its tasks
are a file as well, and a task gets its place in it. The driver holds the names
of one folder and ``LOOKED`` entries.
"""

from __future__ import annotations

import fnmatch
import logging
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import batched

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.load import insert_events
from ledgerline.session import scratch_path
from ledgerline.sources.byte_ranges import CHUNK, OPEN_SHARE, SPLIT, Split, is_object, store_of
from ledgerline.sources.listing import absolute, hidden

MAX_LINE = 10 << 20
# Files that the driver looks at together, and tasks that many small ranges are dealt to at least.
READERS, FEWEST = 16, 64
# Entries that the driver holds at a time.
LOOKED = 4096
LINES = "path string, ln long, line string"
_ARROW = pa.schema([("path", pa.string()), ("ln", pa.int64()), ("line", pa.string())])
_ENTRY = pa.schema([("path", pa.string()), ("size", pa.int64()), ("end", pa.int64())])
_RANGE = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("offset", "start", "stop", "size")]])
# A file's path, its size when last looked at and the end of its last line then.
Entry = tuple[str, int, int]
_log = logging.getLogger(__name__)


@dataclass
class Range(InputPartition):
    """Bytes of one file, and further ranges that the same task reads after them."""

    path: str
    offset: int
    start: int
    stop: int
    size: int
    more: tuple[Range, ...] = ()


@dataclass
class Task(InputPartition):
    """A task's ranges: one batch of a file of them."""

    plan: str
    number: int


def last_line_end(path: str, offset: int, size: int, max_line: int) -> int:
    """Where the last whole line between ``offset`` and ``size`` ends (``offset``: there is none)."""
    store, name = store_of(path)
    with store.open_input_file(name) as file:
        rest, at = b"", size
        while at > offset and len(rest) <= max_line:
            begin = max(offset, at - CHUNK)
            file.seek(begin)
            data = file.read(at - begin)
            if (cut := data.rfind(b"\n")) >= 0:
                rest, at = data[cut + 1:] + rest, begin + cut + 1
                break
            rest, at = data + rest, begin
    if len(rest) > max_line:
        _log.warning("a line longer than %d bytes holds %s back", max_line, path)
        return offset
    return size if rest and is_object(rest) else at


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.depth = int(options["depth"]) if options.get("depth") else None
        self.split = int(options.get("split", SPLIT))
        self.max_line = int(options.get("maxline", MAX_LINE))
        self.seen: dict[str, list[int]] = {}  # path -> [size when last looked at, end of its last line]

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        store, root = store_of(self.root)
        prefix = self.root[:len(self.root) - len(root)] if self.root.endswith(root) else ""
        found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        levels = len(root.rstrip("/").split("/"))
        return {prefix + f.path: f.size for f in found if f.type == pyarrow.fs.FileType.File
                and fnmatch.fnmatch(os.path.basename(f.path), self.glob)
                and (self.depth is None or len(f.path.split("/")) - levels == self.depth)}

    def latestOffset(self) -> dict:
        ends = {}
        with ThreadPoolExecutor(READERS) as pool:  # waits for the store, not for Python
            for path, size, end in pool.map(self._ended, sorted(self._files().items()), chunksize=64):
                if end is not None:
                    self.seen[path], ends[path] = [size, end], end
        return ends

    def _ended(self, file: tuple[str, int]) -> tuple[str, int, int | None]:
        return self._end_of(*file, *self.seen.get(file[0], [-1, 0]))

    def _end_of(self, path: str, size: int, looked: int, end: int) -> tuple[str, int, int | None]:
        if size != looked:
            try:
                end = last_line_end(path, end if size >= end else 0, size, self.max_line)
            except OSError:  # gone, or not readable now: later
                end = None
        return path, size, end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = [part for path, size in end.items() for part in self._ranges(path, start.get(path, 0), size)]
        return self._packed(parts) or [Range("", 0, 0, 0, 0)]

    def _ranges(self, path: str, offset: int, size: int) -> list[Range]:
        """The new bytes of a file that was read up to ``offset`` and whose last line ends at ``size``."""
        if size < offset:  # the file was cut: all of it is new
            offset = 0
        return [Range(path, offset, at, min(at + self.split, size), size) for at in range(offset, size, self.split)]

    def _packed(self, parts: list[Range]) -> list[Range]:
        """The ranges by task: together no more than a split's bytes, what it costs to open a file included.

        Few ranges get a task each, and more of them at least ``FEWEST`` tasks.
        """
        tasks = list(self._dealt(parts, sum(map(self._cost, parts))))
        return [replace(first, more=tuple(more)) for first, *more in tasks]

    def _cost(self, part: Range) -> int:
        return part.stop - part.start + max(self.split // OPEN_SHARE, 1)

    def _dealt(self, parts: Iterable[Range], total: int) -> Iterator[list[Range]]:
        room, task, held = min(self.split, max(1, total // FEWEST)), [], 0
        for part in parts:
            size = self._cost(part)
            if task and held + size > room:
                yield task
                task, held = [], 0
            task.append(part)
            held += size
        if task:
            yield task

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self._lines((partition, *partition.more) if partition.path else ())

    def _lines(self, parts: Iterable[Range], whole: bool = False) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        held = 0
        for part in parts:
            split = Split(part.path, part.offset, part.start, part.stop, part.size, None, whole)
            for at, line in split.lines():
                rows.append((part.path, at, line.decode("utf-8", "replace")))
                held += len(line)
                if held >= CHUNK:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)


def _place(path: str) -> tuple[tuple[bool, str], ...]:
    """Orders paths as a walk meets them: in a folder its files by name, then its folders."""
    *folders, name = path.split("/")
    return (*((True, folder) for folder in folders), (False, name))


def _side_by_side(paths: Iterable[tuple], known: Iterable[Entry]) -> Iterator[tuple[tuple, Entry | None]]:
    """Each of ``paths`` (tuples that begin with one) with the entry of its path; both in order of ``_place``."""
    known = iter(known)
    entry = next(known, None)
    for item in paths:
        place = _place(item[0])
        while entry is not None and _place(entry[0]) < place:
            entry = next(known, None)
        yield item, entry if entry is not None and entry[0] == item[0] else None


class SnapshotReader(GrowingReader):
    """The same with offsets of bounded size: {"files": path of a snapshot}, "" before the first.

    Options besides: snapshots (a folder that driver and executors share, kept as long as the checkpoint), own (it is
    this stream's alone, so what no batch needs any more is removed), whole (the files don't grow: they aren't opened
    to plan a batch, and hidden ones are left out as in Spark's file sources).
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.base, self.own = options["snapshots"], options.get("own") == "true"
        self.whole = options.get("whole") == "true"
        self.folder, self.made = f"{self.base}/{uuid.uuid4().hex[:12]}", 0
        self.last = ""

    def initialOffset(self) -> dict:
        return {"files": ""}

    def _walk(self) -> Iterator[tuple[str, int]]:
        store, root = store_of(self.root)
        prefix = self.root[:len(self.root) - len(root)] if self.root.endswith(root) else ""
        folders = [(root.rstrip("/"), 1)]
        while folders:
            folder, level = folders.pop()
            found = sorted(store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name)
            if self.whole:
                found = [f for f in found if not hidden(f.base_name)]
            if self.depth is None or level == self.depth:
                yield from ((prefix + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File
                            and fnmatch.fnmatch(f.base_name, self.glob))
            if self.depth is None or level < self.depth:
                folders += [(f.path, level + 1) for f in reversed(found) if f.type == pyarrow.fs.FileType.Directory]

    def _entries(self) -> Iterator[tuple[Entry, Entry | None]]:
        """What there is now, and the last snapshot's entry of the same file."""
        files = _side_by_side(self._walk(), _read_entries(self.last))
        if self.whole:
            yield from (((path, size, size), entry) for (path, size), entry in files)
            return
        with ThreadPoolExecutor(READERS) as pool:  # waits for the store, not for Python
            for group in batched(files, LOOKED):
                look = lambda item: self._end_of(*item[0], *(item[1] or ("", -1, 0))[1:])
                for (path, size, end), (_, entry) in zip(pool.map(look, group), group, strict=True):
                    if end is not None:
                        yield (path, size, end), entry
                    elif entry is not None:  # not readable now: it stays at what was seen
                        yield entry, entry

    def latestOffset(self) -> dict:
        self.made += 1
        name, n, same = f"{self.folder}/{self.made:08d}.files", 0, bool(self.last)

        def noted() -> Iterator[Entry]:
            nonlocal n, same
            for now, before in self._entries():
                n, same = n + 1, same and now == before
                yield now

        _write(name, _ENTRY, batched(noted(), LOOKED))
        if same and n == sum(1 for _ in _read_entries(self.last)):
            _remove(name)
        else:
            self.last = name
        return {"files": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        def parts() -> Iterator[Range]:
            for (path, _, size), entry in _side_by_side(_entries_of(end), _entries_of(start)):
                yield from self._ranges(path, entry[2] if entry else 0, size)

        self._tidy({start.get("files", ""), end.get("files", ""), self.last})
        plan = f"{self.folder}/{uuid.uuid4().hex[:12]}.plan"
        tasks = self._dealt(parts(), sum(self._cost(part) for part in parts()))
        n = _write(plan, _RANGE, ([(p.path, p.offset, p.start, p.stop, p.size) for p in task] for task in tasks), pa.ipc.new_file)
        return [Task(plan, i) for i in range(n)] or [Range("", 0, 0, 0, 0)]

    def _tidy(self, needed: set[str]) -> None:
        """Removes this stream's files that no batch needs any more: all but the snapshots ``needed``."""
        if self.own:
            store, base = store_of(self.base)
            keep = {store_of(name)[1] for name in needed if name}
            for file in store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if file.type == pyarrow.fs.FileType.File and file.path not in keep:
                    store.delete_file(file.path)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Task):
            return self._lines(())
        store, name = store_of(partition.plan)
        with store.open_input_file(name) as file:
            ranges = pa.ipc.open_file(file).get_batch(partition.number).to_pylist()
        return self._lines((Range(**r) for r in ranges), self.whole)


def _write(path: str, schema: pa.Schema, batches: Iterable[Iterable[tuple]], kind: Callable = pa.ipc.new_stream) -> int:
    """Writes rows batch by batch; returns how many batches there are."""
    store, name = store_of(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    n = 0
    with store.open_output_stream(name) as out, kind(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for rows in batches:
            columns = zip(*rows, strict=True)
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
            n += 1
    return n


def _read_entries(path: str) -> Iterator[Entry]:
    if path:
        store, name = store_of(path)
        with store.open_input_stream(name) as file:
            for batch in pa.ipc.open_stream(file):
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _entries_of(offset: dict) -> Iterable[Entry]:
    """What an offset stands for; in checkpoints of before it is the map of paths to bytes."""
    if set(offset) == {"files"}:
        return _read_entries(offset["files"])
    return sorted(((path, end, end) for path, end in offset.items() if "/" in path), key=lambda entry: _place(entry[0]))


def _remove(path: str) -> None:
    store, name = store_of(path)
    store.delete_file(name)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class GrowingLines(DataSource):
    """Options: path (a folder), glob (of file names), depth (levels below the folder), split (bytes), maxline (bytes), and
    those of ``SnapshotReader``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingReader:
        return (SnapshotReader if "snapshots" in self.options else GrowingReader)(self.options)


def growing_lines(spark: SparkSession, root: str, glob: str = "*", checkpoint: str | None = None, **options) -> DataFrame:
    """A stream of (path, ln, line) of all files below ``root``, from their first byte on.

    ``checkpoint``: the checkpoint of the one query that reads the stream; its snapshots are kept there, instead of in the
    shared scratch folder.
    """
    spark.dataSource.register(GrowingLines)
    kept = {"snapshots": scratch_path(spark, "growing-files")} if checkpoint is None else {
        "snapshots": f"{absolute(spark, checkpoint)}/files", "own": "true"}
    options = {**kept, **options}
    return spark.readStream.format("growing_lines").options(glob=glob, **options).load(root)


def start_growing_ingest(spark: SparkSession, root: str, decoder, table_path: str, checkpoint: str, glob: str = "*",
                         available_now: bool = False, interval: str = "30 seconds", **options) -> StreamingQuery:
    """Decode appended lines and load their events; lines read again insert nothing.

    ``available_now``: one batch of what there is, then stop (a data source in
    Python has no admission control, so Spark runs it as one batch).
    """
    def load_batch(batch: DataFrame, batch_id: int) -> None:
        insert_events(batch.sparkSession, decoder(batch), table_path, key_index=True)

    writer = growing_lines(spark, root, glob, checkpoint, **options).writeStream.foreachBatch(load_batch).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
