"""Cumulative-counter decoding on a stream of lines that may arrive in any order, with per-file state.

Input: a stream of (path, ln, line) rows, in which the lines of a growing log
file arrive over many micro-batches, late and repeated ones included. Lines are
parsed and typed on the JVM (``codex.marks``); the typed rows of a file meet its
state in ``transformWithState``. The state of a file lies in the state store by
chunks of ``CHUNK`` line numbers: the chunk's typed rows, and what the replay
has carried into it (session, folder, model, previous counters, fallback
number). A micro-batch reads the chunks that its lines fall into. Lines at the
file's end cost the last chunk; a late line is put into its chunk, and the
replay runs again from there, as it changes the events after it. Lines come to
the state, lie in it and leave it packed by file: logs are many short files, and
what costs is the number of rows and frames, not the replay.

Output: the events of replayed lines, and removals of those that are no events
any more, written under the batch id to the events folder; the current event
of a line is that of its latest batch. A replayed micro-batch overwrites its own
folder and starts from the state of the batch before (the state store is
versioned with the checkpoint). ``compact`` merges the folders of old batches
into one generation, so that reads don't grow with the number of batches.

A file's lines of one batch are replayed by one task, as they are in order; the
batch decoder cuts a file into chunks that run in parallel, for bulk loads.
"""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ledgerline.functions.timecols import with_rfc3339
from ledgerline.schema import USAGE, USAGE_COLUMNS
from ledgerline.sources import codex
from ledgerline.streaming.generations import compact_folder, read_generations

EVENTS = [*USAGE_COLUMNS, "path", "ln"]
CHUNK = 8192
COUNTERS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
INPUT, CACHED, OUTPUT, REASONING, TOTAL = range(len(COUNTERS))

_USAGE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in USAGE.fields)
CHANGES = f"path string, ln long, live boolean, {_USAGE}"
STORED = f"{CHANGES}, batch long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Carry:
    """What earlier lines of a file mean to the next one."""

    sid: str = ""
    cwd: str = ""
    model: str = ""
    prior: tuple[int, ...] | None = None  # counters of the segment so far
    fallbacks: int = 0


# A typed line in the state and between the stages: plain values, ``ts`` in microseconds; ``cur`` and ``last`` are the
# counters, or None where the line has none.
Line = tuple[int, str | None, int | None, bool, bool, str | None, str | None, str | None, tuple[int, ...] | None, tuple[int, ...] | None]
CHANGED = pa.schema([("path", pa.string()), ("ln", pa.int64()), ("live", pa.bool_()), *[
    (f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.timestamp("us")))
    for f in USAGE.fields]])


def _fits(value: int) -> bool:
    return -(1 << 63) <= value < 1 << 63


def _tokens(delta: list[int], i: int, less: int | None = None) -> int:
    """A delta, or the difference of two; what is negative or beyond 64 bits counts as 0."""
    value = delta[i]
    if not _fits(value) or less is not None and not _fits(delta[less]):
        return 0
    value -= 0 if less is None else delta[less]
    return value if 0 < value and _fits(value) else 0


def replay_lines(lines: list[Line], carry: Carry, file_session: str) -> tuple[list[tuple], Carry]:
    """(ln, live, *USAGE_COLUMNS) of a file's typed lines in order, a row per counter line, and the next carry.

    One pass over plain values: most files are short, and a frame costs more than their lines.
    """
    sid, cwd, model, prior, fallbacks = carry.sid, carry.cwd, carry.model, carry.prior, carry.fallbacks
    events = []
    for ln, stamp, ts, is_tok, is_meta, meta_id, meta_cwd, turn_model, cur, last in lines:
        sid, cwd, model = meta_id or sid, meta_cwd or cwd, turn_model or model
        if is_meta:
            prior = None
        if is_tok:
            before = prior or (0,) * 5
            if cur is not None:
                base = (0,) * 5 if cur[TOTAL] < before[TOTAL] else before
                delta, total = [a - b for a, b in zip(cur, base)], cur[TOTAL]
            else:
                delta, total = list(last or (0,) * 5), before[TOTAL] + (last[TOTAL] if last else 0)
            live = (cur is not None or last is not None) and delta[TOTAL] > 0 and _fits(delta[TOTAL]) and ts is not None and model != ""
            if live:
                session = sid or file_session
                key = [session, stamp or ""]
                if _fits(total):
                    key.append(str(total))
                if cur is None:
                    key.append(str(fallbacks))
                    fallbacks += 1
                events.append((ln, True, codex.SOURCE, ":".join(key), ts, model, session, cwd, _tokens(delta, INPUT, CACHED),
                               _tokens(delta, OUTPUT, REASONING), _tokens(delta, CACHED), 0, _tokens(delta, REASONING), None))
            else:
                events.append((ln, False, "", "", ts, "", "", "", 0, 0, 0, 0, 0, None))
        if cur is not None:
            prior = cur
    return events, Carry(sid, cwd, model, prior, fallbacks)


def _lines_of(rows: pd.DataFrame) -> list[Line]:
    """The typed lines of a frame with the columns of ``typed``."""
    text = lambda c: [v if isinstance(v, str) else None for v in rows[c]]
    counts = lambda name: [tuple(int(x) for x in v) if has else None
                           for has, v in zip(rows[f"has_{name}"], rows[name], strict=True)]
    stamps = pd.to_datetime(rows["ts"]).astype("datetime64[us]")
    ts = [None if gone else us for gone, us in zip(stamps.isna(), stamps.astype("int64").tolist(), strict=True)]
    return list(zip(rows["ln"].tolist(), text("timestamp"), ts, rows["is_tok"].tolist(), rows["is_meta"].tolist(), text("meta_id"),
                    text("meta_cwd"), text("turn_model"), counts("cur"), counts("last"), strict=True))


def _batch_of(path: str, events: list[tuple]) -> pa.RecordBatch:
    """CHANGES rows of a file's events."""
    columns = [[path] * len(events), *zip(*events, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHANGED, strict=True)], schema=CHANGED)


def replay(rows: pd.DataFrame, carry: Carry, file_session: str) -> tuple[pd.DataFrame, Carry]:
    """``replay_lines`` of a frame of typed lines."""
    events, carry = replay_lines(_lines_of(rows), carry, file_session)
    return pd.DataFrame(events, columns=["ln", "live", *USAGE_COLUMNS]), carry


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``typed`` rows as one row (path, lines) per file and batch, so that a file is few rows to its state."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.sort_by("path")
        counts = lambda name: [tuple(c) if has else None for has, c in zip(
            batch[f"has_{name}"].to_pylist(), batch[name].flatten().to_numpy().reshape(-1, len(COUNTERS)).tolist(), strict=True)]
        plain = {c: batch[c].to_pylist() for c in ("ln", "timestamp", "is_tok", "is_meta", "meta_id", "meta_cwd", "turn_model")}
        ts = batch["ts"].cast(pa.int64()).to_pylist()
        lines = list(zip(plain["ln"], plain["timestamp"], ts, plain["is_tok"], plain["is_meta"], plain["meta_id"],
                         plain["meta_cwd"], plain["turn_model"], counts("cur"), counts("last"), strict=True))
        runs = pc.run_end_encode(batch["path"])
        starts = [0, *runs.run_ends.to_pylist()]
        yield pa.RecordBatch.from_pydict({"path": runs.values, "lines": pa.array(
            [pickle.dumps(lines[a:b]) for a, b in zip(starts, starts[1:])], pa.binary())})


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (CHANGES) that the state gave packed by file."""
    for batch in batches:
        for events in batch["events"].to_pylist():
            yield from pa.ipc.open_stream(events)


def _stored(data: bytes) -> list[Line]:
    """The lines of a chunk of the state; checkpoints of before have them as an Arrow stream."""
    return _lines_of(pa.ipc.open_stream(data).read_all().to_pandas()) if data[:4] == b"\xff" * 4 else pickle.loads(data)


def _carry_of(text: str) -> Carry:
    found = json.loads(text)
    return Carry(**{**found, "prior": None if found["prior"] is None else tuple(found["prior"])})


class CounterProcessor(StatefulProcessor):
    """State of a file: chunk number -> (carry into the chunk, its rows), and the carry after the last chunk."""

    def init(self, handle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk long", "carry string, rows binary")
        self.after = handle.getValueState("after", "last_chunk long, carry string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = self._changes(key[0], self._lines(rows))
        if changes:
            yield self._output(key[0], changes)

    def _changes(self, path: str, lines: list[Line]) -> list[tuple]:
        """Takes lines into the state; the events of the file's lines from the first new one on, as ``replay_lines`` gives them."""
        todo: dict[int, dict[int, Line]] = {}
        for line in lines:
            todo.setdefault(line[0] // CHUNK, {}).setdefault(line[0], line)
        last_chunk, carry = -1, Carry()
        if self.after.exists():
            last_chunk, text = self.after.get()
            carry = _carry_of(text)
        first = min(todo)
        stored = []
        if first <= last_chunk:
            stored = sorted(c for (c,) in self.chunks.keys() if c >= first)
        changes, session = [], self._session(path)
        changed_from, started = None, False
        for chunk in sorted({*todo, *stored}):
            known = self.chunks.getValue((chunk,)) if chunk in stored else None
            old = _stored(known[1]) if known is not None else []
            if known is not None and not started:
                carry = _carry_of(known[0])
            elif not started and chunk < last_chunk:
                # A late chunk between stored ones: it begins with what is carried into the next one.
                carry = _carry_of(self.chunks.getValue((min(c for c in stored if c > chunk),))[0])
            started, into = True, carry
            part = todo.get(chunk, {})
            if part and old:
                seen = {line[0] for line in old}
                part = {ln: line for ln, line in part.items() if ln not in seen}
            whole = old
            if part:
                whole = sorted([*old, *part.values()], key=itemgetter(0))
                if changed_from is None:
                    changed_from = min(part)
            if changed_from is None and not any(c > chunk for c in todo):
                return []  # nothing but lines that are known already
            events, carry = replay_lines(whole, carry, session)
            carried = json.dumps(asdict(into))
            if whole is not old or known[0] != carried:
                self.chunks.updateValue((chunk,), (carried, pickle.dumps(whole)))
            if changed_from is not None:
                changes += [event for event in events if event[0] >= changed_from]
        self.after.update((max(last_chunk, max(todo)), json.dumps(asdict(carry))))
        return changes

    @staticmethod
    def _session(path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        name = name.removesuffix(".jsonl")
        return name[-36:] if len(name) >= 36 else name

    @staticmethod
    def _lines(rows: Iterator[pd.DataFrame]) -> list[Line]:
        return [line for part in rows for line in _lines_of(part)]

    @staticmethod
    def _output(path: str, events: list[tuple]) -> pd.DataFrame:
        return _batch_of(path, events).to_pandas()

    def close(self) -> None:
        pass


class PackedProcessor(CounterProcessor):
    """Takes the rows of ``pack`` and gives one row (path, events) per file: a file's own frames are small."""

    @staticmethod
    def _lines(rows: Iterator[pd.DataFrame]) -> list[Line]:
        return [line for part in rows for lines in part["lines"] for line in pickle.loads(lines)]

    @staticmethod
    def _output(path: str, events: list[tuple]) -> pd.DataFrame:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, CHANGED) as writer:
            writer.write_batch(_batch_of(path, events))
        return pd.DataFrame({"path": [path], "events": [out.getvalue()]})


def typed(lines: DataFrame) -> DataFrame:
    """(path, ln, ...) rows of ``codex.marks`` in the shape that the state holds."""
    counters = lambda c: F.array(*[F.coalesce(F.col(f"{c}.{f}"), F.lit(0).cast("long")) for f in COUNTERS])
    return with_rfc3339(codex.marks(lines), "timestamp", "ts").select(
        "path", "ln", "timestamp", "ts", "is_tok", "is_meta", "meta_id", "meta_cwd",
        "turn_model", F.col("cur").isNotNull().alias("has_cur"), counters("cur").alias("cur"),
        F.col("last").isNotNull().alias("has_last"), counters("last").alias("last")).where(
        "is_tok OR is_meta OR turn_model IS NOT NULL")


def changes_of(lines: DataFrame) -> DataFrame:
    """The stream of changed events (CHANGES) of a stream of (path, ln, line) rows."""
    return typed(lines).mapInArrow(pack, "path string, lines binary").groupBy("path").transformWithStateInPandas(
        PackedProcessor(), "path string, events binary", outputMode="Update", timeMode="None").mapInArrow(unpack, CHANGES)


def start_decode(lines: DataFrame, state: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changed events of every micro-batch of a stream of (path, ln, line) rows to ``state``."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    writer = changes_of(lines).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _latest(changes: DataFrame) -> DataFrame:
    rest = [c for c in changes.columns if c not in ("path", "ln")]
    # The aggregate sorts; a hash in front decides most comparisons, as paths begin alike.
    newest = changes.groupBy(F.xxhash64("path", "ln").alias("__hash"), "path", "ln").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select("path", "ln", "r.*")


def current_events(spark: SparkSession, state: str) -> DataFrame:
    """The events of every file (USAGE columns plus path, ln): of each line, the latest batch counts."""
    return _latest(read_generations(spark, state, STORED)).where("live").select(*EVENTS)


def compact(spark: SparkSession, state: str) -> int | None:
    """Merge all batches so far into one generation without superseded rows; returns its last batch."""
    return compact_folder(spark, state, STORED, lambda changes: _latest(changes).where("live"))
