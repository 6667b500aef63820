"""Streaming ingest: re-delivered files insert nothing (exactly-once effect through the idempotent load)."""

import json
import os

from test_decoders import CLAUDE_LINES

from ledgerline.sources import claude
from ledgerline.streaming.ingest import start_dedup, start_ingest


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in lines) + "\n")


def test_replayed_delivery_inserts_nothing(spark, scratch):
    landing, table = f"{scratch}/landing", f"{scratch}/usage"
    land(landing, "a.jsonl", CLAUDE_LINES)
    start_ingest(spark, landing, claude.decode, table, f"{scratch}/ck1", available_now=True).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    # a fresh checkpoint re-delivers every file: the load's anti join makes it a no-op
    start_ingest(spark, landing, claude.decode, table, f"{scratch}/ck2", available_now=True).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    more = [dict(CLAUDE_LINES[5], uuid="k-9", requestId="r-nine", message=dict(CLAUDE_LINES[5]["message"], id="m-nine"))]
    land(landing, "b.jsonl", more)
    start_ingest(spark, landing, claude.decode, table, f"{scratch}/ck2", available_now=True).awaitTermination()
    assert spark.read.parquet(table).count() == 3


def test_stream_dedup_keeps_one_row_per_key(spark, scratch):
    landing, out = f"{scratch}/landing", f"{scratch}/out"
    land(landing, "a.jsonl", CLAUDE_LINES)
    land(landing, "b.jsonl", CLAUDE_LINES)
    start_dedup(spark, landing, claude.decode, out, f"{scratch}/ck").awaitTermination()
    keys = [r.dedup_key for r in spark.read.parquet(out).collect()]
    assert sorted(keys) == ["m-alpha:r-one", "m-beta:r-two"]


def test_the_offsets_of_a_stream_dedup_do_not_name_its_files(spark, scratch):
    landing, out, ckpt = f"{scratch}/landing", f"{scratch}/out", f"{scratch}/ck"
    for i in range(20):
        land(f"{landing}/{i % 3}", f"{i}.jsonl", [dict(CLAUDE_LINES[5], uuid=f"k-{i}", message=dict(
            CLAUDE_LINES[5]["message"], id=f"m-{i // 2}"))])
    with open(f"{landing}/2/last.jsonl", "w") as f:  # without a line end
        f.write(json.dumps(dict(CLAUDE_LINES[5], message=dict(CLAUDE_LINES[5]["message"], id="m-last"))))
    land(landing, "_hidden.jsonl", [dict(CLAUDE_LINES[5], message=dict(CLAUDE_LINES[5]["message"], id="m-hidden"))])
    for n in (11, 12):
        start_dedup(spark, landing, claude.decode, out, ckpt).awaitTermination()
        keys = [r.dedup_key.split(":")[0] for r in spark.read.parquet(out).collect()]
        assert len(keys) == n and set(keys) >= {"m-last", *(f"m-{i}" for i in range(10))}
        land(landing, "new.jsonl", [dict(CLAUDE_LINES[5], message=dict(CLAUDE_LINES[5]["message"], id=f"m-{i}")) for i in (3, 99)])
    for name in os.listdir(f"{ckpt}/offsets"):
        with open(f"{ckpt}/offsets/{name}", "rb") as f:
            assert b".jsonl" not in f.read()
    assert not os.path.exists(f"{ckpt}/sources")  # where Spark's file source notes each file


def test_daily_rollup_keeps_data_of_any_lateness(spark, scratch):
    from datetime import datetime

    from conftest import usage_rows
    from ledgerline.streaming.rollup import compact, current_rollup, start_daily

    landing, sums = f"{scratch}/landing", f"{scratch}/sums"
    days = [datetime(2025, 11, 20), datetime(2024, 1, 1), datetime(2025, 11, 20), datetime(2020, 6, 5)]
    for i, day in enumerate(days):
        usage_rows(spark, [dict(source="codex", dedup_key=f"k{i}", ts=day, input=10 ** i)]).write.parquet(f"{landing}/p={i}")
        start_daily(spark, landing, sums, f"{scratch}/ck").awaitTermination()
        if i in (1, 2):
            assert compact(spark, sums) == i
    assert sorted(x for x in os.listdir(sums) if "=" in x) == ["batch=2", "batch=3", "gen=1", "gen=2"]
    got = sorted((r.day, r.total, r.events) for r in current_rollup(spark, sums).collect())
    assert got == [("2020-06-05", 1000, 1), ("2024-01-01", 10, 1), ("2025-11-20", 101, 2)]


def counter_lines(seed, n, chunk_gap):
    """Typed lines of a counter log with session lines, resets, fallbacks, bad times and lines without a model."""
    import random

    import pandas as pd

    rng, total, rows = random.Random(seed), [0] * 5, []
    for i in range(n):
        kind = rng.random()
        row = dict(ln=i * chunk_gap, timestamp=f"t{i}", ts=pd.Timestamp("2025-11-20") if rng.random() > 0.1 else pd.NaT,
                   is_tok=False, is_meta=False, meta_id=None, meta_cwd=None, turn_model=None, has_cur=False, cur=[0] * 5,
                   has_last=False, last=[0] * 5)
        if kind < 0.05:
            row.update(is_meta=True, meta_id=rng.choice([None, f"s{i}"]), meta_cwd=rng.choice([None, f"/w{i}"]))
        elif kind < 0.15:
            row.update(turn_model=f"m{i}")
        else:
            step = [rng.randrange(50) for _ in range(4)]
            own = [*step, step[0] + step[2]]
            total = own if rng.random() < 0.1 else [a + b for a, b in zip(total, own)]
            row.update(is_tok=True, has_cur=rng.random() > 0.2, cur=list(total), has_last=True, last=own)
        rows.append(row)
    return pd.DataFrame(rows)


def test_replay_in_parts_is_replay_of_the_whole():
    from ledgerline.streaming.counters import Carry, replay

    for seed in range(20):
        rows = counter_lines(seed, 60, 1)
        whole, after = replay(rows, Carry(), "file")
        carry, parts = Carry(), []
        for start in range(0, 60, 1 + seed % 7):
            events, carry = replay(rows.iloc[start:start + 1 + seed % 7].reset_index(drop=True), carry, "file")
            parts.append(events)
        import pandas as pd

        got = pd.concat([p for p in parts if len(p)], ignore_index=True)
        live = whole["live"].to_numpy()
        assert live.sum() > 5 and (got["live"].to_numpy() == live).all() and carry == after
        columns = ["ln", "dedup_key", "model", "session_id", "project", "input", "output", "cache_read", "reasoning"]
        assert got[columns][live].to_numpy().tolist() == whole[columns][live].to_numpy().tolist()


class Kept:
    """A state of the store, in memory, that counts what is read."""

    def __init__(self):
        self.held, self.read = {}, 0

    def getValue(self, key):
        self.read += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def keys(self):
        return iter(list(self.held))

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value


def test_an_append_reads_the_last_chunk_and_a_late_line_those_from_its_own():
    from ledgerline.streaming import counters

    rows = counter_lines(5, 400, counters.CHUNK // 20)  # 20 lines a chunk
    rows["path"] = "/a/run.jsonl"
    processor = counters.CounterProcessor()
    processor.chunks, processor.after = Kept(), Kept()
    late = rows.index[150:152]
    seen = {}

    def batch(part):
        processor.chunks.read = 0
        for out in processor.handleInputRows(("/a/run.jsonl",), iter([part]), None):
            seen.update({r["ln"]: tuple(r[c] for c in counters.EVENTS if c != "ts") if r["live"] else None
                         for r in out.to_dict("records")})
        return processor.chunks.read

    early = rows.drop(late)
    assert batch(early.iloc[:300]) == 0
    assert batch(early.iloc[300:397]) <= 1
    assert batch(early.iloc[397:]) <= 1
    assert batch(early.iloc[-5:]) <= 1  # again
    chunks = len(processor.chunks.held)
    assert batch(rows.loc[late]) <= chunks - 7  # those from the late lines' chunk on
    once = counters.CounterProcessor()
    once.chunks, once.after = Kept(), Kept()
    want = {}
    for out in once.handleInputRows(("/a/run.jsonl",), iter([rows]), None):
        want = {r["ln"]: tuple(r[c] for c in counters.EVENTS if c != "ts") for r in out.to_dict("records") if r["live"]}
    same = lambda found: {k: str(v) for k, v in found.items() if v is not None}
    assert same(seen) == same(want) and len(want) > 100


def test_files_come_to_the_state_and_leave_it_packed():
    import pandas as pd
    import pyarrow as pa

    from ledgerline.streaming import counters

    files = {f"/a/{i}.jsonl": counter_lines(i, 40, 300) for i in range(3)}
    rows = pd.concat([rows.assign(path=path) for path, rows in files.items()]).sort_values("ln", ignore_index=True)
    whole = pa.RecordBatch.from_pandas(rows.assign(ts=rows["ts"].astype("datetime64[us]")), preserve_index=False)
    packed = pa.Table.from_batches(counters.pack(iter([whole.slice(0, 70), whole.slice(70), whole.slice(0, 0)]))).to_pandas()
    assert len(packed) == 6  # one row per file and batch
    for path, lines in files.items():
        found = []
        for kind, parts in ((counters.PackedProcessor, packed[packed["path"] == path]), (counters.CounterProcessor, lines)):
            processor = kind()
            processor.chunks, processor.after = Kept(), Kept()
            out, = processor.handleInputRows((path,), iter([parts.iloc[:1], parts.iloc[1:]]), None)
            if kind is counters.PackedProcessor:
                assert out.columns.tolist() == ["path", "events"] and len(out) == 1
                out = pa.Table.from_batches(counters.unpack(iter([pa.RecordBatch.from_pandas(out)]))).to_pandas()
            found.append((out.astype(str).values.tolist(), processor.chunks.held, processor.after.held))
        assert found[0] == found[1] and len(found[0][0]) > 20
    # A checkpoint of before has a chunk's lines as an Arrow stream.
    lines = files["/a/0.jsonl"]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, (table := pa.Table.from_pandas(lines, preserve_index=False)).schema) as writer:
        writer.write_table(table)
    assert counters._stored(out.getvalue().to_pybytes()) == counters._lines_of(lines)
