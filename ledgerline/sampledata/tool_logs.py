"""Raw tool logs derived from the driver's ``events`` table (test inputs for the decoders).

Each builder turns every event into the log shape of one tool - JSONL lines,
cumulative-counter JSONL, message-table rows or protobuf step blobs - and adds
the awkward cases the decoders must survive (duplicates, user/summary lines,
malformed JSON, bad timestamps, missing usage, counter resets, fallback
counters, incomplete rows, undecodable blobs). Which case an event gets is
decided by its ``event_id``; every event still produces its real record, so
decoder output is checked over the whole table.

All builders are DataFrame transformations (per-user windows order a user's
events for the counter files); the protobuf encoder is a small pandas UDF
used only to build test blobs.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import shuffles_removed, written
from ledgerline.sources.byte_ranges import store_of
from ledgerline.sources.eventlog import usage_from_events
from ledgerline.sources.listing import absolute

TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
BAD_TS = "2024-01-05 10:00:00"


def _ids(events: DataFrame) -> DataFrame:
    u = usage_from_events(events, with_ids=True)
    return u.withColumn("ts_text", F.date_format("event_ts", TS_TEXT))


def _lines(base: DataFrame, path: Column, variants: list[tuple[int, Column]], stride: int = 10) -> DataFrame:
    """Explode (sub, line-or-NULL) variants per row into (path, ln, line), ln = order * stride + sub."""
    arr = F.array(*[F.struct(F.lit(sub).alias("sub"), line.alias("line")) for sub, line in variants])
    return (
        base.select(path.alias("path"), F.col("order_key"), F.explode(arr).alias("v"))
        .filter(F.col("v.line").isNotNull())
        .select("path", (F.col("order_key") * stride + F.col("v.sub")).cast("bigint").alias("ln"),
                F.col("v.line").alias("line"))
    )


# ---------------------------------------------------------------- JSONL, per-request usage

def claude_lines(events: DataFrame) -> DataFrame:
    """(path, ln, line) JSONL lines: one assistant line per event plus noise."""
    u = _ids(events).withColumn("order_key", F.col("event_id"))
    e = F.col("event_id")
    es = e.cast("string")

    def assistant(ts_text: Column, model: Column, msg_id: Column) -> Column:
        return F.to_json(F.struct(
            F.lit("assistant").alias("type"),
            F.concat(F.lit("u"), es).alias("uuid"),
            F.col("session_id").alias("sessionId"),
            ts_text.alias("timestamp"),
            F.col("project").alias("cwd"),
            F.when(e % 9 != 0, F.concat(F.lit("req_"), es)).alias("requestId"),
            F.struct(
                msg_id.alias("id"),
                model.alias("model"),
                F.struct(
                    F.col("input").alias("input_tokens"),
                    F.col("output").alias("output_tokens"),
                    F.col("cache_write").alias("cache_creation_input_tokens"),
                    F.col("cache_read").alias("cache_read_input_tokens"),
                ).alias("usage"),
            ).alias("message"),
        ))

    main = assistant(F.col("ts_text"), F.col("model"), F.when(e % 10 != 0, F.concat(F.lit("msg_"), es)))
    user_line = F.concat(F.lit('{"type":"user","uuid":"uu'), es, F.lit('","message":{"role":"assistant"}}'))
    no_usage = F.to_json(F.struct(
        F.lit("assistant").alias("type"), F.col("ts_text").alias("timestamp"),
        F.struct(F.concat(F.lit("nu_"), es).alias("id"), F.col("model").alias("model")).alias("message"),
    ))
    wrong_type = F.concat(F.lit('{"type":"assistant","timestamp":"'), F.col("ts_text"),
                          F.lit('","message":{"id":"wt","model":"m","usage":{"input_tokens":"many"}}}'))
    variants = [
        (0, main),
        (1, F.when(e % 7 == 0, main)),
        (2, F.when(e % 5 == 0, user_line)),
        (3, F.when(e % 11 == 0, assistant(F.col("ts_text"), F.lit("<synthetic>"), F.concat(F.lit("syn_"), es)))),
        (4, F.when(e % 13 == 0, F.lit('{"type":"assistant","message":{"id":"x"'))),
        (5, F.when(e % 19 == 0, assistant(F.lit(BAD_TS), F.col("model"), F.concat(F.lit("bad_"), es)))),
        (6, F.when(e % 23 == 0, no_usage)),
        (7, F.when(e % 29 == 0, wrong_type)),
        (8, F.when(e % 31 == 0, F.lit('{"type":"summary","summary":"a summary line"}'))),
    ]
    path = F.concat(F.lit("/logs/claude/projects/-home-u-p"), (F.col("user_id") % 6).cast("string"), F.lit("/u"),
                    F.col("user_id").cast("string"), F.lit(".jsonl"))
    # Lines are distributed by file, as files spread over splits would be.
    return _lines(u, path, variants).repartition("path")


# ---------------------------------------------------------------- JSONL, cumulative counters

def codex_session_file(user: Column) -> Column:
    """File path whose last 36 name characters form a session id."""
    return F.concat(F.lit("/logs/codex/2024/01/01/rollout-2024-01-01T00-00-00-"),
                    F.format_string("%08d-0000-4000-8000-%012d", user, user), F.lit(".jsonl"))


def codex_lines(events: DataFrame) -> DataFrame:
    """(path, ln, line): one counter file per user, counters restarting every week."""
    u = _ids(events)
    by_user = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    week = F.floor((F.dayofmonth("event_ts") - 1) / 7)
    u = u.withColumn("week", week).withColumn("order_key", F.row_number().over(by_user)).withColumn(
        "prev_week", F.lag("week").over(by_user)
    )
    by_week = Window.partitionBy("user_id", "week").orderBy("event_ts", "event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for name, expr in {
        "c_in": F.col("input") + F.col("cache_read"),
        "c_cached": F.col("cache_read"),
        "c_out": F.col("output") + F.col("reasoning"),
        "c_reason": F.col("reasoning"),
    }.items():
        u = u.withColumn(name, F.sum(expr).over(by_week))
    u = u.withColumn("c_total", F.col("c_in") + F.col("c_out"))
    e, user = F.col("event_id"), F.col("user_id")

    def counters(i, c, o, r, t):
        return F.struct(i.alias("input_tokens"), c.alias("cached_input_tokens"), o.alias("output_tokens"),
                        r.alias("reasoning_output_tokens"), t.alias("total_tokens"))

    def token_line(ts_text: Column, info: Column) -> Column:
        return F.to_json(F.struct(ts_text.alias("timestamp"), F.lit("event_msg").alias("type"),
                                  F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))

    def meta_line(sid: Column) -> Column:
        return F.to_json(F.struct(F.col("ts_text").alias("timestamp"), F.lit("session_meta").alias("type"),
                                  F.struct(sid.alias("id"), F.col("project").alias("cwd")).alias("payload")))

    def turn_line(model: Column) -> Column:
        return F.to_json(F.struct(F.col("ts_text").alias("timestamp"), F.lit("turn_context").alias("type"),
                                  F.struct(model.alias("model")).alias("payload")))

    own = counters(F.col("input") + F.col("cache_read"), F.col("cache_read"), F.col("output") + F.col("reasoning"),
                   F.col("reasoning"), F.col("input") + F.col("cache_read") + F.col("output") + F.col("reasoning"))
    cum = counters(F.col("c_in"), F.col("c_cached"), F.col("c_out"), F.col("c_reason"), F.col("c_total"))
    zero = F.lit(0).cast("bigint")
    ts_or_bad = F.when(e % 19 == 0, F.lit(BAD_TS)).otherwise(F.col("ts_text"))
    main = token_line(ts_or_bad, F.struct(cum.alias("total_token_usage"), own.alias("last_token_usage")))
    week_changed = F.col("prev_week").isNotNull() & (F.col("week") != F.col("prev_week"))
    first = F.col("order_key") == 1
    variants = [
        # file header, written before the user's first event
        (-40, F.when(first, meta_line(F.when(user % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("sid-a-"), user.cast("string")))))),
        (-30, F.when(first, turn_line(F.col("model")))),
        (-20, F.when(first, F.lit('{"type":"response_item","payload":{"type":"message"}}'))),
        (-10, F.when(first, token_line(F.col("ts_text"), F.lit(None).cast("string")))),
        # counters drop to zero at a week change: a reset without session_meta
        (0, F.when(week_changed, token_line(F.col("ts_text"), F.struct(
            counters(zero, zero, zero, zero, zero).alias("total_token_usage"))))),
        (1, F.when((user % 4 == 0) & (F.col("week") >= 2) & (F.col("prev_week").isNull() | (F.col("prev_week") < 2)),
                   meta_line(F.concat(F.lit("sid-b-"), user.cast("string"))))),
        (2, F.when((user % 5 == 0) & week_changed, turn_line(F.lit("gpt-5")))),
        (3, main),
        (4, F.when(e % 7 == 0, main)),
        (5, F.when(e % 23 == 0, token_line(ts_or_bad, F.struct(counters(
            F.lit(7), F.lit(2), F.lit(5), F.lit(1), F.lit(12)).alias("last_token_usage"))))),
        (6, F.when(e % 17 == 0, F.concat(F.lit('{"timestamp":"'), F.col("ts_text"),
                                         F.lit('","type":"response_item","payload":{"text":"token_count"}}')))),
    ]
    return _lines(u, codex_session_file(user), variants, stride=100)


# ---------------------------------------------------------------- message table (JSON payload)

def opencode_messages(events: DataFrame) -> DataFrame:
    """(path, id, session_id, time_created, data): assistant rows plus user/incomplete/token-less rows."""
    u = _ids(events)
    e = F.col("event_id")
    es = e.cast("string")
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("event_ts"))
                 / 1000).cast("bigint")
    cost = F.coalesce(F.col("raw_cost"), F.when(e % 3 == 0, F.lit(0.0)))
    tokens = F.when(e % 13 != 0, F.struct(
        F.col("input").alias("input"), F.col("output").alias("output"), F.col("reasoning").alias("reasoning"),
        F.struct(F.col("cache_write").alias("write"), F.col("cache_read").alias("read")).alias("cache")))
    data = F.to_json(F.struct(
        F.lit("assistant").alias("role"), cost.alias("cost"), F.col("model").alias("modelID"),
        F.lit("provider").alias("providerID"), F.struct(F.col("project").alias("cwd")).alias("path"),
        tokens.alias("tokens"),
        F.struct(ms.alias("created"), F.when(e % 11 == 0, F.lit(0)).otherwise(ms + 1500).alias("completed")).alias("time"),
    ))
    user_data = F.to_json(F.struct(F.lit("user").alias("role"), F.struct(ms.alias("created")).alias("time")))
    path = F.concat(F.lit("/opencode/db"), (F.col("user_id") % 7).cast("string"), F.lit(".db"))
    rows = F.array(
        F.struct(F.concat(F.lit("msg_"), es).alias("id"), data.alias("data"), ms.alias("tc")),
        F.when(e % 5 == 0, F.struct(F.concat(F.lit("msg_u"), es).alias("id"), user_data.alias("data"),
                                    (ms - 700).alias("tc"))),
    )
    return (
        u.select(path.alias("path"), F.col("session_id"), F.explode(rows).alias("r"))
        .filter(F.col("r").isNotNull())
        .select("path", F.col("r.id").alias("id"), "session_id", F.col("r.tc").alias("time_created"),
                F.col("r.data").alias("data"))
        .repartition("path", "session_id")
    )


# ---------------------------------------------------------------- protobuf step tables

def _varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while True:
        b = v & 0x7F
        v >>= 7
        if v:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _vfield(num: int, v: int) -> bytes:
    return _varint(num << 3) + _varint(v)


def _bfield(num: int, data: bytes) -> bytes:
    return _varint(num << 3 | 2) + _varint(len(data)) + data


@F.pandas_udf(T.BinaryType())
def encode_step(secs: pd.Series, model_id: pd.Series, inp: pd.Series, out: pd.Series, cache: pd.Series,
                gen: pd.Series) -> pd.Series:
    blobs = []
    for s, m, i, o, c, g in zip(secs, model_id, inp, out, cache, gen):
        head = _bfield(1, _vfield(1, int(s))) if s is not None and not pd.isna(s) else b""
        if m is None or pd.isna(m):
            blobs.append(head)
            continue
        usage = _vfield(1, int(m)) + _vfield(2, int(i)) + _vfield(3, int(o))
        if int(c) > 0:
            usage += _vfield(5, int(c))
        if g:
            usage += _bfield(11, g.encode())
        blobs.append(head + _bfield(9, usage))
    return pd.Series(blobs)


@F.pandas_udf(T.BinaryType())
def encode_name(model_id: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_bfield(3, _bfield(15, _vfield(1, int(m))) + _bfield(28, n.encode()))
                      for m, n in zip(model_id, name)])


@F.pandas_udf(T.BinaryType())
def encode_uri(uri: pd.Series) -> pd.Series:
    return pd.Series([_bfield(1, _bfield(1, x.encode())) for x in uri])


UNMAPPED_MODEL_ID = 9999


def antigravity_model_id(user: Column) -> Column:
    return F.when(user % 12 == 11, F.lit(UNMAPPED_MODEL_ID)).otherwise(user % 12 + 1000).cast("bigint")


def antigravity_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, gen_metadata, trajectory) for one conversation database per user."""
    u = _ids(events)
    by_user = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    u = u.withColumn("rn", F.row_number().over(by_user))
    e, user = F.col("event_id"), F.col("user_id")
    path = F.concat(F.lit("/antigravity/conversations/u"), user.cast("string"), F.lit(".db"))
    secs = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
    mid = antigravity_model_id(user)
    gen = F.when(e % 10 != 0, F.concat(F.lit("gen-"), e.cast("string"))).otherwise(F.lit(""))
    none = F.lit(None).cast("bigint")
    # Every event gets its real step; noise steps are added for some events
    # only (each variant encoded just for the rows that carry it).
    garbage = F.lit(bytes([0xFF, 0xFF, 0xFF])).cast("binary")

    def variant(rows, sub, blob):
        # Generate keeps the encoder evaluated once even when filters on
        # ``metadata`` are pushed towards this projection.
        return rows.select(path.alias("path"), (F.col("rn") * 4 + F.lit(sub)).cast("bigint").alias("idx"),
                           F.inline(F.array(F.struct(blob.alias("metadata")))))

    steps = (
        variant(u, 0, encode_step(secs, mid, "input", "output", "cache_read", gen))
        .unionByName(variant(u.filter(e % 13 == 0), 1, garbage))
        .unionByName(variant(u.filter(e % 11 == 0), 2,
                             encode_step(secs, mid, F.lit(0), F.lit(0), F.lit(0), F.lit("zero"))))
        .unionByName(variant(u.filter(e % 17 == 0), 3,
                             encode_step(none, mid, "input", "output", "cache_read", F.lit("nots"))))
    )
    per_db = u.groupBy("user_id").agg(F.min("event_ts").alias("first_ts"), F.first("project").alias("project"),
                                      F.first("model").alias("model"))
    db = F.concat(F.lit("/antigravity/conversations/u"), F.col("user_id").cast("string"), F.lit(".db"))
    header = per_db.select(db.alias("path"), F.lit(0).cast("bigint").alias("idx"),
                           encode_step(F.lit(1704067200), F.lit(None).cast("bigint"), F.lit(0), F.lit(0), F.lit(0),
                                       F.lit("")).alias("metadata"))
    gen_meta = per_db.filter(F.col("user_id") % 12 != 11).select(
        db.alias("path"), F.lit(1).cast("bigint").alias("idx"),
        encode_name(antigravity_model_id(F.col("user_id")), F.col("model")).alias("data"))
    traj = per_db.select(db.alias("path"), F.lit(0).cast("bigint").alias("ord"),
                         encode_uri(F.concat(F.lit("file://"), F.col("project"))).alias("data"))
    return steps.unionByName(header), gen_meta, traj


# ---------------------------------------------------------------- log files that land

# Folders that landed files are dealt to, and bytes that a task holds before it writes them.
FOLDERS = 64
HELD = 4 << 20


def land_lines(lines: DataFrame, landing: str) -> int:
    """Add (path, ln, line) rows as one text file per source path, one folder below ``landing``; returns their number.

    Tasks write the files where they stay, so the driver lists and renames none of them. A task that runs again
    writes the same bytes; another call adds other files.
    """
    root, tag = absolute(lines.sparkSession, landing), uuid.uuid4().hex[:12]
    store, top = store_of(root)
    store.create_dir(top, recursive=True)

    def write(batches):
        name, out, held, size, files, made = None, None, [], 0, 0, set()
        for batch in batches:
            for path, line in zip(batch["path"].to_pylist(), batch["line"].to_pylist()):
                if out is None or path != name:
                    if out is not None:
                        out.write(b"".join(held))
                        out.close()
                    label = "null" if path is None else quote(path, safe="")
                    folder = f"{root}/{zlib.crc32(label.encode()) % FOLDERS:02d}"
                    store, target = store_of(folder)
                    if folder not in made:
                        store.create_dir(target, recursive=True)
                        made.add(folder)
                    name, out, held, size, files = path, store.open_output_stream(f"{target}/{label}-{tag}.txt"), [], 0, files + 1
                held.append(f"{line or ''}\n".encode())
                size += len(held[-1])
                if size >= HELD:
                    out.write(b"".join(held))
                    held, size = [], 0
        if out is not None:
            out.write(b"".join(held))
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    ordered = lines.repartition("path").sortWithinPartitions("path", "ln").select("path", "line")
    with shuffles_removed(lines.sparkSession):
        return ordered.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


# ---------------------------------------------------------------- log files that grow

# Bytes of a line that was not written to its end.
TORN = 20


def write_files(lines: DataFrame, root: str) -> DataFrame:
    """Write (path, ln, line, torn) rows as files below ``root``, whole; a torn last line is its first bytes only.

    Returns (path, size). A task that runs again writes the same bytes.
    """
    def write(batches):
        name, out = None, None
        for batch in batches:
            for path, line, torn in zip(*[batch[c].to_pylist() for c in ("path", "line", "torn")]):
                if path != name:
                    if out is not None:
                        out.close()
                    store, target = store_of(f"{root}{path}")
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    name, out = path, store.open_output_stream(target)
                out.write(line.encode()[:TORN] if torn else line.encode() + b"\n")
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]})

    ordered = lines.repartition("path").sortWithinPartitions("path", "ln").select("path", "line", "torn")
    return written(ordered.mapInArrow(write, "path string, size long"), "grown-files")


def grown(lines: DataFrame, part: int) -> DataFrame:
    """The state of log files at the time ``part`` (1 to 3), as (path, ln, line, torn).

    1: the lines up to a third of the last number, and the first bytes of the
    next line; 2: those up to two thirds; 3: all lines, but files of every
    fifth user were cut and hold the last tenth only.
    """
    last = lines.groupBy("path").agg(F.max("ln").alias("last"))
    marked = lines.join(last, "path").withColumn("torn", F.lit(False))
    ln, top = F.col("ln"), F.col("last")
    if part == 1:
        after = marked.where(ln * 3 > top)
        following = after.groupBy("path").agg(F.min_by(F.struct("ln", "line"), "ln").alias("r")).select("path", "r.*")
        kept = marked.where(ln * 3 <= top).select("path", "ln", "line", "torn").unionByName(
            following.withColumn("torn", F.lit(True)))
    elif part == 2:
        kept = marked.where(ln * 3 <= top * 2)
    else:
        cut = F.regexp_extract("path", r"/u([0-9]+)\.jsonl$", 1).cast("bigint") % 5 == 0
        kept = marked.where(~cut | (ln * 10 > top * 9))
    return kept.select("path", "ln", "line", "torn")
