"""Token ids in files of interleaved static range-ANS blocks.

Documents are range-partitioned by doc_id and sorted; each task encodes its run of
documents into files of at most about ``FILE_TOKENS`` ids. A file has one frequency
table, counted over its own ids and shared by all of its blocks, and an index
of blocks at its end:

    magic | table | block | block | ... | index | index offset, crc32 | magic

A block is whole documents with ``BLOCK_TOKENS`` ids or a little more. Its ids are dealt to
``LANES`` interleaved coders: lane j of step t codes id t * LANES + j, with a
64-bit state that sheds 32-bit words into one stream, which the decoder reads
forward. Every ``CHECKPOINT_STEPS`` steps the block stores all states and the
place in the stream, so decoding can begin there: blocks, and runs between
checkpoints, decode in parallel. Table, index and block have checksums, and a
block also that of its decoded ids.

Files are written beside their final name and renamed, and hold the same bytes whenever a
task is run again, so lost executors leave no half file. A table of the files
(one small row each) lies in the same folder. ``start`` of a document follows from
the files before it; only that table goes through one task.

Defined results: a null text is empty and has the end id alone. Rows go by
doc_id, null first, repeated ids by a hash of their text and then by the text. An empty
table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of
from ledgerline.llm.tokens import encoder, tokenizer_path
from ledgerline.session import scratch_path

MAGIC = b"LLRANS1\n"
SCALE_BITS = 18
LANES = 1024
CHECKPOINT_STEPS = 256
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23
END_ID = 2
# Pieces whose ids a writing worker keeps (about 250 MB).
KEPT_PIECES = 1_000_000
# Blocks that one task decodes.
TASK_BLOCKS = 16
LOW = 1 << 32  # states stay in [2^32, 2^64)

_BLOCK = struct.Struct("<IIQQI")  # documents, lanes, ids, words, crc32 of the ids
_ENTRY = struct.Struct("<QQQQ")  # offset, bytes, documents, ids before it in the file
_TAIL = struct.Struct("<QI")


class CorruptFile(ValueError):
    """A checksum does not match."""


@dataclass
class Table:
    """Symbols of a file with their frequencies, which sum to 2 ** SCALE_BITS - 1."""

    symbols: np.ndarray
    freqs: np.ndarray

    def __post_init__(self):
        self.cums = np.concatenate([[0], np.cumsum(self.freqs)]).astype(np.uint64)
        self.wide = self.freqs.astype(np.uint64)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        symbols = np.flatnonzero(counts)
        space = (1 << SCALE_BITS) - 1  # one slot stays free, so that no frequency fills the scale
        if len(symbols) > space:
            raise ValueError("more symbols than slots")
        seen = counts[symbols].astype(np.float64)
        freqs = 1 + np.floor(seen * ((space - len(symbols)) / max(seen.sum(), 1.0))).astype(np.int64)
        if len(symbols):
            freqs[int(np.argmax(freqs))] += space - int(freqs.sum())
        return cls(symbols.astype("<u4"), freqs.astype("<u4"))

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", SCALE_BITS, len(self.symbols)) + self.symbols.tobytes() + self.freqs.tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        bits, n = struct.unpack_from("<II", raw)
        if len(raw) != 12 + 8 * n or zlib.crc32(raw[:-4]) != struct.unpack_from("<I", raw, len(raw) - 4)[0]:
            raise CorruptFile("frequency table")
        if bits != SCALE_BITS:
            raise ValueError(f"scale of {bits} bits")
        return cls(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u4", n, 8 + 4 * n))

    def place_of(self) -> np.ndarray:
        """Index of each symbol, by id."""
        place = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, dtype=np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place

    def slots(self) -> np.ndarray:
        """Index of the symbol that holds each slot of the scale."""
        return np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs)


def encode_stream(places: np.ndarray, table: Table, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, states at the checkpoints, words read before each): the interleaved code of symbol indexes."""
    n = len(places)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    freqs, cums = table.wide[places], table.cums[places]
    scale, down, shed = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(64 - SCALE_BITS)
    chunks, saved = [], []
    for t in range(steps - 1, -1, -1):
        part = slice(t * lanes, min(n, (t + 1) * lanes))
        f = freqs[part]
        x = state[:len(f)]
        over = x >= (f << shed)
        chunks.append(x[over].astype(np.uint32))  # the low 32 bits
        x = np.where(over, x >> down, x)
        whole = x // f
        state[:len(f)] = (whole << scale) + (x - whole * f) + cums[part]
        if t % CHECKPOINT_STEPS == 0:
            saved.append((t, state.copy()))
    chunks.reverse()
    saved.reverse()
    read = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    words = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
    states = np.array([s for _, s in saved], dtype=np.uint64).reshape(len(saved), lanes)
    return words.astype("<u4"), states.astype("<u8"), np.array([read[t] for t, _ in saved], dtype="<u8")


def decode_run(words: np.ndarray, state: np.ndarray, at: int, count: int, table: Table,
               slots: np.ndarray) -> np.ndarray:
    """Symbol indexes of ``count`` ids from a checkpoint on, given its states and its place in the words."""
    lanes = len(state)
    out = np.empty(count, dtype=np.uint32)
    state = state.astype(np.uint64)
    mask, scale, down = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    low = np.uint64(LOW)
    for begin in range(0, count, lanes):
        k = min(lanes, count - begin)
        x = state[:k]
        slot = x & mask
        symbol = slots[slot]
        out[begin:begin + k] = symbol
        x = table.wide[symbol] * (x >> scale) + slot - table.cums[symbol]
        need = x < low
        got = int(np.count_nonzero(need))
        if got:
            x[need] = (x[need] << down) | words[at:at + got]
            at += got
        state[:k] = x
    return out


def encode_block(doc_ids: list[int | None], runs: list[bytes], table: Table, place: np.ndarray,
                 lanes: int = LANES) -> bytes:
    """One independent block: the ids of whole documents."""
    raw = b"".join(runs)
    ids = np.frombuffer(raw, "<u4")
    lanes = max(1, min(lanes, len(ids)))
    words, states, read = encode_stream(place[ids], table, lanes)
    head = _BLOCK.pack(len(doc_ids), lanes, len(ids), len(words), zlib.crc32(raw))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    sizes = np.array([len(r) // 4 for r in runs], dtype="<u8")
    body = b"".join((head, known.tobytes(), numbers.tobytes(), sizes.tobytes(), read.tobytes(), states.tobytes(),
                     words.tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(raw: bytes, table: Table, slots: np.ndarray) -> tuple[list[int | None], list[bytes]]:
    """Documents and their ids of one block, run by run between the checkpoints."""
    if len(raw) < _BLOCK.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack_from("<I", raw, len(raw) - 4)[0]:
        raise CorruptFile("block")
    docs, lanes, n, n_words, crc = _BLOCK.unpack_from(raw)
    steps = -(-n // lanes)
    marks, at = -(-steps // CHECKPOINT_STEPS), _BLOCK.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, count, at)
        at += got.nbytes
        return got

    known, numbers, sizes = take("u1", docs), take("<i8", docs), take("<u8", docs)
    read, states = take("<u8", marks), take("<u8", marks * lanes).reshape(marks, lanes)
    words = take("<u4", n_words).astype(np.uint64)
    span = CHECKPOINT_STEPS * lanes
    runs = [decode_run(words, states[m], int(read[m]), min(span, n - m * span), table, slots)
            for m in range(marks)]
    ids = table.symbols[np.concatenate(runs)].tobytes() if runs else b""
    if zlib.crc32(ids) != crc:
        raise CorruptFile("ids of a block")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(int) * 4
    return ([int(d) if k else None for d, k in zip(numbers, known, strict=True)],
            [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])


def file_bytes(doc_ids: list[int | None], runs: list[bytes]) -> tuple[bytes, int]:
    """A whole file of documents in their order, and its number of blocks."""
    counts = np.zeros(1, dtype=np.int64)
    blocks: list[tuple[int, int]] = []
    first = n = 0
    for i, run in enumerate(runs):
        n += len(run) // 4
        if n >= BLOCK_TOKENS or i == len(runs) - 1:
            blocks.append((first, i + 1))
            first, n = i + 1, 0
    for a, b in blocks:
        part = np.bincount(np.frombuffer(b"".join(runs[a:b]), "<u4"))
        if len(part) > len(counts):
            counts = np.pad(counts, (0, len(part) - len(counts)))
        counts[:len(part)] += part
    table = Table.of(counts)
    place, head = table.place_of(), table.to_bytes()
    out = [MAGIC, struct.pack("<I", len(head)), head]
    at, before, index = len(MAGIC) + 4 + len(head), 0, []
    for a, b in blocks:
        block = encode_block(doc_ids[a:b], runs[a:b], table, place)
        index.append(_ENTRY.pack(at, len(block), b - a, before))
        out.append(block)
        at, before = at + len(block), before + sum(len(r) for r in runs[a:b]) // 4
    entries = b"".join(index)
    return b"".join((*out, entries, _TAIL.pack(at, zlib.crc32(entries)), MAGIC)), len(blocks)


class TokenFile:
    """Reads parts of a file: its table and index once, then any block."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        tail = self._at(size - len(MAGIC) - _TAIL.size, len(MAGIC) + _TAIL.size)
        begin, crc = _TAIL.unpack_from(tail)
        entries = self._at(begin, size - len(tail) - begin)
        if tail[_TAIL.size:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC or zlib.crc32(entries) != crc:
            raise CorruptFile("index")
        self.index = [_ENTRY.unpack_from(entries, i) for i in range(0, len(entries), _ENTRY.size)]
        length = struct.unpack("<I", self._at(len(MAGIC), 4))[0]
        self.table = Table.from_bytes(self._at(len(MAGIC) + 4, length))
        self.slots = self.table.slots()

    def _at(self, offset: int, length: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(length)

    def block(self, k: int) -> tuple[list[int | None], list[bytes], int]:
        """Documents, their ids, and the ids before them in the file."""
        offset, length, _, before = self.index[k]
        return *decode_block(self._at(offset, length), self.table, self.slots), before


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder)


def _writer(folder: str, path: str, end_id: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, at = _file_system(folder)
        encode, end = encoder(path, KEPT_PIECES).encode, np.asarray([end_id], dtype="<u4").tobytes()
        ids, runs, n, number = [], [], 0, 0

        def flush():
            raw, blocks = file_bytes(ids, runs)
            name = f"part-{part:06d}-{number:04d}.llrans"
            draft = f"{at}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(raw)
            if store.get_file_info(f"{at}/{name}").is_file:  # by an attempt whose executor was lost: the same bytes
                store.delete_file(draft)
            else:
                store.move(draft, f"{at}/{name}")
            return pa.RecordBatch.from_pydict(
                {"file": [name], "part": [part], "number": [number], "documents": [len(ids)], "tokens": [n],
                 "blocks": [blocks]},
                schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()),
                                  ("documents", pa.int64()), ("tokens", pa.int64()), ("blocks", pa.int64())]))

        for batch in batches:
            texts = encode(batch.column("text").to_pylist())
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                run = found + end
                ids.append(doc_id)
                runs.append(run)
                n += len(run) // 4
                if n >= FILE_TOKENS:
                    yield flush()
                    ids, runs, n, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return write


def write_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> str:
    """Write the ids of all documents, by ascending doc_id; the folder."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "llrans")
    store, at = _file_system(folder)
    store.create_dir(at, recursive=True)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h"))
    made = rows.mapInArrow(_writer(folder, path or tokenizer_path(), end_id),
                           "file string, part long, number long, documents long, tokens long, blocks long")
    made.write.parquet(f"{folder}/files")
    return folder


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa

        store, at = _file_system(folder)
        name, file = None, None
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], TokenFile(store.open_input_file(f"{at}/{row['file']}"))
                ids, runs, before = file.block(row["block"])
                sizes = [len(r) // 4 for r in runs]
                starts = row["base"] + before + np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(runs, pa.binary())], schema=schema)

    return read


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the folder's files."""
    files = spark.read.schema("file string, part long, number long, documents long, tokens long, blocks long").parquet(
        f"{folder}/files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file", "blocks", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    blocks = files.select("file", "base", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    tasks = max(1, -(-(files.agg(F.sum("blocks")).first()[0] or 0) // TASK_BLOCKS))
    # Blocks of a file stay together where they can: its table is read once for them.
    return blocks.repartitionByRange(tasks, "file", "block").mapInArrow(
        _reader(folder), "doc_id long, start long, n_tokens long, ids binary")
