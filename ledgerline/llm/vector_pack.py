"""Packing examples into token sequences by vector bin packing.

A sequence has three limits at once: tokens, segments (pieces of examples) and
loss-bearing tokens. Examples are dealt by a hash of their id and text to shards of
about ``SHARD_EXAMPLES`` examples and no more than about ``SHARD_BYTES`` of text; a
shard is packed on its own, so the work spreads by rows whatever their ids or
sources are, and nothing but one shard is in a task's memory. In a shard

1. as long as an example exceeds what an empty sequence can hold, that much of
   it becomes a sequence of its own;
2. of what is left, one sequence after the other is filled: the piece that
   fits and has the largest dot product of its (tokens, segments, loss tokens)
   with what the sequence has left of them, each as a share of its limit, goes
   in, until no piece fits;
3. the longest piece is then cut to fill the rest, so only the last sequence
   of a shard, and those that met another limit first, have padding.

Defined results: a null text is empty; an example of no text still has its end
id. Repeated rows are examples of their own. An empty table gives no rows. Ids
of sequences follow from the shard and do not depend on the cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of
from ledgerline.llm.tokens import encoder, tokenizer_path

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 256
MAX_LOSS_TOKENS = 2048
SHARD_EXAMPLES = 1024
SHARD_BYTES = 8 << 20
END_ID = 1

Piece = tuple[int, int, int, int, int]  # example, start, length, sequence, offset


def pack_vectors(loss: list[np.ndarray], limits: tuple[int, int, int]) -> list[Piece]:
    """Pieces of examples, each given as the running count of its loss tokens (0 first).

    ``loss[i]`` has one entry more than example ``i`` has tokens.
    """
    tokens_max, segments_max, loss_max = limits
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")
    pieces: list[Piece] = []
    sequence = 0

    def longest(i: int, at: int, room: int, loss_room: int) -> int:
        """Tokens from ``at`` on that fit into the room."""
        end = int(np.searchsorted(loss[i], loss[i][at] + loss_room, side="right")) - 1
        return min(room, end - at, len(loss[i]) - 1 - at)

    start = np.zeros(len(loss), dtype=np.int64)
    for i, run in enumerate(loss):
        at, n = 0, len(run) - 1
        while n - at >= tokens_max or run[n] - run[at] > loss_max:
            length = longest(i, at, tokens_max, loss_max)
            pieces.append((i, at, length, sequence, 0))
            at, sequence = at + length, sequence + 1
        start[i] = at
    size = np.array([len(run) - 1 for run in loss], dtype=np.int64) - start
    bearing = np.array([int(run[-1] - run[at]) for run, at in zip(loss, start, strict=True)], dtype=np.int64)
    open_ = size > 0
    while open_.any():
        room, segments, loss_room, offset = tokens_max, segments_max, loss_max, 0
        while room and segments:
            fits = open_ & (size <= room) & (bearing <= loss_room)
            if fits.any():
                dot = (size * (room / tokens_max**2) + segments / segments_max**2
                       + bearing * (loss_room / loss_max**2))
                i = int(np.argmax(np.where(fits, dot, -1.0)))
                length = int(size[i])
            else:
                i = int(np.argmax(np.where(open_, size, -1)))
                length = longest(i, int(start[i]), room, loss_room) if open_[i] else 0
                if length <= 0:
                    break
            pieces.append((i, int(start[i]), length, sequence, offset))
            used = int(loss[i][start[i] + length] - loss[i][start[i]])
            room, segments, loss_room, offset = room - length, segments - 1, loss_room - used, offset + length
            start[i] += length
            size[i] -= length
            bearing[i] -= used
            open_[i] = size[i] > 0
        sequence += 1
    return pieces


def _packer(path: str, end_id: int, limits: tuple[int, int, int]):
    def pack(key, table):
        import pyarrow as pa

        rows = sorted(zip(table["example"].to_pylist(), table["parts"].to_pylist(), strict=True),
                      key=lambda r: (r[0] is None, r[0] or 0, [(p["text"], p["loss"]) for p in r[1]]))
        encode, end = encoder(path).encode, np.asarray([end_id], dtype="<u4").tobytes()
        ids, loss = [], []
        encoded = iter(encode([p["text"] for _, parts in rows for p in parts]))
        for _, parts in rows:
            runs = [next(encoded) for _ in parts]
            ids.append(b"".join(runs) + end)
            flags = np.repeat([p["loss"] for p in parts] + [True], [len(r) // 4 for r in runs] + [1])
            loss.append(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
        pieces = pack_vectors(loss, limits)
        shard = key[0].as_py() << 32
        column = list(zip(*pieces, strict=True)) or [[]] * 5
        long = lambda values: pa.array([int(v) for v in values], pa.int64())
        return pa.table({
            "example": pa.array([rows[i][0] for i in column[0]], pa.int64()),
            "start": long(column[1]), "length": long(column[2]),
            "example_tokens": long(len(ids[i]) // 4 for i in column[0]),
            "loss_tokens": long(loss[i][s + n] - loss[i][s] for i, s, n, _, _ in pieces),
            "sequence_id": long(shard + s for s in column[3]), "offset": long(column[4]),
            "ids": pa.array([ids[i][4 * s:4 * (s + n)] for i, s, n, _, _ in pieces], pa.binary()),
        })

    return pack


def pack_examples(examples: DataFrame, example: Column, parts: Column, path: str | None = None, end_id: int = END_ID, tokens: int = SEQUENCE_TOKENS,
                  segments: int = MAX_SEGMENTS, loss_tokens: int = MAX_LOSS_TOKENS) -> DataFrame:
    """One row per piece: example, start, length, example_tokens, loss_tokens, sequence_id, offset, ids.

    ``parts`` is an array of (text, loss) structs in order; the end id of an example bears
    loss. ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    """
    dealt = examples.select(example.cast("long").alias("example"), parts.alias("parts"))
    size = F.octet_length(F.array_join("parts.text", ""))
    rows, volume = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, -(-rows // SHARD_EXAMPLES), -(-volume // SHARD_BYTES))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("example", F.element_at("parts.text", 1)), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        _packer(path or tokenizer_path(), end_id, (tokens, segments, loss_tokens)),
        "example long, start long, length long, example_tokens long, loss_tokens long, sequence_id long, "
        "offset long, ids binary")


def pack_documents(docs: DataFrame, **limits) -> DataFrame:
    """``pack_examples`` of whole texts, all of whose tokens bear loss."""
    parts = F.array(F.struct(text_of(docs).alias("text"), F.lit(True).alias("loss")))
    return pack_examples(docs, docs["doc_id"], parts, **limits)


def pack_conversations(turns: DataFrame, **limits) -> DataFrame:
    """``pack_examples`` of conversations (conv_id, turn, role, text): only assistant turns bear loss."""
    turn = F.struct(turns["turn"].alias("turn"), text_of(turns).alias("text"),
                    F.coalesce(turns["role"] == "assistant", F.lit(False)).alias("loss"))
    joined = turns.groupBy(turns["conv_id"].alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return pack_examples(joined, F.col("conv"), F.expr("transform(turns, t -> struct(t.text as text, t.loss as loss))"),
                         **limits)

