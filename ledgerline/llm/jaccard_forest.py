"""Near-duplicate self-join on word shingles: a MinHash LSH forest, then exact verification.

A document is the set of its 5-word shingles (of all its words, if it has 1 to
4). Two documents link when the Jaccard similarity of their sets is at least
0.8. Texts of the same words are collapsed to one representative first, with
its number of copies.

The forest has ``TRIES`` tries. A representative's label in a trie is the
sequence of ``DEPTH`` MinHash values, stored as bytes that sort as the trie does,
so a prefix of a label is a node of the trie. Matching starts with whole
labels, and prefixes are shortened by one value at a time until the target
recall is met: beforehand by the chance 1 - (1 - s^depth)^TRIES of finding a pair
at the threshold, and after a pass by the same chance at the similarities that
were really found (each verified pair stands for 1/chance pairs); if that
estimate is below the target, the join runs again one value shorter.

Representatives meet at trie nodes (buckets); buckets with the same members in
several tries are kept once. A large bucket is cut into chunks, and pairs of
chunks are verified, at most ``2 * CHUNK`` texts at a time; there is no cap on members,
candidates or partners. A task builds the shingle sets of its texts, counts
all intersections of a block by one matrix product and returns per text its number
of links and one root, never pairs. A pair that shares several tries counts in
the first of them only. Classes are the components of the roots.

Defined results: null and empty texts have no shingles, so no links by
similarity; but copies of a text, also of an empty one, link each other.
Every copy counts as a link. class_id is the smallest doc_id of the class
(null only if all are null). Repeated rows are copies. Rows that share a doc_id
are told apart by their text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import connected, expand_salts, row_digest, rows_that_stay, salt_of, text_of, written
from ledgerline.operators.joins import checked_broadcast

SHINGLE = 5
THRESHOLD = 0.8
TRIES = 16
DEPTH = 4
TARGET_RECALL = 0.9995
CHUNK = 256
SALTS = 32
KEPT_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hash of each word (bytes) met so far."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, sorted."""
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        s = _mixed(s * _MIX + h[k:k + n])
    return np.unique(s)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    count = TRIES * DEPTH
    return (rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, count, dtype=np.uint64))


def labels_of(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The label of a set in each trie: DEPTH big-endian 32-bit values each, trie after trie."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at:at + 4096]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _signer(batches):
    import pyarrow as pa

    functions = _functions()
    for batch in batches:
        digests, signs = [], []
        for raw in batch.column("raw").to_pylist():
            words = raw.split()  # bytes split at ASCII white space
            digests.append(hashlib.sha256(b" ".join(words)).digest())
            signs.append(labels_of(shingles(words), functions) if words else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
            names=["doc_id", "digest", "sign"])
    _hashes.clear()  # the worker goes on to other work


def _digester(batches):
    import pyarrow as pa

    for batch in batches:
        digests = [hashlib.sha256(b" ".join(raw.split())).digest() for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("raw")], names=["digest", "raw"])


def expected_recall(similarity: float, depth: int, tries: int = TRIES) -> float:
    return 1 - (1 - similarity**depth) ** tries


def planned_depth(threshold: float, target: float) -> int:
    """The longest prefix that meets the target at the threshold (1 if none does)."""
    depth = DEPTH
    while depth > 1 and expected_recall(threshold, depth) < target:
        depth -= 1
    return depth


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of 0/1 matrices over the shared elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    owner, place = owner[shared], (np.cumsum(seen > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total, width = np.zeros((len(sets), len(sets)), dtype=np.int64), 8192
    for at in range(0, int((seen > 1).sum()), width):
        low, high = np.searchsorted(place, [at, at + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[low:high], place[low:high] - at] = 1
        total += np.rint(block @ block.T).astype(np.int64)
    del values
    return total


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component in a symmetric adjacency matrix."""
    root = np.arange(len(linked))
    while True:
        around = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, around)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verifier(threshold: float, depth: int):
    def verify_block(trie: int, sets, signs, copies, sides):
        n = len(sets)
        both = _intersections(sets)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        union = size[:, None] + size[None, :] - both
        pair = both + 1e-9 >= threshold * union
        if sides.any():  # two chunks of a bucket: only pairs between them
            pair &= sides[:, None] != sides[None, :]
        np.fill_diagonal(pair, False)
        for t in range(trie):  # counted where they met first
            pair &= signs[:, t, None] != signs[None, :, t]
        links = (pair * copies[None, :]).sum(axis=1)
        similarity = both[np.triu(pair)] / union[np.triu(pair)]
        chance = 1 - (1 - similarity**depth) ** TRIES
        return _roots(pair), links, len(chance), float((1 / chance - 1).sum()) if n else 0.0

    def verify(key, table):
        import pyarrow as pa

        known: dict[bytes, np.ndarray] = {}
        blocks: dict[tuple, dict[bytes, tuple]] = {}
        columns = ("trie", "node", "left", "right", "side", "digest", "sign", "copies", "raw")
        for trie, node, left, right, side, digest, sign, count, raw in zip(
                *(table[c].to_pylist() for c in columns), strict=True):
            if digest not in known:
                known[digest] = shingles(raw.split())
            blocks.setdefault((trie, node, left, right), {})[digest] = (side, sign, count)
        out: list[tuple] = []
        for (trie, *_), members in sorted(blocks.items()):
            names = sorted(members)
            if len(names) < 2:
                continue
            labels = np.frombuffer(b"".join(members[d][1] for d in names), ">u4").reshape(len(names), TRIES, DEPTH)
            prefix = np.zeros((len(names), TRIES), dtype=np.uint64)
            for k in range(depth):
                prefix = _mixed(prefix * _MIX + labels[:, :, k].astype(np.uint64))
            root, links, pairs, missed = verify_block(
                trie, [known[d] for d in names], prefix, np.array([members[d][2] for d in names], dtype=np.int64),
                np.array([members[d][0] for d in names]))
            found = [i for i in range(len(names)) if links[i]]
            out += [(names[i], names[root[i]], int(links[i]), pairs if i == found[0] else 0,
                     missed if i == found[0] else 0.0) for i in found]
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({name: pa.array(column, kind) for name, column, kind in
                         zip(("digest", "root", "links", "pairs", "missed"), columns, kinds, strict=True)})

    return verify


def _meetings(reps: DataFrame, depth: int) -> DataFrame:
    """Who is in which block: trie, node, left, right, side, digest, sign, copies, doc_id."""
    width = 4 * DEPTH
    at = (F.explode(F.expr(f"transform(sequence(0, {TRIES - 1}), t -> struct(t as trie, "
                           f"substring(sign, t * {width} + 1, {4 * depth}) as node))")))
    places = reps.where("sign is not null").select("digest", at.alias("at")).select("digest", "at.trie", "at.node")
    buckets = (places.groupBy("trie", "node")
               .agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("f1"),
                    F.sum(F.xxhash64(F.lit(1), "digest").cast("decimal(38,0)")).alias("f2"))
               .where("members > 1"))
    # The same members in several tries: the first trie has the pairs.
    first = (buckets.groupBy("members", "f1", "f2").agg(F.min(F.struct("trie", "node")).alias("at"))
             .select("at.trie", "at.node", "members"))
    chunks = F.expr(f"int(ceil(members / {CHUNK}D))")
    rows = places.join(first, ["trie", "node"]).withColumn("chunks", chunks)
    mine = F.expr("int(pmod(xxhash64(digest), chunks))")
    each = F.explode(F.expr("transform(sequence(0, chunks - 1), c -> struct("
                            "least(c, mine) as left, greatest(c, mine) as right, int(mine > c) as side))"))
    rows = rows.withColumn("mine", mine).select("trie", "node", "digest", each.alias("b"))
    rows = rows.select("trie", "node", "digest", "b.left", "b.right",
                       F.when(F.col("b.left") == F.col("b.right"), 0).otherwise(F.col("b.side")).alias("side"))
    return rows.join(reps.select("digest", "sign", "copies", "doc_id"), "digest")


def verified_links(docs: DataFrame, reps: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Per text and block: digest, root, links, and the block's pairs with the estimate of pairs missed."""
    rows = written(_meetings(reps, depth), "forest-blocks")
    packs = max(1, -(-rows.count() // (2 * CHUNK)))
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("trie", "node", "left", "right"), F.lit(packs)))
    texts = docs.select(docs["doc_id"].alias("__id"), text_of(docs).cast("binary").alias("raw"))
    wanted = checked_broadcast(rows.select(F.col("doc_id").alias("__id")).distinct())
    same = lambda a, b: a.eqNullSafe(b)
    texts = texts.join(wanted.withColumnRenamed("__id", "__w"), same(F.col("__id"), F.col("__w")), "left_semi")
    # One text per digest: rows that repeat an id, or have none, would otherwise meet all blocks of each other.
    texts = texts.select("raw").mapInArrow(_digester, "digest binary, raw binary")
    texts = texts.groupBy("digest").agg(F.first("raw").alias("raw"))
    full = rows.drop("doc_id").join(texts, "digest")
    made = full.groupBy("pack").applyInArrow(
        _verifier(threshold, depth), "digest binary, root binary, links long, pairs long, missed double")
    return written(made, "forest-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, digest, class_id, n_links (documents that it links to), n_copies of its text,
    and whether it is the one of its class that stays."""
    raw = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("raw"))
    signed = written(raw.mapInArrow(_signer, "doc_id long, digest binary, sign binary"), "forest-signs")
    salted = signed.withColumn("salt", salt_of(F.col("doc_id"), SALTS))
    reps = (salted.groupBy("digest", "sign", "salt").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
            .groupBy("digest", "sign").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("copies"),
                                           F.sum(F.expr("shiftleft(1L, salt)")).alias("salts")))
    reps = written(reps, "forest-reps")
    depth = planned_depth(threshold, target)
    while True:
        links = verified_links(docs, reps, threshold, depth)
        pairs, missed = links.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0.0))).first()
        if depth == 1 or pairs >= target * (pairs + missed):
            break
        depth -= 1
    classes = connected(links.select(F.col("digest").alias("a"), F.col("root").alias("b")), "forest-classes")
    near = links.groupBy("digest").agg(F.sum("links").alias("near"))
    known = reps.select("digest", "doc_id", "copies", "salts").join(near, "digest", "left").join(
        classes.withColumnRenamed("node", "digest"), "digest", "left")
    known = known.withColumn("root", F.coalesce("root", "digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("w")
    least = known.groupBy("root").agg(first).select("root", "w.doc_id", "w.digest").toDF("root", "class_id", "best")
    known = known.join(least, "root").select(
        "digest", "class_id", (F.col("digest") == F.col("best")).alias("leads"), "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "salts")
    rows = salted.drop("sign").join(expand_salts(known, SALTS), ["digest", "salt"])
    return rows.select("doc_id", "digest", "class_id", "n_links", F.col("copies").alias("n_copies"),
                       (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class stays, the one with the smallest doc_id, with all columns of ``docs``."""
    return rows_that_stay(docs, row_digest(docs), near_duplicates(docs, threshold).where("stays"))
